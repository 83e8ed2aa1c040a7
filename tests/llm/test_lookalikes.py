import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lookalikes as L

SAME = [("ＡＢＣ１２％", "ABC12%"), ("é", "é"), ("ﬁne ﬂow", "fine flow"), ("a​b­c﻿⁠", "abc"), ("a b c　d", "a b c d"), ("раура1", "paypa1"), ("ΑΒΟΥΤ", "ABOYT"),
        ("ｶﾞｷﾞ", "ガギ"), ("ガ", "ガ"), ("K", "K"), ("e​́", "é"), ("е́", "é"), ("ѐ", "è"), ("𝐁old", "Bold"), ("한", "한"), ("a️", "a"), ("q̣̇", "q̣̇")]
DIFFERENT = [("a", "A"), ("e", "é"), ("x²", "x2"), ("H₂O", "H2O"), ("①", "1"), ("straße", "strasse"), ("æ", "ae"), ("a  b", "a b"), ("-", "–"), ("'", "’"), ("o", "0"), ("l", "1"), ("ж", "x"), ("\n", " "), ("a", "")]


def test_rules():
    assert all(L.canonical(a) == L.canonical(b) for a, b in SAME), [(a, b) for a, b in SAME if L.canonical(a) != L.canonical(b)]
    assert all(L.canonical(a) != L.canonical(b) for a, b in DIFFERENT)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from("aeе́̈​ ﬁＡガ한"))))
def test_segments_equal_the_whole(text):
    form = L.canonical(text)
    assert form == L._form(text, L.tables()[0]) and L.canonical(form) == form and unicodedata.is_normalized("NFC", form)


def test_pairs(spark):
    rows = [(1, "price up"), (2, "price up"), (3, "price up"), (4, "prіce up"), (5, "price down"), (6, None), (7, None), (8, ""), (9, "​"), (10, "straße"), (11, "strasse"), (12, "x" * 40000 + "é"), (13, "x" * 40000 + "é")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows + rows[:2]], "doc_id long, text string, raw string")
    got = sorted(tuple(r) for r in L.same_looking(df, "doc_id", "text").collect())
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (8, 9), (12, 13)]
    forms = {r["id"]: r["canonical"] for r in L.canonical_texts(df, "doc_id", "text").collect()}
    assert forms[2] == "price up" and forms[6] is None and forms[9] == "" and len(forms) == 13
    assert L.same_looking(df.limit(0), "doc_id", "text").count() == 0


def test_groups(spark):
    rows = [(1, "price up"), (2, "price up"), (4, "prіce up"), (5, "price down"), (6, None), (7, None), (8, ""), (9, "\u200b"), (10, "a\tb"), (11, "a b"), (1, "price up")]
    got = {r["doc_id"]: tuple(r)[1:] for r in L.reading_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {1: (1, 2, 3), 2: (1, 2, 3), 4: (1, 2, 3), 5: (5, 1, 1), 6: (6, 1, 1), 7: (7, 1, 1), 8: (8, 2, 2), 9: (8, 2, 2), 10: (10, 2, 2), 11: (10, 2, 2)}


def test_letter_classes():
    for letters in L.SCRIPTS:
        assert all(L.canonical(f"x{a}x") == L.canonical(f"x{b}x") for a, b in letters.items()), letters
    assert L.canonical("Phɑrma Bizurօ") == "Pharma Bizuro" and L.canonical("ρrice Уork") == "price York"
    assert [L.canonical(x) for x in ("ǆ", "ǅ", "ǳ", "ﬅ", "Ⅳ", "ŀ")] == ["dž", "Dž", "dz", "ſt", "IV", "l·"]


def test_letters_of_one_alphabet_stay_apart():
    for first, last in ((0x391, 0x3C9), (0x410, 0x44F), (0x531, 0x586), (0x13A0, 0x13F5), (0xA4D0, 0xA4F7), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x17E)):
        forms = {}
        for c in range(first, last + 1):
            if unicodedata.category(chr(c))[0] == "L":
                forms.setdefault(L.canonical(chr(c)), []).append(chr(c))
        assert not [x for x in forms.values() if len(x) > 1 and x != ["Ð", "Đ"]]
    assert L.canonical("σ") != L.canonical("ο") and L.canonical("ı") != L.canonical("i")
