"""Visually identical text: one consistent form, changed only where it is unstable.

A character is unstable if its canonical form differs from itself or if it may join with what precedes it
(combining marks, second halves of compositions): the quick check. Texts without one are already canonical and
never leave the JVM. In the others each run of unstable characters, with the one character before it as
boundary context, is normalised, and the segments are spliced into the unchanged rest.

Canonical form of a segment: invisible characters go; wide, narrow, no-break and styled letters take their plain form; joined
letters of the same look are taken apart; every blank is a space; look-alike letters of other scripts
take one letter (decided per letter after decomposition, so accents stay); then NFC. Case, accents, punctuation, raised,
lowered and enclosed digits, sharp s and ae, and the number of blanks are left alone.

Defined results: null texts have no form and match nothing; an empty text is its own form; texts equal to the last character
are no pair; repeated ids count once.
"""
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import materialize

# Letters drawn alike in common typefaces, by script, and the letter they take. No two letters of one alphabet
# take the same letter unless they are drawn alike themselves.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХаеорсухѕіјһԁԛԝԌԚԜӀӏУҮүѴѵҽӘәӔӕӨөѲѳӠӡԐԑҪҫћѰѱ", "ABESIJKMHOPCTXaeopcyxsijhdqwGQWIlYYyVveƏəÆæƟɵƟɵƷʒƐεÇçħΨψ"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϹͿϳαγιρυκβϒϜϷϸϺΓΠΦφͶͷϽͻµ", "ABEZHIKMNOPTYXovcCJjayipuкßYFÞþMГПФфИиƆɔμ"))
LATIN = dict(zip("ɡɑɩᴄᴏᴠᴡᴢꜱʙʜᴍᴛĸᴋᴎᴙᴫᴦᴨɛɜɸÐƉǝƩɅᴧᴐꭓꞵ", "gaicovwzsвнмтккиялгпεзфĐĐəΣΛʌɔχß")) | {"ʣ": "dz", "ʦ": "ts", "ʪ": "ls", "ʫ": "lz"}
ARMENIAN = dict(zip("ՍՏՕԼհյոսօզց", "USOLhjnuoqg"))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏙᏚᏞᏟᏢᏦᏧᏴꮓꮩꮪꮃꮯ", "DRTiAJEWMHYGhZbVSLCPKdBzvswc"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
COPTIC = dict(zip("ⲂⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⲄ", "BHIKMNOoPpCcTYXГ"))
OTHER = dict(zip("𐐄𐐬𐐕𐐽𐐛𐑈𐓂𐓪𐓎𐓶ყⵔⵝⴹዐഠଠဝↃↄℵℶℷℸ", "OoCcLsOoUuyOXEOoOoƆɔאבגד"))
SCRIPTS = (CYRILLIC, GREEK, LATIN, ARMENIAN, CHEROKEE, LISU, COPTIC, OTHER)
# Ranges of joined letters of the same look (compatibility decompositions to letters).
JOINED = [(0x0132, 0x0133), (0x013F, 0x0140), (0x0149, 0x0149), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFB4F, 0xFB4F), (0xFEF5, 0xFEFC)]
# Invisible characters outside the format category.
INVISIBLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFFA0, 0xFFA0), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]
# Format characters that are drawn.
DRAWN = [(0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110CD), (0xFFF9, 0xFFFB), (0x13430, 0x1345F), (0x1D173, 0x1D17A)]


def _within(c: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= c <= b for a, b in ranges)


@lru_cache(maxsize=1)
def tables() -> tuple[dict[int, str], list[tuple[int, int]]]:
    """(single-character replacements, ranges of unstable characters), derived from the character properties."""
    replace: dict[int, str] = {ord(a): b for script in SCRIPTS for a, b in script.items() if a != b}
    joins: set[int] = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for c in range(0x110000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Cs", "Co") and not _within(c, INVISIBLE):
            continue
        if (kind == "Cf" and not _within(c, DRAWN)) or _within(c, INVISIBLE):
            replace[c] = ""
        elif (kind == "Zs" and c != 0x20) or c == 0x09:
            replace[c] = " "
        elif how := unicodedata.decomposition(ch):
            tag, _, rest = how.rpartition("> ")
            to = "".join(chr(int(x, 16)) for x in rest.split())
            if tag in ("<wide", "<narrow", "<noBreak", "<font") or (tag in ("<compat", "<isolated", "<final") and _within(c, JOINED)):
                replace[c] = to
            elif not tag and len(to) == 2 and unicodedata.normalize("NFC", ch) == ch:
                joins.add(ord(to[1]))
        if unicodedata.combining(ch):
            joins.add(c)
    for _ in range(2):  # replacements of replacements
        replace = {c: "".join(replace.get(ord(x), x) for x in to) for c, to in replace.items()}
    unstable = set(replace) | joins
    for c in range(0x80, 0x110000):
        if c not in unstable and not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4:
            ch = chr(c)
            if unicodedata.decomposition(ch) and _form(ch, replace) != ch:
                unstable.add(c)
    ranges: list[tuple[int, int]] = []
    for c in sorted(unstable):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1] = (ranges[-1][0], c)
        else:
            ranges.append((c, c))
    return replace, ranges


def _form(segment: str, replace: dict[int, str]) -> str:
    plain = segment.translate(replace)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", plain).translate(replace))


@lru_cache(maxsize=1)
def _segments() -> re.Pattern:
    unstable = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in tables()[1])
    return re.compile(f"[^{unstable}]?[{unstable}]+", re.DOTALL)


@lru_cache(maxsize=200_000)
def _segment(segment: str) -> str:
    return _form(segment, tables()[0])


def canonical(text: str) -> str:
    """The consistent form of one text."""
    return _segments().sub(lambda m: _segment(m.group()), text)


def quick_check() -> str:
    """JVM pattern that finds a character outside the long stretches of stable characters (few ranges, so it is fast);
    what it finds may still be stable, which the segments decide."""
    cuts = [0, *(x for a, b in tables()[1] for x in (a, b + 1)), 0x110000]
    stable = [(a, b - 1) for a, b in zip(cuts[::2], cuts[1::2]) if b - a >= (8 if a < 0x180 else 64)]
    return "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in stable if a < 0x10000) + "]"


def _ascii_unstable() -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{min(b, 0x7F):X}}}" for a, b in tables()[1] if a < 0x80) + "]"


def canonical_texts(df: DataFrame, ident: str, text: str) -> DataFrame:
    """id, raw, canonical. Texts are scanned once: pure ASCII by their lengths, others by the quick check; stable texts never
    leave the JVM."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(canonical, na_action="ignore")

    raw = F.col("raw")
    ascii = F.octet_length(raw) == F.char_length(raw)
    unstable = F.when(ascii, raw.rlike(_ascii_unstable())).otherwise(raw.rlike(quick_check()))
    rows = df.select(F.col(ident).alias("id"), F.col(text).alias("raw")).withColumn("formed", form(F.when(unstable, raw)))
    return rows.select("id", "raw", F.coalesce("formed", "raw").alias("canonical"))


def reading_groups(df: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per document: doc_id, group_id (least id of the documents that read the same), n_texts (different texts among them),
    n_documents. Null texts are alone. Copies are counted, never paired."""
    rows = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col(text).alias("text")).distinct()
    forms = canonical_texts(rows.where("text is not null"), "id", "text")
    rows_ = materialize(forms.select("id", F.unhex(F.md5("canonical")).alias("form"), F.unhex(F.sha2("raw", 256)).alias("raw")), "forms")
    texts = rows_.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    groups = texts.groupBy("form").agg(F.min("first").alias("group_id"), F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_documents"))
    read = rows_.join(groups, "form").select(F.col("id").alias("doc_id"), "group_id", "n_texts", "n_documents")
    one = F.lit(1).cast("long")
    return read.unionByName(rows.where("text is null").select(F.col("id").alias("doc_id"), F.col("id").alias("group_id"), one.alias("n_texts"), one.alias("n_documents")))


def same_looking(df: DataFrame, ident: str, text: str) -> DataFrame:
    """doc_id_a, doc_id_b of documents that differ in characters but read the same. Variants (distinct texts of one form)
    are joined, then their documents; copies of one text never meet each other."""
    forms = canonical_texts(df.where(F.col(ident).isNotNull() & F.col(text).isNotNull()), ident, text)
    rows = materialize(forms.select("id", F.unhex(F.md5("canonical")).alias("form"), F.unhex(F.sha2("raw", 256)).alias("raw")), "forms").distinct()
    variants = rows.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"))
    several = variants.groupBy("form").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("form")
    rows = materialize(rows.join(several, "form", "left_semi"), "variants")
    v = rows.select("form", "raw").distinct()
    pairs = v.withColumnRenamed("raw", "ra").join(v.withColumnRenamed("raw", "rb"), "form").where("ra < rb")
    a, b = rows.select("form", F.col("raw").alias("ra"), F.col("id").alias("x")), rows.select("form", F.col("raw").alias("rb"), F.col("id").alias("y"))
    both = pairs.join(a, ["form", "ra"]).join(b, ["form", "rb"])
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
