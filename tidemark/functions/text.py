"""Text functions as Column expressions; all stay inside the JVM."""
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Polarity lexicon, negators, irregular past forms, antonyms.
POSITIVE = [
    "beat", "surge", "soar", "spike", "jump", "rally", "rebound", "climb", "gain", "rise", "raise", "hike", "boost", "upgrade", "exceed",
    "outperform", "bullish", "record", "strong", "top",
]
NEGATIVE = [
    "miss", "plunge", "plummet", "crash", "sink", "fall", "drop", "decline", "tumble", "slump", "slide", "loss", "cut", "lower", "downgrade",
    "underperform", "bearish", "warn", "weak", "slash",
]
NEGATORS = [
    "not", "no", "never", "without", "except", "excluding", "fail", "fails", "failing", "didn", "wasn", "isn", "aren", "weren", "don", "doesn",
    "couldn", "wouldn", "shouldn", "won",
]
NEGATION_WINDOW = 3
IRREGULAR = {"rose": "rise", "fell": "fall", "sank": "sink", "slid": "slide"}
ANTONYMS = {
    "beat": ["miss", "underperform"],
    "top": ["miss", "underperform"],
    "exceed": ["miss", "underperform"],
    "outperform": ["miss", "underperform"],
    "hike": ["cut", "slash", "lower"],
    "raise": ["cut", "slash", "lower"],
    "boost": ["cut", "slash", "lower"],
    "surge": ["plunge", "plummet", "crash", "slump", "sink", "slide", "fall", "drop", "decline"],
    "soar": ["plunge", "plummet", "crash", "slump", "sink", "slide", "fall"],
    "spike": ["plunge", "plummet", "crash", "slump", "sink", "slide", "fall"],
    "jump": ["plunge", "plummet", "sink", "slump", "tumble", "slide", "fall", "drop", "decline"],
    "rally": ["plunge", "plummet", "crash", "sink", "slump", "slide", "tumble", "fall", "drop", "decline"],
    "rebound": ["plunge", "plummet", "crash", "slump", "slide", "tumble", "fall", "drop", "decline"],
    "climb": ["tumble", "plunge", "plummet", "crash", "slump", "sink", "fall", "slide", "drop", "decline"],
    "rise": ["fall", "drop", "decline", "sink", "slump", "plunge", "plummet", "tumble", "slide", "crash"],
    "gain": ["loss", "drop", "fall", "decline", "slide", "tumble"],
    "upgrade": ["downgrade"],
    "bullish": ["bearish"],
    "strong": ["weak"],
}
# Names and the entity codes they stand for.
ALIASES = {
    "apple": "AAPL", "microsoft": "MSFT", "tesla": "TSLA", "amazon": "AMZN", "alphabet": "GOOGL", "google": "GOOGL", "youtube": "GOOGL",
    "meta": "META", "facebook": "META", "instagram": "META", "nvidia": "NVDA", "netflix": "NFLX", "disney": "DIS", "hulu": "DIS", "ford": "F",
    "general motors": "GM", "rivian": "RIVN", "lucid": "LCID", "toyota": "TM", "jpmorgan": "JPM", "j.p. morgan": "JPM", "jp morgan": "JPM",
    "goldman sachs": "GS", "goldman": "GS", "morgan stanley": "MS", "bank of america": "BAC", "wells fargo": "WFC", "citigroup": "C", "citi": "C",
    "barclays": "BCS", "hsbc": "HSBC", "blackrock": "BLK", "citadel": "CIT", "robinhood": "HOOD", "coinbase": "COIN", "paypal": "PYPL", "visa": "V",
    "mastercard": "MA", "pfizer": "PFE", "novartis": "NVS", "moderna": "MRNA", "merck": "MRK", "johnson & johnson": "JNJ", "abbvie": "ABBV",
    "eli lilly": "LLY", "amgen": "AMGN", "gilead": "GILD", "regeneron": "REGN", "exxon": "XOM", "exxonmobil": "XOM", "chevron": "CVX", "shell": "SHEL",
    "lockheed martin": "LMT", "lockheed": "LMT", "boeing": "BA", "general electric": "GE", "walmart": "WMT", "mcdonald": "MCD", "starbucks": "SBUX",
    "nike": "NKE", "coca-cola": "KO", "coca cola": "KO", "pepsi": "PEP", "procter & gamble": "PG", "procter and gamble": "PG", "uber": "UBER",
    "airbnb": "ABNB", "salesforce": "CRM", "oracle": "ORCL", "intel": "INTC", "amd": "AMD", "qualcomm": "QCOM", "micron": "MU", "tsmc": "TSM",
    "samsung": "SSNLF", "ibm": "IBM", "cisco": "CSCO", "adobe": "ADBE", "palantir": "PLTR", "snowflake": "SNOW", "shopify": "SHOP", "verizon": "VZ",
    "comcast": "CMCSA", "t-mobile": "TMUS", "delta air lines": "DAL", "delta airlines": "DAL", "united airlines": "UAL", "american airlines": "AAL",
    "southwest airlines": "LUV", "carnival": "CCL", "royal caribbean": "RCL", "federal reserve": "FED", "the fed": "FED", "fed": "FED", "fomc": "FED",
    "federal open market committee": "FED", "european central bank": "ECB", "ecb": "ECB", "bank of england": "BOE", "bank of japan": "BOJ", "boj": "BOJ",
    "people's bank of china": "PBOC", "international monetary fund": "IMF", "imf": "IMF", "opec": "OPEC",
    "organization of the petroleum exporting countries": "OPEC", "u.s. treasury": "UST", "us treasury": "UST", "treasury department": "UST",
}
# Capitals that are no ticker; words that carry no hint.
NO_TICKER = [
    "THE", "AND", "FOR", "NEW", "GDP", "FED", "CPI", "USA", "USD", "EUR", "RATE", "BANK", "NEWS", "BILL", "POST", "TECH", "AI", "ECB", "OPEC", "IMF",
    "FOMC", "BOE", "BOJ", "CEO", "CFO", "COO", "CTO", "IPO", "ETF", "APY", "CD", "SPAC", "PDF", "SPX", "LBO", "CDO", "ABS", "ARM", "UK", "EU", "NYSE",
    "NASDAQ", "SEC", "FTC", "DOJ", "FBI", "CIA", "DOW", "US", "PMI", "FDA",
]
LEGACY_NO_TICKER = [
    "THE", "AND", "FOR", "NEW", "GDP", "FED", "CPI", "USA", "USD", "EUR", "RATE", "BANK", "NEWS", "BILL", "POST", "TECH", "AI",
]
HINT_STOP = [
    "a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "it", "its", "of", "on", "or", "s", "the", "to", "with",
]


@lru_cache(maxsize=1)
def inflections() -> dict[str, str]:
    """Every token that resolves to a lexicon word, generated from the suffix rules (plural, past, progressive)."""
    table: dict[str, str] = {}
    for w in [*POSITIVE, *NEGATIVE]:
        forms = [w + "s", w + "ed", w + "ing"]
        if len(w) > 1:
            forms.append(w + "es")
            forms += [w + w[-1] + "ed", w + w[-1] + "ing"] if len(w) > 1 else []
        if w.endswith("y"):
            forms.append(w[:-1] + "ies")
        if w.endswith("e"):
            forms += [w + "d", w[:-1] + "ing"]
        for f in forms:
            table.setdefault(f, w)
    table |= IRREGULAR
    return table | {w: w for w in [*POSITIVE, *NEGATIVE]}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv])


def _set(words) -> Column:
    return F.array(*[F.lit(w) for w in sorted(words)])


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+"), lambda w: w != "")


def _polar(t: Column) -> Column:
    """Is the token in the lexicon: a hash set, where maps are searched from end to end."""
    return t.isin(sorted(inflections()))


def _base(t: Column) -> Column:
    return F.try_element_at(_map(inflections()), t)


def profile(toks: Column) -> Column:
    """Struct of sorted distinct positive and negative base forms; a negator within three tokens before flips."""
    positive, negators = _set(POSITIVE), _set(NEGATORS)
    flip = lambda i: F.arrays_overlap(F.slice(toks, F.greatest(i - NEGATION_WINDOW, F.lit(0)) + 1, F.least(i, F.lit(NEGATION_WINDOW))), negators)
    seen = F.transform(toks, lambda t, i: F.when(_polar(t), F.struct(_base(t).alias("w"), flip(i).alias("flip"))))
    up = lambda s: F.array_contains(positive, s["w"]) != F.coalesce(s["flip"], F.lit(False))
    pick = lambda hits, keep: F.array_sort(F.array_distinct(F.transform(F.filter(hits, keep), lambda s: s["w"])))
    both = lambda hits: F.struct(pick(hits, up).alias("pos"), pick(hits, lambda s: ~up(s)).alias("neg"))
    return F.get(F.transform(F.array(F.filter(seen, lambda s: s.isNotNull())), both), F.lit(0))  # the hits are found once for both


def profile_text(p: Column) -> Column:
    return F.array_join(F.concat(F.transform(p["pos"], lambda w: F.concat(F.lit("+"), w)), F.transform(p["neg"], lambda w: F.concat(F.lit("-"), w))), ",")


def parse_profile(text: Column) -> Column:
    """The struct that profile_text wrote."""
    parts = F.split(text, ",")
    side = lambda sign: F.transform(F.filter(parts, lambda w: w.startswith(sign)), lambda w: F.substring(w, 2, 1000))
    return F.struct(side("+").alias("pos"), side("-").alias("neg"))


@lru_cache(maxsize=1)
def antonyms() -> dict[str, list[str]]:
    """Symmetric closure of the antonym pairs."""
    both: dict[str, set] = {}
    for a, others in ANTONYMS.items():
        for b in others:
            both.setdefault(a, set()).add(b)
            both.setdefault(b, set()).add(a)
    return {k: sorted(v) for k, v in both.items()}


def conflict(a: Column, b: Column) -> Column:
    """Same word in opposite classes, or a positive word against an antonym that only the other side has as negative."""
    table = F.create_map(*[x for k, v in sorted(antonyms().items()) for x in (F.lit(k), _set(v))])
    against = lambda neg: F.flatten(F.filter(F.transform(neg, lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull()))
    clash = lambda pos, own, other: F.arrays_overlap(pos, against(F.array_except(other, own)))
    return (F.arrays_overlap(a["pos"], b["neg"]) | F.arrays_overlap(b["pos"], a["neg"]) | clash(a["pos"], a["neg"], b["neg"]) | clash(b["pos"], b["neg"], a["neg"]))


def conflict_bits(p: Column) -> tuple[Column, Column]:
    """against, said: words as bits, such that profiles a and b conflict where a.against & b.said or b.against & a.said is not 0."""
    bit = {w: 1 << k for k, w in enumerate([*POSITIVE, *NEGATIVE])}
    bits = lambda words, table: F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s.bitwiseOR(F.coalesce(F.try_element_at(_map(table), w), F.lit(0).cast("long"))))
    said = bits(p["neg"], bit)
    against = bits(p["pos"], bit).bitwiseOR(bits(p["pos"], {w: sum(bit[x] for x in others) for w, others in antonyms().items()}).bitwiseAND(F.bitwise_not(said)))
    return against.alias("against"), said.alias("said")


def shingles(text: Column) -> Column:
    return shingles_of(tokens(text))


def shingles_of(t: Column) -> Column:
    """Sorted distinct words, neighbouring word pairs and two anchors per polar token."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    polar = F.transform(F.filter(t, _polar), _base)
    anchors = F.flatten(F.transform(polar, lambda w: F.array(F.concat(F.lit("__POLAR_ANCHOR_1__"), w), F.concat(F.lit("__POLAR_ANCHOR_2__"), w))))
    return F.array_sort(F.array_distinct(F.concat(t, pairs, anchors)))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def entities(text: Column) -> Column:
    """Sorted distinct entity codes: names (longest first), then $TICKER or capitals outside the stop list."""
    alias = "|".join(re.escape(a) for a in sorted(ALIASES, key=lambda a: (-len(a), a)))
    named = F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z])({alias})(?![a-z])"), 1), lambda a: F.try_element_at(_map(ALIASES), a))
    dollar = F.regexp_extract_all(text, F.lit(r"\$([A-Z]{1,5})\b"), 1)
    capitals = F.regexp_extract_all(text, F.lit(r"(?<![\w$])([A-Z]{2,5})\b"), 1)
    plain = F.filter(F.concat(dollar, capitals), lambda w: ~F.array_contains(_set(NO_TICKER), w))
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(named, plain))), F.array().cast("array<string>"))


def strip_tags(text: Column, by: str = "", length: int = 500) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, "<[^>]+>", by)), 1, length)


def slug_title(url: Column) -> Column:
    """Last path part of a URL as a capitalised title, without file-type words."""
    last = F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, r"/+$", ""), "/"), -1), r"\.", "-")
    words = F.filter(F.split(last, r"[-_]+"), lambda w: ~w.isin("html", "htm", "php", ""))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), " ")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)), r"^www\.", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def padded_cik(cik: Column) -> Column:
    return F.when(F.length(cik) < 10, F.lpad(cik, 10, "0")).otherwise(cik)


def quality_flag(title: Column, source: Column, snippet: Column, provenance: Column) -> Column:
    words = F.size(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("([A-Za-z]+)"), 1))
    bare = (words < 4) | F.coalesce(title.rlike(r"(?i)\b[0-9a-f]{12,}\b"), F.lit(False))
    return (F.when(bare, "inspect_identifier_like_title").when(provenance == "url_slug", "synthetic_url_slug")
             .when((source == "GDELT") & (snippet.startswith("Source:") | snippet.startswith("Domain:")), "metadata_only_snippet").otherwise(""))


def hint_words(title: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(title), F.lit(r"([a-z0-9$%]+)"), 1), lambda w: ~F.array_contains(_set(HINT_STOP), w))))


def tickers(text: Column) -> Column:
    """First ten of the sorted probable tickers: $X to $XXXXX and capitals of two to five letters outside the short stop list."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"\$([A-Z]{1,5})\b"), 1), F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,5})\b"), 1))
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda t: ~F.array_contains(_set(LEGACY_NO_TICKER), t)))), 1, 10)


def story_id(members: Column) -> Column:
    """Identity of a story from its sorted members."""
    return F.concat(F.lit("story-"), F.substring(F.sha2(F.array_join(members, "\n"), 256), 1, 16))


def parse_answer(line: Column) -> Column:
    """Struct kind (multi, uncertain, alone; null on an error or an empty line), numbers, reason, error of one line of the answer grammar
    `story: 1 7 | reason`, `uncertain: 3 9 | reason`, `alone: 2 4`; what follows # is a remark."""
    form = r"^(story|uncertain|alone):([\s\d]+)(?:\|(.*))?$"
    text = F.trim(F.regexp_replace(line, r"#.*$", ""))
    word, reason = F.regexp_extract(text, form, 1), F.trim(F.regexp_extract(text, form, 3))
    numbers = F.filter(F.split(F.trim(F.regexp_extract(text, form, 2)), r"\s+"), lambda n: n != "")
    error = (F.when(text == "", None).when(word == "", "not story:, uncertain: or alone:").when((word != "alone") & (reason == ""), "a reason is needed")
              .when((word == "story") & (F.size(numbers) < 2), "a story needs at least two").when(F.size(F.array_distinct(numbers)) < F.size(numbers), "a number is repeated"))
    kind = F.when(error.isNull(), F.when(word == "story", "multi").otherwise(F.nullif(word, F.lit(""))))
    return F.struct(kind.alias("kind"), numbers.alias("numbers"), F.nullif(reason, F.lit("")).alias("reason"), error.alias("error"))
