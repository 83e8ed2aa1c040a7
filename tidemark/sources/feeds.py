"""Saved feed files as tables: RSS items, article-list JSON, tab-separated knowledge-graph rows, Atom filings.

Defined results: items without link and title are skipped; unreadable lines give no row; missing fields are null.
"""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import strip_tags

# The economic themes that a knowledge-graph row must name one of.
THEMES = ["ECON_", "INFLATION", "CENTRAL_BANK", "EPU_ECONOMY", "WB_1104_MACROECONOMIC", "UNEMPLOYMENT"]
RSS = "title string, link string, description string, pubDate string, updated string, created string"
ATOM = "title string, summary string, updated string, link struct<_href: string>"
ARTICLES = "struct<articles: array<struct<url: string, title: string, seendate: string, domain: string, language: string>>>"


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(RSS).option("rowTag", "item").format("xml").load(path)
    link, title = F.trim(F.coalesce("link", F.lit(""))), F.trim(F.coalesce("title", F.lit("")))
    item = raw.select(F.sha2(F.when(link != "", link).otherwise(title), 256).alias("id"), title.alias("title"), link.alias("url"), strip_tags(F.coalesce("description", F.lit(""))).alias("content_snippet"), F.coalesce("pubDate", "updated", "created").alias("published_time"),
                      F.when(F.col("pubDate").isNotNull(), "feed:published").when(F.col("updated").isNotNull(), "feed:updated").when(F.col("created").isNotNull(), "feed:created").otherwise("ingestion_fallback").alias("time_kind"))
    return item.where("title <> '' or url <> ''")


def listed_articles(df: DataFrame, body: str) -> DataFrame:
    """One row per article of a JSON answer held in column `body`."""
    a = df.select(F.explode(F.from_json(body, ARTICLES)["articles"]).alias("a")).select("a.*")
    return a.where("coalesce(trim(url), '') <> ''").select(F.sha2(F.trim("url"), 256).alias("id"), F.trim("url").alias("url"), "title", F.col("seendate").alias("published_time"), "domain", "language")


def graph_rows(lines: DataFrame, line: str = "value", limit: int | None = 50) -> DataFrame:
    """Knowledge-graph lines with more than seven columns, a URL and an economic theme. The limit is a feature of the
    poll (newest file, first rows by URL); None takes all."""
    c = F.split(line, "\t", -1)
    rows = lines.select(F.trim(F.get(c, F.lit(4))).alias("url"), F.get(c, F.lit(7)).alias("themes"), F.trim(F.get(c, F.lit(3))).alias("domain"), F.trim(F.get(c, F.lit(1))).alias("stamp"), F.size(c).alias("n"))
    wanted = F.lit(False)
    for t in THEMES:
        wanted = wanted | F.contains("themes", F.lit(t))
    rows = rows.where((F.col("n") > 7) & (F.col("url") != "") & wanted)
    words = F.filter(F.split(F.regexp_replace(F.element_at(F.split(F.regexp_replace("url", "/+$", ""), "/"), -1), "[-_]", " "), r"\s+"), lambda w: (w != "") & ~w.rlike(r"\.(html|htm|php)$"))
    slug = F.array_join(words, " ")
    title = F.when(F.length(slug) > 5, F.concat(F.upper(F.substring(slug, 1, 1)), F.lower(F.substring(slug, 2, 10_000)))).otherwise(F.concat(F.lit("["), "domain", F.lit("] Macroeconomic & Policy News")))
    out = rows.select(F.sha2("url", 256).alias("id"), "url", title.alias("title"), "domain", "stamp")
    return out if limit is None else out.orderBy("url", "stamp").limit(limit)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def atom_filings(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(ATOM).option("rowTag", "entry").format("xml").load(path)
    title, summary = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("summary", F.lit("")))
    # fixed values: the patterns of a filing's title and summary
    form = r"^([\w\-/]+)\s*-\s*(.+)"
    return raw.select(title.alias("title"), F.coalesce(_found(title, form), F.lit("")).alias("form_type"), F.coalesce(_found(title, form, 2), title).alias("company_name"),
                      _found(title, r"\((\d{7,10})\)").alias("cik"), _found(summary, r"AccNo:</b>\s*([\d-]+)").alias("accession_number"), summary.alias("summary"), F.coalesce("link._href", F.lit("")).alias("link"), F.trim("updated").alias("updated"))
