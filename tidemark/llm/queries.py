"""Queries of the training-data problems on vectors and texts (1 and 6 to 10), and their SQL where SQL can say the same."""
from tidemark.llm.history_dedup import refused_pairs
from tidemark.llm.lookalikes import canonical_texts, reading_groups, same_looking
from tidemark.llm.mixing import mix_documents
from tidemark.llm.near_duplicates import alike_groups, alike_pairs
from tidemark.llm.neighbours import most_similar, similar_pairs
from tidemark.llm.packing import fill_report, pack_documents
from tidemark.sources.tables import table


def p1_found(spark, d):
    return similar_pairs(most_similar(table(spark, d, "dedup_results"), "result_id", "embedding", 384))


def p1_top(spark, d):
    return most_similar(table(spark, d, "dedup_results"), "result_id", "embedding", 384)


def p6_found(spark, d):
    return refused_pairs(table(spark, d, "silver_financial_news"))


def p7_found(spark, d):
    return alike_pairs(table(spark, d, "silver_financial_news"), "id", "title")


def p7_groups(spark, d):
    return alike_groups(table(spark, d, "silver_financial_news"), "id", "title")


def p8_pack(spark, d):
    return pack_documents(table(spark, d, "documents"))


def p8_report(spark, d):
    return fill_report(pack_documents(table(spark, d, "documents")))


def p9_mix(spark, d):
    return mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark, d):
    return mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark, d):
    return same_looking(table(spark, d, "documents"), "doc_id", "text")


def p10_canonical(spark, d):
    forms = canonical_texts(table(spark, d, "documents"), "doc_id", "text")
    return forms.select("id", "canonical", (forms["raw"] != forms["canonical"]).alias("changed"))


def p10_groups(spark, d):
    return reading_groups(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_top, p6_found, p7_found, p7_groups, p8_pack, p8_report, p9_mix, p9_report, p10_found, p10_canonical, p10_groups)}
_TOP = """WITH u AS (SELECT result_id, embedding::DOUBLE[] AS e FROM dedup_results WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 v AS (SELECT result_id, e, sqrt(list_dot_product(e, e)) AS n FROM u),
 s AS (SELECT a.result_id AS id, b.result_id AS other, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS similarity FROM v a JOIN v b ON a.result_id <> b.result_id),
 t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS place FROM s)"""
_WORDS = "list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')"
_TITLES = f"""WITH RECURSIVE w AS (SELECT DISTINCT id, ingested_time, {_WORDS} AS w FROM silver_financial_news WHERE title IS NOT NULL),
 e AS (SELECT id, ingested_time, list_sort(list_distinct(list_concat(w, list_transform(w[2:], lambda x, i: w[i] || ' ' || x)))) AS e FROM w WHERE len(w) > 0),
 p AS (SELECT a.id AS a, b.id AS b, a.ingested_time AS ta, b.ingested_time AS tb FROM e a JOIN e b ON a.id < b.id WHERE len(list_intersect(a.e, b.e)) >= 0.75 * (len(a.e) + len(b.e) - len(list_intersect(a.e, b.e)))),
 links AS (SELECT a, b, ta, tb FROM p UNION ALL SELECT b, a, tb, ta FROM p)"""
_SEQUENCE = f"""{_TITLES}, late AS (SELECT b AS id, tb AS t, list(a ORDER BY ta, a) AS before FROM links WHERE (ta, a) < (tb, b) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (ORDER BY t, id) AS r FROM late),
 run AS (SELECT 0 AS r, []::VARCHAR[] AS refused, NULL::VARCHAR AS id, NULL::VARCHAR AS partner UNION ALL
  SELECT o.r, CASE WHEN hit IS NULL THEN refused ELSE list_append(refused, o.id) END, o.id, hit FROM run JOIN o ON o.r = run.r + 1, LATERAL (SELECT list_filter(o.before, lambda x: NOT list_contains(run.refused, x))[1] AS hit))"""
#: Brute force; p1 is equal as long as no neighbour is missed, which holds on the small scales.
SQL: dict[str, str] = {
    "p1_found": _TOP + " SELECT DISTINCT least(id, other) AS result_id_a, greatest(id, other) AS result_id_b FROM t WHERE place <= 5",
    "p1_top": _TOP + " SELECT id, other, similarity, place FROM t WHERE place <= 5",
    "p6_found": _SEQUENCE + " SELECT least(id, partner) AS id_a, greatest(id, partner) AS id_b FROM run WHERE partner IS NOT NULL",
    "p7_found": _TITLES + " SELECT a AS id_a, b AS id_b FROM p",
    "p7_groups": _TITLES + """, reach AS (SELECT a AS id, a AS other FROM links UNION SELECT r.id, links.b FROM reach r JOIN links ON links.a = r.other),
 g AS (SELECT id, min(other) AS group_id FROM reach GROUP BY 1), k AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1)
 SELECT DISTINCT n.id, coalesce(least(g.group_id, n.id), n.id) AS group_id, coalesce(k.n, 0) AS n_links FROM silver_financial_news n LEFT JOIN g USING (id) LEFT JOIN k USING (id)""",
}
