import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import feeds, sinks, snapshot


def test_feeds(spark, tmp_path):
    rss = tmp_path / "rss.xml"
    rss.write_text("<rss><channel><item><title>A &amp; B</title><link>https://x.example/a</link><description>&lt;p&gt;Hello&lt;/p&gt; you</description><pubDate>Fri, 02 Jan 2026 03:04:05 GMT</pubDate></item><item><title> </title></item></channel></rss>")
    assert [(r["title"], r["url"], r["content_snippet"]) for r in feeds.rss_items(spark, str(rss)).collect()] == [("A & B", "https://x.example/a", "Hello you")]
    atom = tmp_path / "atom.xml"
    atom.write_text('<feed><entry><title>8-K - Acme Corp (0000320193) (Filer)</title><summary>&lt;b&gt;AccNo:&lt;/b&gt; 0000320193-26-000001 &lt;b&gt;Size:&lt;/b&gt; 1</summary><updated>2026-01-02T00:00:00Z</updated><link href="https://f.example/1"/></entry><entry><title>odd</title></entry></feed>')
    rows = sorted(tuple(r) for r in feeds.atom_filings(spark, str(atom)).select("form_type", "cik", "accession_number", "link", "company_name").collect())
    assert rows == [("", None, None, "", "odd"), ("8-K", "0000320193", "0000320193-26-000001", "https://f.example/1", "Acme Corp (0000320193) (Filer)")]
    body = json.dumps({"articles": [{"url": " https://a.example/x ", "title": "T", "seendate": "20260102T030405Z"}, {"url": ""}]})
    df = spark.createDataFrame([(body,), ("broken",), (None,)], "b string")
    assert [(r["url"], r["title"]) for r in feeds.listed_articles(df, "b").collect()] == [("https://a.example/x", "T")]
    gkg = lambda url, theme: "\t".join(["0", "20260102", "2", "d.example", url, "5", "6", theme, "8"])
    lines = spark.createDataFrame([(gkg("https://d.example/big-rate-cut.html", "ECON_X;Y"),), (gkg("https://d.example/rates-fall-again/", "INFLATION"),), (gkg("https://d.example/no", "SPORT"),), (gkg("", "ECON_"),), ("a\tb",), (None,)], "value string")
    assert {r["url"]: r["title"] for r in feeds.graph_rows(lines).collect()} == {"https://d.example/big-rate-cut.html": "Big rate", "https://d.example/rates-fall-again/": "Rates fall again"}


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else f"é{i}") for i in range(50)], "id long, t string")
    path = str(tmp_path / "snap")
    assert snapshot.export(df, path, "id")["rows"] == 50
    assert sorted(map(tuple, snapshot.load(spark, path, "id long, t string").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        snapshot.export(df, path, "id")
    part = next((tmp_path / "snap/data").glob("part-*"))
    (part.parent / f".{part.name}.crc").unlink()  # the local file system's own check
    part.write_text(part.read_text() + "{}\n")
    with pytest.raises(ValueError):
        snapshot.load(spark, path, "id long, t string")
    twice = str(tmp_path / "twice")
    snapshot.export(df.union(df.limit(1)), twice, "id")
    with pytest.raises(ValueError):
        snapshot.load(spark, twice, "id long, t string")


def test_version_hash(spark):
    rows = ['{"b": 1, "a": "é", "source_time": "2026-01-02T03:00:00+01:00"}', '{"a":"é","source_time":"2026-01-02T02:00:00Z","b":1}', '{"a": NaN}', "[1]", "x", None]
    got = [r["h"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", snapshot.version_hash(F.col("x")).alias("h")).orderBy("i").collect()]
    import hashlib

    assert got[0] == got[1] == hashlib.sha256('{"a":"é","b":1,"source_time":"2026-01-02T02:00:00+00:00"}'.encode()).hexdigest() and got[2:] == [None] * 4


def test_label_sheet_and_backup(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "quoted", title\nwith a break', None, "kept out"), ("2", None, "RSS", "x")], "id string, title string, source string, notes string")
    sinks.write_label_sheet(df, str(tmp_path / "sheet"))
    (part,) = (tmp_path / "sheet").glob("part-*.csv")
    raw = part.read_bytes()
    assert raw.startswith("\ufeffid,source,title".encode())
    rows = {r["id"]: r for r in csv.DictReader(io.StringIO(raw.decode("utf-8-sig"), newline=""))}
    assert list(rows["1"]) == sinks.SHEET and rows["1"]["title"] == 'a "quoted", title\nwith a break' and rows["1"]["notes"] == "" and rows["2"]["source"] == "RSS"
    df.write.parquet(str(tmp_path / "t"))
    sinks.back_up(str(tmp_path / "t"), str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 2
    with pytest.raises(ValueError):
        sinks.back_up(str(tmp_path / "t"), str(tmp_path / "copy"))
