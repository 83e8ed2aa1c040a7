"""Frozen snapshots: canonical JSON lines in total order, a manifest with hashes, never overwritten; checked when read.

Lines are sorted by range partition and written as ordered parts; the manifest holds each part's SHA-256, so neither
writing nor checking passes all rows through one task.

Defined results: an existing snapshot is refused; a changed, missing or additional part, a wrong row count or a repeated
identifier fails the read; null fields are written as null; an empty table makes an empty snapshot.
"""
import hashlib
import json
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import get_json, put_json


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def version_hash(body: Column) -> Column:
    """SHA-256 of the canonical form of a JSON object; source_time counts as its UTC instant. Null where it is no object."""

    @F.pandas_udf("string")
    def digest(bodies: pd.Series) -> pd.Series:
        def one(text):
            try:
                value = dict(json.loads(text, parse_constant=lambda _: 1 / 0))
                if value.get("source_time"):
                    value["source_time"] = datetime.fromisoformat(value["source_time"]).astimezone(timezone.utc).isoformat()
                return hashlib.sha256(canonical_json(value).encode()).hexdigest()
            except (ValueError, TypeError, ZeroDivisionError, AttributeError):
                return None

        return bodies.map(one)

    return digest(body)


def part_hashes(spark: SparkSession, path: str) -> dict[str, str]:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return {r["name"]: r["sha"] for r in files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")).collect()}  # one row per part


def export(df: DataFrame, path: str, ident: str, *order: str) -> dict:
    if get_json(f"{path}/manifest.json") is not None:
        raise ValueError("a snapshot is never overwritten")
    lines = df.repartitionByRange(*(order or (ident,))).sortWithinPartitions(*(order or (ident,))).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("errorifexists").text(f"{path}/data")
    manifest = {"rows": df.sparkSession.read.text(f"{path}/data").count(), "ident": ident, "parts": part_hashes(df.sparkSession, f"{path}/data")}
    put_json(f"{path}/manifest.json", manifest)
    return manifest


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    manifest = get_json(f"{path}/manifest.json")
    if manifest is None:
        raise ValueError("no snapshot here")
    if part_hashes(spark, f"{path}/data") != manifest["parts"]:
        raise ValueError("parts differ from the manifest")
    df = spark.read.schema(schema).json(f"{path}/data")
    n = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(manifest["ident"]).alias("d")).first()
    if n["n"] != manifest["rows"] or n["d"] != manifest["rows"]:
        raise ValueError("row count or identifiers differ from the manifest")
    return df
