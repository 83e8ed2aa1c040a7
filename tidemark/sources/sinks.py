"""Plain sinks: a label sheet for people, and a copy of a table before it is changed.

Defined results: null fields are empty cells; quotes, commas and line breaks are quoted; an existing target is never overwritten.
"""
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import open_fs

# The sheet's columns; the last three are for the reviewer.
SHEET = ["id", "source", "title", "content_snippet", "url", "published_time", "ingested_time", "schema_version", "flag", "label", "confidence", "notes"]


def label_sheet(df: DataFrame) -> DataFrame:
    """The sheet's twelve columns in order; what the table lacks is empty."""
    have = set(df.columns)
    return df.select(*[(F.col(c).cast("string") if c in have and c not in SHEET[-3:] else F.lit("")).alias(c) for c in SHEET])


def write_label_sheet(df: DataFrame, path: str) -> None:
    """CSV with a byte order mark, in one file: a sheet for a person is a bounded sample."""
    sheet = label_sheet(df).coalesce(1)
    marked = sheet.withColumnRenamed(SHEET[0], "\ufeff" + SHEET[0])
    marked.write.mode("errorifexists").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def back_up(path: str, target: str) -> None:
    """Copy a table's files before a migration."""
    (fs, source), (to_fs, to) = open_fs(path), open_fs(target)
    if to_fs.get_file_info(to).type != pafs.FileType.NotFound:
        raise ValueError("a backup is never overwritten")
    to_fs.create_dir(to, recursive=True)
    pafs.copy_files(source, to, source_filesystem=fs, destination_filesystem=to_fs)
