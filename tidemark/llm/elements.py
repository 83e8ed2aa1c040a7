"""Titles as element sets: the distinct words and distinct pairs of neighbouring words, as 64-bit hashes.

Elements are ordered by rarity (tidemark.operators.rarity). A title without a word has no elements and is alike to nothing.
"""
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.rarity import by_rarity, common_elements, least_count  # noqa: F401

THRESHOLD = 0.75


def elements(title: Column) -> Column:
    words = F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    count = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), count), F.slice(words, F.lit(2), count), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_sort(F.array_distinct(F.transform(F.concat(words, pairs), lambda x: F.xxhash64(x))))


def class_id(elems: Column) -> Column:
    """128 bits that name an element set."""
    return F.unhex(F.md5(F.array_join(F.transform(elems, lambda x: F.hex(x)), ",")))


def alike(a: frozenset, b: frozenset) -> bool:
    shared = len(a & b)
    return shared >= THRESHOLD * (len(a) + len(b) - shared) and shared > 0
