"""Near-duplicate groups by SimHash with meet-in-the-middle ball hashing.

Two fingerprints at distance r or less have a common point within half of r of
both.  Every distinct fingerprint therefore emits all variants within
``ceil(r / 2)`` bits; rows are shuffled on the variant, and the fingerprints
that meet there are candidates.  All of them lie in a ball around the variant,
so a variant never gathers more than the ball holds, however many documents
share a fingerprint.  Each candidate is paired with the smallest of its
variant, pairs are deduplicated and verified by their distance.  Where r is
odd the ball is one bit too wide, and a candidate may be too far from the
smallest one; all pairs of the ball are then compared.

Links between fingerprints are contracted to components, and documents take
the component of their fingerprint.

Edge cases: a NULL, empty or blank text has fingerprint zero, which links like
any other; one or two words are one shingle; repeated rows share a
fingerprint, so they are one group; rows with a NULL id get a fingerprint and
the smallest id of their group, NULL if it has none; an empty table gives an
empty result; other columns are ignored by ``near_duplicates`` and kept by
``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, cut, doc_columns, map_batches
from .graph import components

BITS = 64
SEED = 42
SHINGLE = 3
MAX_DISTANCE = 2


def shingle_hashes(raw: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``width`` lower-cased words, repeats included."""
    words = raw.lower().split()  # A-Z only, and the six ASCII blanks, since these are bytes
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map((1).__add__, map(len, words))))  # one past the blank after each word
    starts = [0, *ends]
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e - 1], SEED) for s, e in zip(starts[:n], last)), dtype=np.uint64, count=n)


def simhash(raw: bytes, width: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingle hashes."""
    h = shingle_hashes(raw, width)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at:at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (as a signed 64-bit value) and a hash of the text of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([simhash(raw, width) for raw in column_bytes(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64)), b.column(2)],
                                             names=["doc_id", "fp", "text_hash"])

    rows = doc_columns(docs, "doc_id", "text").withColumn("text_hash", _text_hash())
    return map_batches(rows, run, "doc_id long, fp long, text_hash long")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _masks(radius: int) -> list[int]:
    """Every 64-bit value with at most ``radius`` bits, as signed values."""
    masks = [sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(BITS), n)]
    return np.array(masks, dtype=np.uint64).view(np.int64).tolist()


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Verified links (u, v) that connect all fingerprints within ``max_distance`` of each other.

    ``distinct`` holds each fingerprint ``fp`` once.
    """
    ball = F.explode(F.array(*[F.lit(m) for m in _masks((max_distance + 1) // 2)]))
    variants = distinct.select("fp", ball.alias("mask")).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    if max_distance % 2 == 0:
        smallest = F.min("fp").over(Window.partitionBy("variant"))
        pairs = variants.withColumn("v", smallest).select(F.col("fp").alias("u"), "v")
    else:
        met = variants.groupBy("variant").agg(F.sort_array(F.collect_list("fp")).alias("met"))  # a ball at most
        pairs = (met.filter(F.size("met") > 1).select(F.posexplode("met").alias("i", "v"), "met")
                 .select("v", F.explode(F.slice("met", F.col("i") + 2, F.size("met"))).alias("u")))
    return pairs.filter(F.col("u") > F.col("v")).distinct().filter(_distance("u", "v") <= max_distance)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fp, text_hash, root (the group) and component_id (smallest id of the group) of every row."""
    prints = cut(fingerprints(docs, width))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), max_distance))
    grouped = (distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left")
               .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = grouped.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def keep_first(docs: DataFrame, width: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of each group of ``docs``: the one with the smallest id; rows without an id stay.

    Where several rows of a group share that id, one of them stays; rows that
    share an id but no group stand for a group each.
    """
    own = near_duplicates(docs, width, max_distance).filter(F.col("doc_id") == F.col("component_id"))
    one = own.groupBy("root").agg(F.min("doc_id").alias("_id"), F.min("text_hash").alias("_hash")).drop("root")
    row = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_id"), _text_hash().alias("_hash"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    nth = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.xxhash64("_row")))
    kept = row.join(one, ["_id", "_hash"]).withColumn("_n", nth).filter("_n = 1").select("_row.*")
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))
