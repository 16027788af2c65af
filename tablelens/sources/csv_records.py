"""Records of CSV files whose quoted fields may hold line breaks, without giving up splits.

Whether a line break ends a record depends on whether it lies inside quotes, and
that on everything before it in the file.  But what a split does to that state
is a function with two arguments, outside and inside, and such functions can be
composed: one pass finds the function of every split, a prefix composition over
the splits of each file (one small row per split) tells in which state each
begins, and a second pass cuts all splits into records independently.
Records that reach over the end of a split are put together from their pieces.

A quote opens a field only at its beginning; a doubled quote inside a quoted field
stands for one.  ``\\r\\n`` ends a record like ``\\n``; inside quotes both are
kept as they are.  Empty lines outside quotes are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A split becomes one small row on the driver; more splits than this need larger ones.
MAX_SPLITS = 2_000_000

_BODY = re.compile('(?:[^"]|"")*')


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether the end of ``line`` lies inside a quoted field, given whether its beginning does."""
    at = 0
    if not inside and line.startswith('"'):
        inside, at = True, 1
    while True:
        if inside:
            at = _BODY.match(line, at).end() + 1
            if at > len(line):
                return True
        at = line.find(sep, at) + 1
        if not at:
            return False
        inside = line.startswith('"', at)
        at += inside


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files below ``path`` in order within each split."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")))


def _functions(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """Per split: its state at the end when begun outside and inside, whether it leaves a field it begins
    inside of, and whether a line of it ends inside when begun outside."""
    now, states = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [now[0]], "split": [now[1]], "outside": [states[0]],
                                           "inside": [states[1]], "leaves": [states[2]], "breaks": [states[3]]})

    for batch in batches:
        for line, file, split in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (file, split):
                if now:
                    yield row()
                now, states = (file, split), [False, True, False, False]
            a, b = inside_after(line, states[0], sep), inside_after(line, states[1], sep)
            states = [a, b, states[2] or not b, states[3] or a]
    if now:
        yield row()


def open_splits(spark: SparkSession, path: str, sep: str) -> dict[tuple[str, int], int] | None:
    """The splits that begin inside a quoted field, with the split in which its record begins.

    None if no record below ``path`` reaches over a line break.  Only lines with a
    quote are looked at.
    """
    quoted = _lines(spark, path).where(F.contains("value", F.lit('"')))
    found = quoted.mapInArrow(lambda b: _functions(b, sep),
                              "file string, split long, outside boolean, inside boolean, leaves boolean, breaks boolean")
    rows = found.limit(MAX_SPLITS + 1).collect()
    if len(rows) > MAX_SPLITS:
        raise ValueError(f"over {MAX_SPLITS} splits: raise spark.sql.files.maxPartitionBytes")
    changes = {(r["file"], r["split"]): r for r in rows}
    if not any(r["breaks"] for r in rows):
        return None
    # splits without any quote keep their state; which they are, only their place in the file tells
    out: dict[tuple[str, int], int] = {}
    splits = _lines(spark, path).select("file", "split").distinct().limit(MAX_SPLITS + 1).collect()
    if len(splits) > MAX_SPLITS:
        raise ValueError(f"over {MAX_SPLITS} splits: raise spark.sql.files.maxPartitionBytes")
    inside, file, opened = False, None, 0
    for key in sorted((r["file"], r["split"]) for r in splits):
        if key[0] != file:
            file, inside = key[0], False
        if inside:
            out[key] = opened
        r = changes.get(key)
        if r is not None:
            if not inside or r["leaves"]:
                opened = key[1]
            inside = r["inside"] if inside else r["outside"]
    return out


def _cut(batches: Iterator[pa.RecordBatch], opened: dict[tuple[str, int], int], sep: str) -> Iterator[pa.RecordBatch]:
    """Lines to records and pieces: file, split, begins (split in which the record begins), ends, first, text."""
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("begins", pa.int64()), ("ends", pa.bool_()),
                        ("first", pa.bool_()), ("text", pa.string())])
    now, held, begins, virgin = None, [], 0, False

    for batch in batches:
        out: list[tuple] = []
        has_quote = pc.match_substring(batch.column(0), '"').to_pylist()
        for line, file, split, quote in zip(*(c.to_pylist() for c in batch.columns), has_quote):
            if now != (file, split):
                if now and held:
                    out.append((*now, begins, False, virgin, "\n".join(held)))
                now, held, virgin = (file, split), [], split == 0
                inside = now in opened
                begins = opened.get(now, split)
                if virgin:
                    line = line.removeprefix("﻿")
            if not inside and not held and not line.rstrip("\r"):
                continue
            held.append(line)
            if quote:
                inside = inside_after(line, inside, sep)
            if not inside:
                out.append((file, split, begins, True, virgin, "\n".join(held).removesuffix("\r")))
                held, begins, virgin = [], split, False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if now and held:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
            (*now, begins, False, virgin, "\n".join(held)), schema)], schema=schema)


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame | None:
    """file, first (of its file) and text of every record below ``path``; None if no record holds a line break.

    A field that is still open at the end of a file is an error.  The files are read
    twice: for whole records and for the few pieces.
    """
    opened = open_splits(spark, path, sep)
    if opened is None:
        return None
    # one entry per split that begins inside a field, at most MAX_SPLITS of them
    cut = _lines(spark, path).mapInArrow(lambda b: _cut(b, opened, sep),
                                         "file string, split long, begins long, ends boolean, first boolean, text string")
    whole = cut.where("ends and begins = split").select("file", "first", "text")
    piece = F.struct("split", "ends", "text", "first")
    joined = (cut.where("not ends or begins <> split").groupBy("file", "begins").agg(F.array_sort(F.collect_list(piece)).alias("p"))
              .select("file", F.element_at("p", 1)["first"].alias("first"),
                      F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"),
                      F.element_at("p", -1)["ends"].alias("ends")))
    unclosed = F.raise_error(F.concat(F.lit("a quoted field is not closed in "), F.col("file"))).cast("string")
    return whole.unionByName(joined.select("file", "first", F.when(F.col("ends"), F.col("text")).otherwise(unclosed).alias("text")))
