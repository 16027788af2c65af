"""Removal of repeated byte strings over the whole corpus, keeping the first copy.

A byte goes if a string of ``length`` bytes that covers it also starts
earlier.  In suffix-array terms: the longest previous factor (LPF) at a start
is the longest match with a suffix that starts earlier, found at the previous
or next smaller position in suffix order; every start with LPF >= length
removes its ``length`` bytes.  Only that threshold matters, so suffixes are
ordered by their first ``length`` bytes and ties by position.  The previous
smaller position of a suffix is then its predecessor in the tie, if it has
one, and no smaller position follows within the tie.

The order is built in three steps, none of which gathers the corpus.

1. Suffixes are dealt to buckets so that equal first ``length`` bytes always
   meet: the bucket is the least hash of the ``GRAM``-byte strings in those
   bytes.  Neighbouring starts mostly share that least hash; such a run of
   starts is handled as one row with a fingerprint of the bytes it spans.
2. Within a bucket, sorted by fingerprint and position, runs that equal an
   earlier run have an equal suffix before each of theirs: all their starts
   are removed.  Buckets with a single fingerprint are thereby done.
3. The first run of each fingerprint in the other buckets comes with its
   bytes.  A suffix array by prefix doubling, cut off at ``length`` bytes,
   ranks their suffixes, and starts with a predecessor in their tie are
   removed.  Buckets with over ``HOT_RUNS`` different runs are dealt further,
   one row per start with the hash of its own bytes.

Positions are (document id, 64-bit text hash, start).  Rows that share an id
and a text get the same result, and a start is not earlier than itself; rows
that share only the id, or have none, are documents of their own, in the order
of their hashes.  A NULL id comes after all others, like the largest long.  A
NULL text is empty; texts under ``length`` bytes lose nothing; an empty table
gives an empty result; other columns are ignored by ``repeats`` and kept by
``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, give_back, map_batches, ship, store

LENGTH = 100
GRAM = 24
HOT_RUNS = 20_000
#: Bytes worked on at once within a task.
BLOCK = 1 << 19

LAST_ID = (1 << 63) - 1
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)  # odd, so that products lose no bits

# One 64-bit value for a place: 1 bit covered, 30 bits starts - 1, 32 bits first start.
_COVERED = 1 << 62
_COUNT_AT = 32
_COUNT = (1 << 30) - 1
_START = (1 << 32) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _STEP
    return x ^ (x >> _U(29))


def _string_hashes(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hash of the strings of each length at every start, built by joining powers of two."""
    powers = {1: _mixed((data.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93))}

    def joined(a: np.ndarray, b: np.ndarray, skip: int) -> np.ndarray:
        n = len(b) - skip
        return _mixed(a[:n] * _U(0xA0761D6478BD642F) + b[skip:]) if n > 0 else a[:0]

    w = 1
    while 2 * w <= max(lengths):
        powers[2 * w] = joined(powers[w], powers[w], w)
        w *= 2
    out = []
    for length in lengths:
        found, done = None, 0
        for p in sorted(powers, reverse=True):
            if length & p:
                found = powers[p] if found is None else joined(found, powers[p], done)
                done += p
        out.append(found)
    return out


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value in each window of ``width``."""
    w = 1
    while 2 * w <= width:
        values = np.minimum(values[:-w], values[w:])
        w *= 2
    return np.minimum(values[:len(values) - (width - w)], values[width - w:]) if width > w else values


def start_runs(data: np.ndarray, valid: np.ndarray, length: int, gram: int):
    """Runs of valid starts that share their least hash: (bucket, fingerprint, first start, starts).

    ``valid`` flags the starts whose ``length`` bytes lie in one document.  A
    run ends where the least hash changes or its place leaves the window, so it
    has at most ``length - gram + 1`` starts and ``2 * length`` bytes.
    """
    grams, whole = _string_hashes(data, (gram, length))
    least = _window_least(grams, length - gram + 1)
    n = len(whole)
    turn = np.ones(n, dtype=bool)
    turn[1:] = (least[1:] != least[:-1]) | (grams[:n - 1] == least[:-1]) | ~valid[:n - 1]
    turn &= valid[:n]
    first = np.flatnonzero(turn)
    stop = np.append(np.flatnonzero(turn | ~valid[:n]), n)
    last = stop[np.searchsorted(stop, first, side="right")] - 1
    print_ = _mixed(whole[first] * _STEP + _mixed(whole[last] + (last - first).astype(_U)))
    return least[first].view(np.int64), print_.view(np.int64), first, last - first + 1


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """(bytes, valid starts, id of each start's document, its tag, its first byte's offset) of about BLOCK bytes.

    Documents longer than a block come in several, overlapping by ``length - 1``.
    """
    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for doc_id, raw, tag in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1)),
                                    batch.column(2).to_pylist()):
            if len(raw) < length:
                continue
            for at in range(0, len(raw) - length + 1, BLOCK):
                part = raw[at:at + BLOCK + length - 1]
                held.append((LAST_ID if doc_id is None else doc_id, tag, at, part))
                size += len(part)
                if size >= BLOCK:
                    yield _block(held, length)
                    held, size = [], 0
    if held:
        yield _block(held, length)


def _block(held: list[tuple[int, int, int, bytes]], length: int) -> tuple:
    data = np.frombuffer(b"".join(h[3] for h in held), dtype=np.uint8)
    sizes = np.array([len(h[3]) for h in held])
    begins = np.cumsum(sizes) - sizes
    ids, tags, offsets = (np.array([h[i] for h in held], dtype=np.int64) for i in range(3))
    owner = np.repeat(np.arange(len(held)), sizes)
    valid = np.arange(len(data)) - begins[owner] <= sizes[owner] - length
    return data, valid, begins, owner, ids, tags, offsets


def _runs(length: int, gram: int) -> Callable:
    """Step 1: one row per run.  Within a block, runs equal to an earlier one are marked as covered at once.

    Marked rows need no bucket and are spread over all of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, valid, begins, owner, ids, tags, offsets in _blocks(batches, length):
            bucket, print_, first, count = start_runs(data, valid, length, gram)
            own = owner[first]
            doc, start = ids[own], first - begins[own] + offsets[own]
            tag = tags[own]
            place = (count - 1) << _COUNT_AT | start
            order = np.lexsort((start, tag, doc, print_, bucket))
            b, p, d, t, s = bucket[order], print_[order], doc[order], tag[order], start[order]
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (b[1:] != b[:-1]) | (p[1:] != p[:-1])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            later = order[(d != d[head]) | (t != t[head]) | (s != s[head])] if len(order) else order
            place[later] |= _COVERED
            bucket = bucket.copy()
            bucket[later] = _mixed(place[later].view(_U) + doc[later].view(_U)).view(np.int64)
            yield _batch(["bucket", "print", "id", "tag", "place"], bucket, print_, doc, tag, place)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2 over rows sorted by bucket, print and position; memory does not depend on the size of a bucket.

    Gives covered runs (kind 0), and (kind 1) the first run of every print in
    buckets that have several.
    """
    last = None  # bucket, print, id, tag and start of the first run with the last print
    waiting = None  # the only first run of the last bucket so far, not given out
    for batch in batches:
        bucket, print_, doc, tag, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        marked = place & _COVERED != 0
        covered = [(doc[marked], tag[marked], place[marked] & ~_COVERED)]
        bucket, print_, doc, tag, place = (x[~marked] for x in (bucket, print_, doc, tag, place))
        if not len(bucket):
            yield _batch(["kind", "bucket", "id", "tag", "place"], np.zeros(len(covered[0][0]), dtype=np.int8),
                         np.zeros(len(covered[0][0]), dtype=np.int64), *covered[0])
            continue
        start = place & _START
        fresh, opens = np.ones(len(bucket), dtype=bool), np.ones(len(bucket), dtype=bool)
        opens[1:] = bucket[1:] != bucket[:-1]
        fresh[1:] = opens[1:] | (print_[1:] != print_[:-1])
        if last is not None:
            opens[0] = bucket[0] != last[0]
            fresh[0] = opens[0] or print_[0] != last[1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(bucket)), -1))
        head_doc = np.where(head >= 0, doc[head], last[2] if last else 0)
        head_tag = np.where(head >= 0, tag[head], last[3] if last else 0)
        head_start = np.where(head >= 0, start[head], last[4] if last else 0)
        later = (doc != head_doc) | (tag != head_tag) | (start != head_start)  # the first is the least
        covered.append((doc[later], tag[later], place[later]))
        # first runs, and which of them are alone in their bucket
        at = np.flatnonzero(fresh)
        group = np.cumsum(opens)  # 0: the bucket that was open before
        sizes = np.bincount(group[at], minlength=group[-1] + 1)
        several = sizes >= 2
        several[0] = True  # it holds an earlier first run
        several[-1] |= group[-1] == 0
        chosen = at[several[group[at]]]
        given = [(bucket[chosen], doc[chosen], tag[chosen], place[chosen])]
        if waiting is not None:
            if sizes[0]:
                given.append(tuple(np.array([v]) for v in waiting))
                waiting = None
            elif group[-1] > 0:
                waiting = None  # its bucket ended with it alone
        if group[-1] > 0 and not several[-1]:
            i = at[group[at] == group[-1]][0]
            waiting = (bucket[i], doc[i], tag[i], place[i])
        last = (bucket[-1], print_[-1], head_doc[-1], head_tag[-1], head_start[-1])
        docs, tags, places = (np.concatenate(x) for x in zip(*covered))
        gb, gd, gt, gp = (np.concatenate(x) for x in zip(*given))
        yield _batch(["kind", "bucket", "id", "tag", "place"],
                     np.repeat(np.array([0, 1], dtype=np.int8), [len(docs), len(gb)]),
                     np.concatenate([np.zeros(len(docs), dtype=np.int64), gb]), np.concatenate([docs, gd]),
                     np.concatenate([tags, gt]), np.concatenate([places, gp]))


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix by its first ``length`` bytes; equal bytes, equal rank.

    Prefix doubling: ranks by w bytes of a start and of the start w further on
    give ranks by 2 w bytes.  Bytes past the end count as zero.
    """
    def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (right.max() + 1) + right, return_inverse=True)[1]

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([x[by:], np.zeros(min(by, len(x)), dtype=x.dtype)])

    rank, width = data.astype(np.uint64), 1
    while width < 8 and 2 * width <= length:  # up to eight packed bytes are their own order
        rank = rank << np.uint64(8 * width) | shifted(rank, width)
        width *= 2
    rank = np.unique(rank, return_inverse=True)[1]
    while 2 * width <= length:
        rank = ranked(rank, shifted(rank, width))
        width *= 2
    return ranked(rank, shifted(rank, length - width)) if width < length else rank


def _factor(length: int) -> Callable:
    """Step 3 over runs with their bytes, sorted by bucket: gives the starts with LPF >= length, as runs."""
    def removed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8)
        sizes = np.array([len(r[4]) for r in rows])
        counts = sizes - length + 1
        first = np.repeat(np.cumsum(sizes) - sizes, counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        doc = np.repeat(np.array([r[1] for r in rows], dtype=np.int64), counts)
        tag = np.repeat(np.array([r[2] for r in rows], dtype=np.int64), counts)
        place = np.array([r[3] for r in rows], dtype=np.int64)
        start = np.repeat(place & _START, counts) + inner
        rank = suffix_ranks(data, length)[first + inner]
        order = np.lexsort((start, tag, doc, rank))  # the suffix array, ties by position
        r, d, t, s = rank[order], doc[order], tag[order], start[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = r[1:] != r[:-1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        hit = np.zeros(len(order), dtype=bool)
        hit[order] = (d != d[head]) | (t != t[head]) | (s != s[head])  # a smaller position stands before it in its tie
        # neighbouring starts of one run that go together
        row = np.repeat(np.arange(len(rows)), counts)
        begins = hit & np.r_[True, ~hit[:-1] | (row[1:] != row[:-1])]
        ends = hit & np.r_[~hit[1:] | (row[1:] != row[:-1]), True]
        a, z = np.flatnonzero(begins), np.flatnonzero(ends)
        yield _batch(["id", "tag", "place"], doc[a], tag[a], (z - a) << _COUNT_AT | start[a])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK and row[0] != rows[-1][0]:
                    yield from removed(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield from removed(rows)

    return run


def _cut_runs(length: int) -> Callable:
    """The bytes of the first runs of a document: bucket, id, tag, place, bytes.

    Runs of hot buckets come start by start, under the hash of their own bytes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "id", "tag", "place", "bytes", "hot"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, tag, raw, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                               column_bytes(batch.column(2)), batch.column(3).to_pylist()):
                for r in found:
                    place = r["place"]
                    start, count = place & _START, (place >> _COUNT_AT & _COUNT) + 1
                    if not r["hot"]:
                        rows.append((r["bucket"], doc_id, tag, place, raw[start:start + count - 1 + length], False))
                        continue
                    for p in range(start, start + count):
                        own = raw[p:p + length]
                        key = xxhash.xxh64_intdigest(own, 7) - (1 << 63)
                        rows.append((key, doc_id, tag, p, xxhash.xxh64_digest(own, 8), True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=names)

    return run


def _position() -> Column:
    return F.col("place").bitwiseAND(F.lit(_START))


def _tag() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """id, bytes and tag of every row, and further columns."""
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), raw.alias("raw"), _tag().alias("tag"),
                       *columns)


def covered_starts(docs: DataFrame, keyed: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   hot_runs: int = HOT_RUNS) -> DataFrame:
    """(id, tag, place): runs of starts whose ``length`` bytes also start earlier."""
    rows = map_batches(docs.select("doc_id", "text", _tag().alias("tag")), _runs(length, gram),
                       "bucket long, print long, id long, tag long, place long")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "print", "id", "tag", _position())
    compared = store(map_batches(dealt, _compare, "kind byte, bucket long, id long, tag long, place long"))

    firsts = compared.filter("kind = 1").select("bucket", "id", "tag", "place")
    hot = firsts.groupBy("bucket").count().filter(F.col("count") > hot_runs).select("bucket", F.lit(True).alias("hot"))
    wanted = (firsts.join(hot, "bucket", "left")
              .select("id", "tag", F.struct("bucket", "place", F.coalesce("hot", F.lit(False)).alias("hot")).alias("run"))
              .groupBy("id", "tag").agg(F.collect_list("run").alias("runs")))  # of one document
    texts = map_batches(keyed.join(wanted, ["id", "tag"]).select("id", "tag", "raw", "runs"), _cut_runs(length),
                        "bucket long, id long, tag long, place long, bytes binary, hot boolean")
    near = map_batches(texts.filter(~F.col("hot")).select("bucket", "id", "tag", "place", "bytes")
                       .repartition("bucket").sortWithinPartitions("bucket"), _factor(length),
                       "id long, tag long, place long")
    # a start of a hot bucket goes if the smallest position with the same bytes is another one
    single = texts.filter("hot").select("bucket", "bytes", F.struct("id", "tag", _position().alias("p")).alias("at"),
                                        "place")
    least = single.groupBy("bucket", "bytes").agg(F.min("at").alias("least"))
    far = (single.join(least, ["bucket", "bytes"]).filter(F.col("at") > F.col("least"))
           .select(F.col("at.id").alias("id"), F.col("at.tag").alias("tag"), "place"))
    return compared.filter("kind = 0").select("id", "tag", "place").unionByName(near).unionByName(far)


def removed_mask(size: int, places: list[int], length: int) -> np.ndarray:
    """Which of ``size`` bytes are covered by the given runs of starts."""
    edge = np.zeros(size + 1, dtype=np.int64)
    if places:
        p = np.array(places, dtype=np.int64)
        start = p & _START
        np.add.at(edge, start, 1)
        np.add.at(edge, start + (p >> _COUNT_AT & _COUNT) + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _places(docs: DataFrame, length: int, gram: int, hot_runs: int, *columns: Column) -> DataFrame:
    """id, raw, further columns and the places to remove (NULL: none) of every row."""
    ship(docs.sparkSession)
    found = (covered_starts(docs, _keyed(docs), length, gram, hot_runs)
             .groupBy("id", "tag").agg(F.collect_list("place").alias("places")))
    return _keyed(docs, *columns).join(found, ["id", "tag"], "left")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, raw, places in zip(b.column(0).to_pylist(), column_bytes(b.column(1)),
                                           b.column(2).to_pylist()):  # the id as it came
                mask = removed_mask(len(raw), places or [], length)
                spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
                kept = np.frombuffer(raw, dtype=np.uint8)[~mask].tobytes()
                rows.append((doc_id, len(raw), len(raw) - len(kept), spans,
                             hashlib.sha256(kept).hexdigest()))
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _places(docs, length, gram, hot_runs, F.col("doc_id").alias("own"))
    return map_batches(found.select("own", "raw", "places"), run,
                       "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without(raw: bytes, places: list[int], length: int) -> str:
    """The text that is left; a character goes if any byte of it goes."""
    mask = removed_mask(len(raw), places, length)
    data = np.frombuffer(raw, dtype=np.uint8)
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(begins):
        return ""
    gone = np.logical_or.reduceat(mask, begins)
    return data[~np.repeat(gone, np.diff(np.append(begins, len(data))))].tobytes().decode()


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """The rows of ``docs`` with later copies cut out of ``text`` (NULL stays NULL), other columns as they are."""
    def left(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raws, places in batches:
            yield pd.Series([raw.decode() if p is None else without(raw, list(p), length)
                             for raw, p in zip(raws, places)], dtype=object)
        give_back()

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    cut_text = F.pandas_udf(left, "string")
    found = _places(docs, length, gram, hot_runs, row, F.col("text").isNull().alias("absent"))
    columns = [F.when(F.col("absent"), F.lit(None)).otherwise(cut_text("raw", "places")).alias("text") if c == "text"
               else F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.select(*columns)
