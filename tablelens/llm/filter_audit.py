"""Filter interaction audit: what each filter removes in every order, per part of the corpus and by label.

A document's failures are a few bits.  They make it a *truth-table word* of
``2 ** filters`` bits (32 for five filters): bit s is set if the document survives
the subset s of filters, that is fails none of them.  Adding up words bit by bit
(a positional popcount) gives the survivors of every subset at once, and all
figures of all orders follow from those 32 numbers: what is left after some
steps of an order is what survives the set of these filters.

The popcount uses carry-save adders: eight words are added into one word of
ones, twos, fours and eights each, and only the eights are taken apart into
counters.  A task holds 32 counters per part and label and hands them on as one
row; rows are added up over the corpus.

The exact-copy filter asks whether a smaller id holds the same text anywhere in
the table, removed or not.  Texts meet by their SHA-256; the smallest id of a
text is taken in a grouping that adds up before it shuffles, and joined back,
which splits copies of one text that are too many for a task.

Edge cases: a NULL or empty text has no words (it fails the first filter, and
copies of it fail the last); a NULL ``source`` is the part with the empty name; a
NULL id is larger than every other and has no label; rows that share the
smallest id of a text do not fail as copies; several labels of one id count
if any of them is 1; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut, map_batches, store

FILTERS = "ABCDE"
COPIES = "E"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))

#: Labels of a document as two bits: good, toxic.
GOOD, TOXIC = 1, 2

#: A task passes its counters on when it holds so many parts and labels.
HELD_COUNTERS = 20_000


def failures(raw: bytes) -> int:
    """The bits of the filters A to D that a text (UTF-8) fails."""
    words = raw.split()  # on exactly the six ASCII blanks
    n_chars = len(raw) - _count(raw, _CONTINUED)
    return ((len(words) < MIN_WORDS) << 0
            | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
            | (100 * _count(raw, CAPITALS) > MAX_CAPITALS_PERCENT * n_chars) << 2
            | (_count(raw, SYMBOLS) > 0) << 3)


_CONTINUED = bytes(range(0x80, 0xC0))


def _count(raw: bytes, letters: bytes) -> int:
    return len(raw) - len(raw.translate(None, letters))


def truth_word(failed: int, n: int = len(FILTERS)) -> int:
    """The word whose bit s is set if a document with these failed filters survives all filters of subset s."""
    return sum(1 << s for s in range(1 << n) if not s & failed)


def popcounts(words: np.ndarray, bits: int = 1 << len(FILTERS)) -> np.ndarray:
    """How many of the words (unsigned integers) have each bit set, by carry-save addition of eight words a step."""
    lanes = 256  # words added side by side
    total = np.zeros(bits, np.int64)
    whole = len(words) // (8 * lanes) * 8 * lanes
    ones = twos = fours = np.zeros(lanes, words.dtype)
    eights = []
    for block in words[:whole].reshape(-1, 8, lanes):
        ones, two_a = _carry_save(ones, block[0], block[1])
        ones, two_b = _carry_save(ones, block[2], block[3])
        twos, four_a = _carry_save(twos, two_a, two_b)
        ones, two_a = _carry_save(ones, block[4], block[5])
        ones, two_b = _carry_save(ones, block[6], block[7])
        twos, four_b = _carry_save(twos, two_a, two_b)
        fours, eight = _carry_save(fours, four_a, four_b)
        eights.append(eight)
    rest = [(8, np.concatenate(eights))] if eights else []
    for weight, part in [*rest, (4, fours), (2, twos), (1, ones), (1, words[whole:])]:
        for b in range(bits):
            total[b] += weight * int(np.count_nonzero(part & words.dtype.type(1 << b)))
    return total


def _carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum bits and carry bits of three words, position by position."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        failed, prints = [], []
        for raw in column_bytes(batch.column(2)):
            failed.append(failures(raw))
            prints.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(failed, pa.int32()),
                                          pa.array(prints, pa.binary())], ["doc_id", "part", "failed", "print"])


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part and failed (bits of the failed filters, A lowest) of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    marked = store(map_batches(rows, _marked, "doc_id long, part string, failed int, print binary"))
    first = marked.groupBy("print").agg(F.min("doc_id").alias("first"))
    copies = 1 << FILTERS.index(COPIES)
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    return marked.join(first, "print").select(
        "doc_id", "part", F.when(later, F.col("failed").bitwiseOR(F.lit(copies))).otherwise(F.col("failed")).alias("failed"))


def _counted(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """part, label, failed per document to part, label and the survivors of every subset: words made, words added."""
    table = np.array([truth_word(f, n) for f in range(1 << n)], dtype=np.uint32)
    held: dict[tuple[str, int], np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        keys, sums = list(held), list(held.values())
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in keys], pa.string()), pa.array([x for _, x in keys], pa.int32()),
             pa.array([s.tolist() for s in sums], pa.list_(pa.int64()))], ["part", "label", "survivors"])

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        names = parts.dictionary.to_pylist()
        group = parts.indices.to_numpy().astype(np.int64) * 4 + batch.column(1).to_numpy()
        words = table[batch.column(2).to_numpy()]
        order = np.argsort(group, kind="stable")
        found, starts = np.unique(group[order], return_index=True)
        for g, own in zip(found.tolist(), np.split(words[order], starts[1:])):
            key = (names[g // 4], g % 4)
            held[key] = held.get(key, 0) + popcounts(own, 1 << n)
        if len(held) >= HELD_COUNTERS:
            yield flush()
    yield flush()


def survivors(rows: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """part and, for all, good and toxic documents, the survivors of every subset of filters (arrays by subset).

    ``rows`` holds part, label (bits GOOD and TOXIC) and failed, one row a document.
    """
    counted = map_batches(rows.select("part", "label", "failed"), lambda b: _counted(b, n),
                          "part string, label int, survivors array<long>")

    def added(kept: Column) -> Column:
        return F.array(*[F.sum(F.when(kept, F.col("survivors")[s]).otherwise(F.lit(0))).cast("long")
                         for s in range(1 << n)])

    return counted.groupBy("part").agg(
        added(F.lit(True)).alias("all"), added(F.col("label").bitwiseAND(F.lit(GOOD)) > 0).alias("good"),
        added(F.col("label").bitwiseAND(F.lit(TOXIC)) > 0).alias("toxic"))


def _orders(filters: str) -> Column:
    """Every step of every order: the subset before it, the filter, the subset after it."""
    steps = []
    for order in permutations(filters):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << filters.index(f)
            steps.append(("".join(order), k + 1, before, bit))
            before |= bit
    return F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{k},"before":{s},"bit":{b}}}'
                                            for o, k, s, b in steps) + "]"),
                       "array<struct<filter_order:string,step:int,before:int,bit:int>>")


def _shapley(filters: str) -> Column:
    """By filter: what it removes, added up over all orders."""
    n = len(filters)
    sums = []
    for f in range(n):
        others = [i for i in range(n) if i != f]
        total = F.lit(0).cast("long")
        for size in range(n):
            orders = math.factorial(size) * math.factorial(n - 1 - size)
            for chosen in combinations(others, size):
                s = sum(1 << i for i in chosen)
                total = total + orders * (F.col("all")[s] - F.col("all")[s | 1 << f])
        sums.append(total)
    return F.map_from_arrays(F.array(*[F.lit(1 << f) for f in range(n)]), F.array(*sums))


def report(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step from the survivors of every subset."""
    full = (1 << len(filters)) - 1

    def at(column: str, subset: Column) -> Column:
        return F.element_at(column, subset + 1)

    bit, before = F.col("s.bit"), F.col("s.before")
    after, others = before.bitwiseOR(bit), F.lit(full) - bit
    removed = {c: at(c, before) - at(c, after) for c in ("all", "good", "toxic")}
    return (counts.withColumn("shares", _shapley(filters)).withColumn("s", F.explode(_orders(filters)))
            .select("part", "s.filter_order", "s.step", at("all", after).alias("kept"), removed["all"].alias("removed"),
                    (at("all", F.lit(0)) - at("all", bit) - removed["all"]).alias("redundant"),
                    (at("all", others) - at("all", F.lit(full))).alias("unique_fails"),
                    removed["good"].alias("good_lost"), removed["toxic"].alias("toxic_lost"),
                    F.element_at("shares", bit).alias("shapley")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs`` (doc_id, text, source) and ``labels`` (doc_id, quality, toxic)."""
    flag: Callable[[str, int], Column] = lambda c, bit: F.max(F.when(F.col(c) == 1, F.lit(bit)).otherwise(F.lit(0)))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        flag("quality", GOOD).alias("good"), flag("toxic", TOXIC).alias("toxic"))
    rows = judged(docs).join(known, "doc_id", "left").select(
        "part", (F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))).cast("int").alias("label"), "failed")
    return report(cut(survivors(rows)))


def audit_sql() -> str:
    """The same audit in DuckDB SQL over the views documents and labels."""
    return r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals,
         min(doc_id) OVER (PARTITION BY t) AS first_id FROM docs),
known AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
bits AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 50)::INT AS fa, (100 * len(list_distinct(w)) < 65 * len(w))::INT AS fb,
         (100 * capitals > 5 * length(t))::INT AS fc, regexp_matches(t, '[#$%&*|]')::INT AS fd,
         coalesce(words.doc_id > first_id, first_id IS NOT NULL)::INT AS fe
  FROM words LEFT JOIN known ON words.doc_id = known.doc_id),
groups AS (
  SELECT part, [fa, fb, fc, fd, fe] AS f, good, toxic, count(*) AS n FROM bits GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, k::INT AS k, o[k] AS x FROM orders, (SELECT unnest(range(1, 6)) AS k)),
met AS (
  SELECT part, o, k, x, n, good, toxic, f[ascii(x) - 64] AS own,
         greatest(f[1] * (instr(o, 'A') < k)::INT, f[2] * (instr(o, 'B') < k)::INT, f[3] * (instr(o, 'C') < k)::INT,
                  f[4] * (instr(o, 'D') < k)::INT, f[5] * (instr(o, 'E') < k)::INT) AS earlier, list_sum(f) AS fails
  FROM groups, steps),
sums AS (
  SELECT part, o, k, x,
         sum(n * (own = 0 AND earlier = 0)::INT) AS kept,
         sum(n * (own = 1 AND earlier = 0)::INT) AS removed,
         sum(n * (own = 1 AND earlier = 1)::INT) AS redundant,
         sum(n * (own = 1 AND fails = 1)::INT) AS unique_fails,
         sum(n * good * (own = 1 AND earlier = 0)::INT) AS good_lost,
         sum(n * toxic * (own = 1 AND earlier = 0)::INT) AS toxic_lost
  FROM met GROUP BY part, o, k, x)
SELECT part, o AS filter_order, k AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM sums
"""
