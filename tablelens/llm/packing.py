"""Best-fit packing of documents into sequences of bounded length.

Tokenising cuts each document into pieces of at most ``capacity`` tokens (the
end-of-text id included).  Packing then proceeds in supersteps: documents and
gaps are in order of size, every document looks for its successor among the
gaps (the smallest that holds it), documents that want the same gap are served
by rank, gaps shrink, and what found no gap opens new sequences.

Sizes are whole numbers up to ``capacity``, so pieces of one size are
interchangeable and the order by size is a counting sort: the state of a
superstep is a table of document runs (size, count) and of gap runs (size,
first sequence, count) with at most ``capacity`` document runs whatever the
corpus.  Only these runs come to the driver.  Which piece of a size takes
which place is decided on the executors by its rank among its equals: its rank
within its partition plus the pieces of that size in earlier partitions.

Edge cases: a NULL or empty text is one piece that holds only the end id;
repeated rows are packed each for itself; NULL ids stay NULL; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, cut, doc_columns, map_batches
from .tokens import forget, word_ids

CAPACITY = 4096
END_ID = 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens, with their rank among the partition's pieces of the same length.

    ``with_ids`` adds the token ids of each piece.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(tokenizer), end_id.to_bytes(4, "little")
        part, seen, width = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            ids: list[np.ndarray] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), encoder.encode_many([*column_bytes(batch.column(1))])):
                raw += end
                for k, at in enumerate(range(0, len(raw), width)):
                    own = raw[at:at + width]
                    n = len(own) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(own), part, int(seen[n])))
                    seen[n] += 1
                    if with_ids:
                        ids.append(np.frombuffer(own, dtype="<i4"))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)]
            names = [f.split()[0] for f in PIECES.split(", ")]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        forget()  # the worker goes on to other stages

    return map_batches(doc_columns(docs, "doc_id", "text"), run, schema)


@dataclass(frozen=True)
class Match:
    """Pieces ranked from ``first`` to before ``last`` among those of ``length`` tokens.

    They fill sequences from ``sequence`` on, ``each`` to a sequence, starting
    at ``offset`` in it.
    """

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


class Gaps:
    """Runs of sequences with equal room left, in order of that room."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self._sizes: list[int] = []
        self._runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, size: int, sequence: int, count: int) -> None:
        if size and count:
            if size not in self._runs:
                bisect.insort(self._sizes, size)
                self._runs[size] = []
            self._runs[size].append((sequence, count))

    def successor(self, length: int, wanted: int) -> tuple[int, int, int]:
        """Take up to ``wanted`` of the smallest gaps that hold ``length``: (size, first sequence, count).

        New sequences are opened where no gap does.
        """
        at = bisect.bisect_left(self._sizes, length)
        if at == len(self._sizes):
            self.sequences += wanted
            return self.capacity, self.sequences - wanted, wanted
        size = self._sizes[at]
        sequence, count = self._runs[size].pop()
        if count > wanted:
            self._runs[size].append((sequence + wanted, count - wanted))
            count = wanted
        if not self._runs[size]:
            del self._runs[size], self._sizes[at]
        return size, sequence, count


def match(lengths: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Match], int]:
    """Best fit over document runs (length -> count), longest first: the matches and the number of sequences.

    A run of equal documents fills a gap until no further one of it fits, as
    best fit one by one would.
    """
    gaps, found = Gaps(capacity), []
    for length in sorted(lengths, reverse=True):
        first, left = 0, lengths[length]
        while left:
            # all gaps taken at once hold equally many; the last one may take fewer
            size, sequence, count = gaps.successor(length, 1 if left < capacity // length else left)
            each = min(size // length, left)
            used = min(count, left // each)
            found.append(Match(length, first, first + used * each, sequence, each, capacity - size))
            gaps.add(size - each * length, sequence, used)
            if size == capacity and sequence + count == gaps.sequences:
                gaps.sequences -= count - used  # opened but not needed
            else:
                gaps.add(size, sequence + used, count - used)
            first, left = first + used * each, left - used * each
    return found, gaps.sequences


def place(pieced: DataFrame, matches: list[Match]) -> DataFrame:
    """sequence_id and offset of every piece, from its rank among the pieces of its length."""
    key = np.array([m.length << 44 | m.first for m in matches], dtype=np.int64)
    order = np.argsort(key)
    key = key[order]
    table = np.array([(m.first, m.sequence, m.each, m.offset) for m in matches], dtype=np.int64).reshape(-1, 4)[order]

    counts = pieced.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieced.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            first, sequence, each, offset = table[np.searchsorted(key, length << 44 | rank, side="right") - 1].T
            k = rank - first
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence + k // each), pa.array(offset + k % each * length)],
                names=[*b.schema.names[:5], "sequence_id", "offset"])

    return map_batches(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenised once; the pieces (numbers only) are checkpointed, which
    also fixes the partition and rank each piece was given.
    """
    pieced = cut(pieces(docs, tokenizer, capacity, end_id))
    lengths = {r["length"]: r["n"] for r in
               pieced.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    return place(pieced, match(lengths, capacity)[0])


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, capacity: int = CAPACITY,
              end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array<int>).

    Document ids must be unique here, since pieces are found by them.
    """
    own = pieces(docs, tokenizer, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids")
    placed = packed.select("doc_id", "piece", "sequence_id", "offset").join(own, ["doc_id", "piece"])
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most ``capacity`` ids
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))
