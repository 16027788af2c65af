"""Approximate nearest neighbours by multi-probe p-stable hashing; nearness is the inner product.

Vectors are scaled by the largest norm and get one more coordinate that brings
them to the unit sphere, queries are brought to length one; the inner product
then falls as the Euclidean distance grows, which p-stable hashing works on.
A table hashes a vector to the cells of ``hashes`` Gaussian projections of
width ``WIDTH``.  A neighbour at distance r differs from the query by a normal
deviate of spread r in each projection, so the chance that it lies in a given
cell, and the product of these for a bucket, are known.  Each query visits the
buckets of each table in the order of that chance until they add up to the
success it needs of a table.  Buckets met are scored exactly, in blocks, and
the tables' best are merged.

The radius r is measured: the distance of the last wanted neighbour of a
bounded number of queries (``RADIUS_QUERIES``) against all rows.  It need not
hold for a query in a sparse region, so every query's result is looked at: one
with too few hits, or whose last wanted hit lies beyond the radius it was
probed with, is probed again with a radius of its own, at most twice the last
one.  Those that ``ROUNDS`` rounds or as many buckets as the table holds do not
settle are compared with all entries, in blocks.

Equal vectors are one entry with their smallest ids, which is all a result can hold.
Buckets of more than ``BLOCK`` entries are split into blocks that each probe
visits, as are their probes, so no group grows with the data.

Edge cases: vectors that are NULL, empty, zero, of another length than most,
or that hold NULL or non-finite components take no part, nor do rows without
an id; of rows that share an id the one with the least vector counts; fewer
candidates than asked for give all of them; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, ship

TOP = 20
TABLES = 4
WIDTH = 1.5
SUCCESS = 0.98
REACH = 2  # cells looked at on either side, by projection
#: Buckets of a table a query may visit in the first round, whatever the size of the table.
LISTED = 16_384
#: Entries aimed at in a bucket.  Handling a probe costs as much as scoring about this many entries, so smaller
#: buckets, and the many more probes they need, cost more than they save.
BUCKET = 2048
BLOCK = 4096
RADIUS_QUERIES = 64
#: Rounds of probing before a query is compared with all entries.
ROUNDS = 3
#: Queries of a block scored at once, and probes (each with its vector) handed on at once.
SLICE = 512
PROBES = 16_384
EVERY = 20

_FOUND = "query long, t int, block long, ids array<array<long>>, scores array<double>"
#: The table whose one bucket holds all entries.
_ALL = -1


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, vector): one row per id, with vectors that can be compared; components stay float, or become double."""
    kept = "array<float>" if dict(vectors.dtypes)[column] == "array<float>" else "array<double>"
    rows = (vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"),
                           F.col(f"`{column}`").cast(kept).alias("vector"))
            .filter(F.col("id").isNotNull() & F.col("vector").isNotNull()))
    v = F.col("vector")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.filter(finite & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (rows.filter(F.size("vector") == (lengths["n"] if lengths else 0))
            .groupBy("id").agg(F.min("vector").alias("vector")))


def entries(rows: DataFrame, top: int) -> DataFrame:
    """Distinct vectors: entry (their smallest id), their ``top + 1`` smallest ids, vector."""
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= top + 1)  # limited before the shuffle, too
    return few.groupBy("vector").agg(F.min("id").alias("entry"), F.sort_array(F.collect_list("id")).alias("ids")) \
        .select("entry", "ids", "vector")


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows, in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``q`` with those of ``v[i]``; the same for a pair wherever it is met."""
    return (q[:, None, :] * v).sum(axis=2)


def _best(q: np.ndarray, v: np.ndarray, entry: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``v`` nearest to each row of ``q`` (by score, then entry) and their scores."""
    n = min(top + 9, len(v))  # a few more, as rounding differs between block shapes
    near = np.argpartition(-(q @ v.T), n - 1, axis=1)[:, :n]
    scores = exact_scores(q, v[near])
    order = np.lexsort((entry[near], -scores), axis=1)[:, :top]
    return np.take_along_axis(near, order, axis=1), np.take_along_axis(scores, order, axis=1)


def exact(entry_rows: DataFrame, queries: list[list[float]], top: int) -> dict[int, list[float]]:
    """The ``top`` best scores of a few queries against all entries, best first."""
    q = np.array(queries, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                scores = -np.sort(-(q @ _matrix(b.column(0)).T), axis=1)[:, :top]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(q)), scores.shape[1])), pa.array(scores.ravel())],
                    names=["q", "score"])

    best = map_batches(entry_rows.select("vector"), run, "q long, score double")
    ranked = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"))))
    found: dict[int, list[float]] = {}
    for r in ranked.filter(F.col("n") <= top).orderBy("q", "n").collect():
        found.setdefault(r["q"], []).append(r["score"])
    return found


class Tables:
    """The projections of all tables and the bucket of a vector in each."""

    def __init__(self, dims: int, hashes: int, largest: float, radius: float, tables: int = TABLES,
                 success: float = SUCCESS, seed: int = 5, most: float = math.inf):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(tables, dims + 1, hashes))
        self.offsets = rng.uniform(0, WIDTH, size=(tables, 1, hashes))
        self.largest, self.radius, self.wanted = largest, radius, 1 - (1 - success) ** (1 / tables)
        self.names = rng.integers(1, 1 << 31, size=hashes) * 2 + 1
        self.most = most  # buckets of a table that a query probed again may visit

    def _projected(self, table: int, x: np.ndarray) -> np.ndarray:
        return (x @ self.directions[table] + self.offsets[table]) / WIDTH

    def _name(self, cells: np.ndarray) -> np.ndarray:
        return (cells.astype(np.int64) * self.names).sum(axis=-1)

    def _likely(self, chance: np.ndarray, cells: np.ndarray, most: float) -> np.ndarray | None:
        """Names of the buckets of one query by falling chance, until they add up to the success wanted.

        ``chance`` and ``cells`` are by projection and step.  A part of a bucket
        is followed up only where its best completion reaches a floor, so all
        buckets above the floor are listed and few others are looked at; the
        floor falls until the list holds enough.  None if that takes more than
        ``most`` buckets or the cells in reach do not add up.
        """
        best_rest = np.append(np.cumprod(chance.max(axis=1)[::-1])[::-1][1:], 1.0)
        floor = float(chance.max(axis=1).prod()) / 8
        while chance.sum(axis=1).prod() >= self.wanted - 1e-9:
            joint, name, whole = np.ones(1), np.zeros(1, dtype=np.int64), True
            for p, c, rest, factor in zip(chance, cells, best_rest, self.names):
                joint = np.outer(joint, p).ravel()
                name = (name[:, None] + c.astype(np.int64) * factor).ravel()
                above = joint * rest >= floor
                if not above.all():
                    joint, name, whole = joint[above], name[above], False
            order = np.argsort(-joint, kind="stable")
            n = int(np.searchsorted(np.cumsum(joint[order]), self.wanted)) + 1
            if n <= len(order):
                return name[order[:n]] if n <= most else None
            if whole or len(order) > most:
                return None
            floor /= 8
        return None

    def placed(self, v: np.ndarray) -> np.ndarray:
        x = v / self.largest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    @staticmethod
    def asked(q: np.ndarray) -> np.ndarray:
        return np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1)

    def buckets(self, table: int, v: np.ndarray) -> np.ndarray:
        return self._name(np.floor(self._projected(table, self.placed(v))))

    def probes(self, table: int, q: np.ndarray, radius: np.ndarray | None = None,
               most: float = math.inf) -> Iterator[np.ndarray | None]:
        """For each query the buckets to visit, by falling chance of holding a neighbour within its radius.

        None if the cells in reach do not add up to the success wanted, or over ``most`` of them would be needed.
        """
        at = self._projected(table, self.asked(q))
        home = np.floor(at)
        radii = np.full(len(q), self.radius) if radius is None else radius
        spread = np.maximum(radii, 1e-3)[:, None, None] / WIDTH
        steps = np.arange(-REACH, REACH + 1)
        edges = home[:, :, None] + np.append(steps, REACH + 1) - at[:, :, None]
        below = _normal(edges / spread)
        chance = below[:, :, 1:] - below[:, :, :-1]
        for one, cell in zip(chance, home):
            yield self._likely(one, cell[:, None] + steps, most)


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def tables_for(entry_rows: DataFrame, queries: DataFrame, top: int = TOP, tables: int = TABLES,
               success: float = SUCCESS, bucket: int = BUCKET) -> Tables | None:
    """Tables fitted to the number of entries, their largest norm and the measured radius; None without rows."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = entry_rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(square)).alias("norm"),
                          F.first(F.size("vector")).alias("dims")).first()
    sample = [r["vector"] for r in queries.orderBy(F.xxhash64("id"), "id").limit(RADIUS_QUERIES).collect()]
    if not size["n"] or not sample:
        return None
    scores = exact(entry_rows, sample, top + 1)
    norms = np.linalg.norm(np.array(sample, dtype=np.float64), axis=1)
    last = np.array([scores[i][-1] for i in range(len(sample))]) / (norms * size["norm"])
    radius = float(np.quantile(np.sqrt(np.maximum(0, 2 - 2 * last)), 0.9))
    hashes = max(1, round(math.log(max(1, size["n"] / bucket)) / math.log(3.2)))  # buckets keep their size
    return Tables(size["dims"], hashes, size["norm"], radius, tables, success, most=max(1, size["n"] / bucket))


def _in_blocks(bucketed: DataFrame, keys: list[str], name: str, member: Column, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the block of their bucket they fall into, and the number of blocks of each bucket."""
    counts = bucketed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias(f"n_{name}"))
    return (bucketed.join(counts, keys).withColumn(name, F.pmod(member, F.col(f"n_{name}"))).drop(f"n_{name}"), counts)


def _reached(held: DataFrame, needed: int, largest: float) -> DataFrame:
    """query, and the distance at which it has ``needed`` ids; NULL if it has fewer."""
    def step(state: Column, hit: Column) -> Column:
        return F.when(state.n >= needed, state).otherwise(
            F.struct((state.n + F.size(hit.ids)).alias("n"), hit.scores.alias("score")))

    first = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("score"))
    last = F.aggregate(F.arrays_zip("ids", "scores"), first, step)
    square = F.aggregate("asked", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return held.withColumn("last", last).withColumn("distance", F.when(F.col("last.n") >= needed, F.sqrt(F.greatest(
        F.lit(0.0), 2 - 2 * F.col("last.score") / (F.sqrt(square) * largest))))).drop("last")


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, tables: int = TABLES,
           success: float = SUCCESS, bucket: int = BUCKET, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query, the query's own id left out.

    ``vectors`` and ``queries`` are (id, vector), as ``usable`` gives them;
    ``bucket`` is the number of entries aimed at in a bucket, ``block`` the most
    of a bucket that are scored together.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = dict(vectors.dtypes)["vector"]
    queries = queries.withColumn("vector", F.col("vector").cast(kind))
    entry_rows = cut(entries(vectors, top))
    asked = cut(queries.groupBy("vector").agg(F.min("id").alias("id")))
    hashing = tables_for(entry_rows, asked, top, tables, success, bucket)
    result = "query_id long, rank int, vec_id long, score double"
    if hashing is None:
        return spark.createDataFrame([], result)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(2)) if len(b) else None
            for t in range(tables if len(b) else 0):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b), t, dtype=np.int32)), pa.array(hashing.buckets(t, v)), *b.columns],
                    names=["t", "bucket", *b.schema.names])

    def probing(most: float) -> Callable:
        """Buckets to visit; a query that would visit over ``most`` of a table visits the one bucket of all."""
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                q, radius = _matrix(b.column(1)), b.column(2).to_numpy()
                visited = [list(hashing.probes(t, q, radius, most)) for t in range(tables)]
                wide = np.array([any(x is None for x in xs) for xs in zip(*visited)])
                visited.append([np.zeros(1, dtype=np.int64)] * len(b))
                for t, lists in zip([*range(tables), _ALL], visited):
                    kept = np.flatnonzero(wide if t == _ALL else ~wide)
                    if len(kept):
                        who = np.repeat(kept, [len(lists[i]) for i in kept])
                        named = np.concatenate([lists[i] for i in kept])
                        for i in range(0, len(who), PROBES):
                            own = pa.array(who[i:i + PROBES])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(own), t, dtype=np.int32)), pa.array(named[i:i + PROBES]),
                                 b.column(0).take(own), b.column(1).take(own)],
                                names=["t", "bucket", "query", "asked"])

        return probe

    def rerank(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of a block of entries for a block of probes: one row a probe."""
        q, v, entry = _matrix(right["asked"]), _matrix(left["vector"]), left["entry"].to_numpy()
        ids = left["ids"].combine_chunks().cast(pa.list_(pa.int64()))
        parts = [_best(q[i:i + SLICE], v, entry, top + 1) for i in range(0, len(q), SLICE)] if len(v) else []
        if not parts:
            return pa.table({n: pa.array([], t) for n, t in zip(("query", "t", "block", "ids", "scores"), (
                pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.float64())))})
        near, scores = (np.concatenate(x) for x in zip(*parts))
        ends = pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1])
        return pa.table({"query": right["query"].to_numpy(), "t": right["t"].to_numpy(),
                         "block": right["block"].to_numpy(),
                         "ids": pa.ListArray.from_arrays(ends, ids.take(pa.array(near.ravel()))),
                         "scores": pa.ListArray.from_arrays(ends, pa.array(scores.ravel()))})

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The best of all that was found for a query, each entry once."""
        ids = table["ids"].combine_chunks().flatten()
        scores = table["scores"].combine_chunks().flatten().to_numpy()
        lengths = ids.value_lengths().to_numpy()
        entry = ids.flatten().to_numpy()[np.cumsum(lengths) - lengths]
        order = np.lexsort((entry, -scores))
        first = np.sort(np.unique(entry[order], return_index=True)[1])[:top + 1]
        chosen, one = order[first], pa.array([0, len(first)], pa.int32())
        return pa.table({"query": [key[0].as_py()], "t": pa.array([0], pa.int32()), "block": pa.array([0], pa.int64()),
                         "ids": pa.ListArray.from_arrays(one, ids.take(pa.array(chosen))),
                         "scores": pa.ListArray.from_arrays(one, pa.array(scores[chosen]))})

    keys = ["t", "bucket"]

    def visit(probes: DataFrame, indexed: DataFrame) -> DataFrame:
        """The best of the buckets visited, merged by query (and some of its blocks)."""
        left, left_blocks = _in_blocks(indexed, keys, "block", F.xxhash64("entry"), block)
        right, right_blocks = _in_blocks(probes, keys, "part", F.xxhash64("query"), block)
        left = left.join(right_blocks, keys).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"),
                                                                                    F.col("n_part") - 1))).drop("n_part")
        right = right.join(left_blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"),
                                                                                      F.col("n_block") - 1)))
        group = [*keys, "block", "part"]
        scored = (left.groupBy(*group).cogroup(right.drop("n_block").groupBy(*group)).applyInArrow(rerank, _FOUND))
        # merged by table and some of a bucket's blocks first, so that a much divided bucket is not one group
        return scored.groupBy("query", "t", F.pmod("block", F.lit(16))).applyInArrow(merge, _FOUND)

    needed = entry_rows.agg(F.sum(F.size("ids"))).first()[0]
    settled: list[DataFrame] = []
    whole: list[DataFrame] = []  # queries to compare with all entries
    waiting = asked.select(F.col("id").alias("query"), F.col("vector").alias("asked"),
                           F.lit(hashing.radius).alias("radius"))
    earlier = spark.createDataFrame([], _FOUND)
    for again in range(rounds):
        probes = cut(map_batches(waiting, probing(hashing.most if again else max(hashing.most, LISTED)),
                                 f"t int, bucket long, query long, asked {kind}"))
        whole.append(probes.filter(F.col("t") == _ALL))
        indexed = map_batches(entry_rows, index, f"t int, bucket long, entry long, ids array<long>, vector {kind}").join(
            probes.select(*keys).distinct(), keys, "left_semi")
        parts = visit(probes.filter(F.col("t") != _ALL), indexed).unionByName(earlier)
        best = parts.groupBy("query").applyInArrow(merge, _FOUND)
        tried = waiting.join(whole[-1].select("query"), "query", "left_anti")
        held = cut(_reached(tried.join(best, "query", "left"), min(needed, top + 1), hashing.largest))
        # all ids there are, or enough of them no farther than the radius allowed for
        fine = F.coalesce(F.col("distance") <= F.col("radius") + 1e-9, F.lit(False)) | (
            F.col("distance").isNotNull() & F.lit(needed <= top + 1))
        settled.append(held.filter(fine).select("query", "ids", "scores"))
        rest = held.filter(~fine)
        earlier = rest.filter(F.col("ids").isNotNull()).select("query", "t", "block", "ids", "scores")
        waiting = rest.select("query", "asked", F.least(F.col("radius") * 2, "distance").alias("radius"))
        if waiting.isEmpty():
            break
    everyone = cut(reduce(DataFrame.unionByName, [w.select("query", "asked") for w in whole], waiting.select("query", "asked")))
    if not everyone.isEmpty():
        all_rows = entry_rows.select(F.lit(_ALL).alias("t"), F.lit(0).cast("long").alias("bucket"), "*")
        compared = visit(everyone.select(F.lit(_ALL).alias("t"), F.lit(0).cast("long").alias("bucket"), "*"), all_rows)
        settled.append(compared.groupBy("query").applyInArrow(merge, _FOUND).select("query", "ids", "scores"))
    kept = reduce(DataFrame.unionByName, settled).select(
        "query", F.explode(F.arrays_zip("ids", "scores")).alias("hit")).select(
        "query", F.col("hit.ids").alias("ids"), F.col("hit.scores").alias("score"))
    by_query = (queries.join(asked.withColumnRenamed("id", "query"), "vector").select("id", "query")
                .join(kept, "query").select(F.col("id").alias("query_id"), "score", F.explode("ids").alias("vec_id"))
                .filter(F.col("vec_id") != F.col("query_id")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (by_query.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))
