"""Quantiles of many columns at once, exact or approximate.

Exact quantiles use linear interpolation between the order statistics at
ranks floor(h) and ceil(h), h = (n - 1) * p (pandas/numpy "linear", DuckDB
``quantile_cont``).

Spark's built-in exact ``percentile`` merges a value -> count map of the whole
column inside a single task, which does not survive a column with billions of
distinct values.  Here every order statistic is found by bracketing instead:

* one pass counts values and finds the finite min / max of each column;
* a quantile sketch of known rank error and one counting pass place the first
  brackets, which hold a few ten-thousandths of the rows each; up to
  ``collect_limit`` values they are read off at once, and that is all;
* for larger ones each further pass splits every open bracket [lo, hi] into ``buckets``
  equal-width buckets (a monotone map, so buckets are contiguous value
  ranges) and aggregates (count, min, max) per bucket.  The result has at
  most (#brackets x buckets) rows whatever the data size, and a hot value
  collapses in the map-side partial aggregate;
* the bucket holding the wanted rank becomes the next bracket, with its exact
  minimum and maximum as bounds; once a bracket holds few values they are
  grouped by value and the rank is read off directly.

All columns and all wanted ranks share each pass, so a profile of a wide
table costs a handful of scans.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import aggregate_in_passes
from ..functions.typing_rules import qcol

_INF = float("inf")


def _lerp(v0: float, v1: float, frac: float) -> float:
    if frac == 0.0 or v0 == v1:
        return v0
    if frac >= 0.5:
        return v1 - (v1 - v0) * (1.0 - frac)
    return v0 + (v1 - v0) * frac


def approx_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     accuracy: int = 10000) -> dict[str, list[float | None]]:
    """``percentile_approx`` for every column in one aggregate (no interpolation)."""
    if not columns:
        return {}
    aggs = [F.percentile_approx(qcol(c), list(probs), accuracy).alias(f"q{i}")
            for i, c in enumerate(columns)]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        vals = row[f"q{i}"]
        out[c] = [None] * len(probs) if vals is None else [float(v) for v in vals]
    return out


def _column_stats(df: DataFrame, columns: list[str]) -> dict:
    inf = F.lit(_INF)
    stats = []
    for i, c in enumerate(columns):
        x = qcol(c)
        fin = F.when(F.abs(x) != inf, x)
        stats += [
            (f"n{i}", F.count(x)),
            (f"lo{i}", F.min(fin)),
            (f"hi{i}", F.max(fin)),
            (f"ni{i}", F.count(F.when(x == -inf, 1))),
            (f"pi{i}", F.count(F.when(x == inf, 1))),
        ]
    return aggregate_in_passes(df, stats)


PASS_BUDGET = 1 << 20     # most rows any refinement pass may send to the driver
SEED_ACCURACY = 10_000    # of the sketch that places the first brackets


def _seeds(df: DataFrame, columns: list[str], wanted: dict[int, dict[int, int]], sizes: dict[int, int]
           ) -> dict[tuple[int, float, float], dict]:
    """First brackets around the wanted ranks of the finite values, from a sketch and one counting pass.

    ``wanted`` maps a column to {rank among its finite values: rank}.  The
    sketch is off by at most n / SEED_ACCURACY ranks, so the values twice that
    far on both sides enclose a rank; the count says so for certain.
    """
    inf = F.lit(_INF)
    groups, aggs = [], []
    for i, ranks in wanted.items():
        n = sizes[i]
        reach = 2.0 / SEED_ACCURACY
        clusters: list[list[int]] = []
        for r in sorted(ranks):
            if clusters and r - clusters[-1][-1] <= reach * n:
                clusters[-1].append(r)
            else:
                clusters.append([r])
        probs = []
        for c in clusters:
            probs += [max(0.0, c[0] / n - reach), min(1.0, (c[-1] + 1) / n + reach)]
        x = qcol(columns[i])
        aggs.append((f"q{i}", F.percentile_approx(F.when(F.abs(x) != inf, x), probs, SEED_ACCURACY)))
        groups.append((i, clusters))
    found = aggregate_in_passes(df, aggs)
    places, counts = [], []
    for i, clusters in groups:
        x = qcol(columns[i])
        for j, c in enumerate(clusters):
            lo, hi = float(found[f"q{i}"][2 * j]), float(found[f"q{i}"][2 * j + 1])
            k = len(places)
            places.append((i, lo, hi, c))
            counts += [(f"b{k}", F.count(F.when((x < F.lit(lo)) & (x != -inf), 1))),
                       (f"c{k}", F.count(F.when(x.between(F.lit(lo), F.lit(hi)), 1)))]
    row = aggregate_in_passes(df, counts)
    out: dict[tuple[int, float, float], dict] = {}
    for k, (i, lo, hi, c) in enumerate(places):
        below, inside = row[f"b{k}"], row[f"c{k}"]
        held = {r for r in c if below <= r < below + inside}
        if held:
            b = out.setdefault((i, lo, hi), {"below": below, "cnt": inside, "ranks": set()})
            b["ranks"] |= held
    return out


def select_ranks(df: DataFrame, columns: list[str], ranks: dict[int, set[int]], srow,
                 buckets: int = 4096, collect_limit: int = 65536,
                 max_rounds: int = 256) -> dict[tuple[int, int], float]:
    """Exact order statistics: value at 0-based ``rank`` of column index ``i``.

    ``srow`` is the row of ``_column_stats``.  Each pass refines every open
    bracket at once; see the module docstring.  Whatever the number of
    columns, one pass returns at most ``PASS_BUDGET`` rows: half of it for
    brackets small enough to be grouped by value (smallest first), the other
    half shared as buckets among the rest (at least 16 buckets each).
    """
    values: dict[tuple[int, int], float] = {}
    offsets, finite, wanted = {}, {}, {}
    for i, wanted_ranks in ranks.items():
        n = srow[f"n{i}"]
        n_neg, n_pos = srow[f"ni{i}"], srow[f"pi{i}"]
        offsets[i], finite[i] = n_neg, n - n_neg - n_pos
        for r in wanted_ranks:
            if r < n_neg:
                values[(i, r)] = -_INF
            elif r >= n - n_pos:
                values[(i, r)] = _INF
            else:
                wanted.setdefault(i, {})[r - n_neg] = r
    brackets = _seeds(df, columns, wanted, finite) if wanted else {}
    held = {(key[0], r) for key, b in brackets.items() for r in b["ranks"]}
    for i, own in wanted.items():        # a rank the sketch missed is looked for in the whole range
        for r in own:
            if (i, r) not in held:
                b = brackets.setdefault((i, srow[f"lo{i}"], srow[f"hi{i}"]),
                                        {"below": 0, "cnt": finite[i], "ranks": set()})
                b["ranks"].add(r)

    rounds = 0
    while brackets:
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError("rank selection did not converge")
        active = []
        for key, b in list(brackets.items()):
            ci, lo, hi = key
            if lo == hi:
                for r in b["ranks"]:
                    values[(ci, r + offsets[ci])] = lo
                del brackets[key]
            else:
                active.append((key, b))
        if not active:
            break
        by_value: set[int] = set()
        room = PASS_BUDGET // 2
        for j in sorted(range(len(active)), key=lambda j: active[j][1]["cnt"]):
            cnt = active[j][1]["cnt"]
            if cnt <= collect_limit and cnt <= room:
                by_value.add(j)
                room -= cnt
        n_bucketed = len(active) - len(by_value)
        nb = max(16, min(buckets, (PASS_BUDGET // 2) // max(1, n_bucketed)))
        emits = []
        for j, ((ci, lo, hi), b) in enumerate(active):
            x = qcol(columns[ci])
            if j in by_value:
                k = x
            else:
                half_lo = lo / 2.0
                span = hi / 2.0 - half_lo
                k = F.least(F.greatest(F.floor((x / 2.0 - F.lit(half_lo)) / F.lit(span) * nb),
                                       F.lit(0)), F.lit(nb - 1)).cast("double")
            emits.append(F.when(x.between(F.lit(lo), F.lit(hi)),
                                F.struct(F.lit(j).alias("b"), k.alias("k"), x.alias("v"))))
        parts = (
            df.select(F.explode(F.array(*emits)).alias("e"))
            .where(F.col("e").isNotNull())
            .select("e.b", "e.k", "e.v")
            .groupBy("b", "k")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
            .toPandas()  # bounded: <= buckets rows per open bracket, Arrow transfer
        )
        by_bracket: dict[int, list] = {}
        for b_id, mn, mx, n in zip(parts["b"].tolist(), parts["mn"].tolist(),
                                   parts["mx"].tolist(), parts["n"].tolist()):
            by_bracket.setdefault(int(b_id), []).append((float(mn), float(mx), int(n)))
        for j, (key, b) in enumerate(active):
            del brackets[key]
            ci = key[0]
            rows = sorted(by_bracket.get(j, []))
            for r in b["ranks"]:
                local = r - b["below"]
                cum = 0
                for mn, mx, n in rows:
                    if local < cum + n:
                        if mn == mx:
                            values[(ci, r + offsets[ci])] = mn
                        else:
                            nk = (ci, mn, mx)
                            nb = brackets.setdefault(nk, {"below": b["below"] + cum, "cnt": n, "ranks": set()})
                            nb["ranks"].add(r)
                        break
                    cum += n
                else:  # pragma: no cover - counts are exact, so this cannot happen
                    raise RuntimeError("rank outside bracket")
    return values


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    buckets: int = 4096, collect_limit: int = 65536,
                    max_rounds: int = 256) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of double columns (NULL = missing).

    ``df`` must hold the columns as doubles without NaN.  The driver only ever
    receives per-bucket summaries, bounded by ``buckets`` per open bracket and
    by ``collect_limit`` values per bracket in the last step.
    """
    columns = list(columns)
    if not columns:
        return {}
    srow = _column_stats(df, columns)
    wanted: dict[int, list[tuple[int, int, float]]] = {}
    ranks: dict[int, set[int]] = {}
    for i in range(len(columns)):
        n = srow[f"n{i}"]
        if not n:
            continue
        wanted[i] = []
        for p in probs:
            h = (n - 1) * float(p)
            r0, r1 = int(math.floor(h)), int(math.ceil(h))
            wanted[i].append((r0, r1, h - r0))
            ranks.setdefault(i, set()).update((r0, r1))
    values = select_ranks(df, columns, ranks, srow, buckets, collect_limit, max_rounds)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        if i not in wanted:
            out[c] = [None] * len(probs)
            continue
        out[c] = [_lerp(values[(i, r0)], values[(i, r1)], frac) for r0, r1, frac in wanted[i]]
    return out


def value_at_rank(df: DataFrame, column: str, rank: int) -> float | None:
    """The exact value at 0-based ``rank`` of a double column (NULL values excluded)."""
    srow = _column_stats(df, [column])
    n = srow["n0"]
    if not n or rank < 0 or rank >= n:
        return None
    return select_ranks(df, [column], {0: {rank}}, srow)[(0, rank)]


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
              exact: bool = True, accuracy: int = 10000) -> dict[str, list[float | None]]:
    """Quantiles per column; ``exact=False`` trades exactness for one pass."""
    if exact:
        return exact_quantiles(df, columns, probs)
    return approx_quantiles(df, columns, probs, accuracy)
