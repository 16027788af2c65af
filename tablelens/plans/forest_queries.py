"""Registered queries over forests.

Bags are column expressions, so SQL finds every tree's bag again.  The trees
have one two-valued feature here: each can only part its bag in two, and SQL
computes what it says of either side, every row's votes and the estimate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest
from ..sources.tables import read_table

TREES = 6
SEED = 42
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(
        *KEY, (F.col("l_quantity") > 25).cast("double").alias("many"), F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") > 35000).cast("double").alias("dear"))


def forest_bags(spark, d):
    """Rows in and out of the bag of each tree, and the bag's weight."""
    return forest.bags(read_table(spark, d, "lineitem").select(*KEY), KEY, TREES, SEED)


def forest_out_of_bag(spark, d):
    """R^2 of a regression forest, each line judged by the trees that never saw it."""
    lines = _lines(spark, d)
    grown = forest.fit(lines, ["many"], "price", KEY, None, TREES, 1, SEED)
    return grown.estimate(lines).select("n_rows", "n_judged", "n_votes", F.round("score", 7).alias("score"))


def forest_votes(spark, d):
    """What the unseeing trees of a classification forest say: lines and votes by label, number of votes and prediction."""
    lines = _lines(spark, d)
    grown = forest.fit(lines, ["many"], "dear", KEY, 2, TREES, 1, SEED)
    return (grown.out_of_bag(lines).groupBy("dear", "n_votes", "prediction")
            .agg(F.count(F.lit(1)).alias("n_rows")))


QUERIES = {"forest_bags": forest_bags, "forest_out_of_bag": forest_out_of_bag, "forest_votes": forest_votes}

_KEYS = " || ".join(f"'|=' || {c}" for c in KEY)
_WEIGHTS = f"""
WITH n AS (
  SELECT tree, l_quantity > 25 AS many, l_extendedprice AS price, (l_extendedprice > 35000)::INT AS dear, id,
         ('0x' || md5('{SEED}|' || tree {'|| ' + _KEYS})[1:{forest.DIGITS}])::BIGINT AS number
  FROM (SELECT *, row_number() OVER () AS id FROM lineitem), (SELECT unnest(range({TREES}))::INT AS tree)),
b AS (SELECT *, {' + '.join(f'(number >= {x})::INT' for x in forest.poisson_limits())} AS weight FROM n),
said AS (
  SELECT tree, many, sum(weight * price) / sum(weight) AS mean,
         (sum(weight * dear) > sum(weight * (1 - dear)))::INT AS class
  FROM b GROUP BY tree, many),
votes AS (
  SELECT id, any_value(price) AS price, any_value(dear) AS dear, count(*) FILTER (weight = 0) AS n_votes,
         avg(mean) FILTER (weight = 0) AS mean, sum(class) FILTER (weight = 0) AS ones
  FROM b JOIN said USING (tree, many) GROUP BY id)"""


def oracles() -> dict[str, str]:
    return {
        "forest_bags": f"""{_WEIGHTS}
SELECT tree, count(*) FILTER (weight > 0) AS n_in, count(*) FILTER (weight = 0) AS n_out, sum(weight)::BIGINT AS weight
FROM b GROUP BY tree""",
        "forest_out_of_bag": f"""{_WEIGHTS}
SELECT count(*) AS n_rows, count(mean) AS n_judged, sum(n_votes)::BIGINT AS n_votes,
       round(1 - sum((price - mean) ^ 2) / (sum(price ^ 2) FILTER (mean IS NOT NULL)
             - (sum(price) FILTER (mean IS NOT NULL)) ^ 2 / count(mean)), 7) AS score
FROM votes""",
        "forest_votes": f"""{_WEIGHTS}
SELECT dear::DOUBLE AS dear, n_votes::INT AS n_votes,
       CASE WHEN n_votes > 0 THEN (2 * ones > n_votes)::INT::DOUBLE END AS prediction, count(*) AS n_rows
FROM votes GROUP BY ALL""",
    }
