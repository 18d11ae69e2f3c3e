"""Ranking, budgets and samples. All are windows or ordered limits over explicit sort keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .numbering import numbered


def round_robin(rows: DataFrame, bucket: Sequence[str], order: Sequence[Column], bucket_order: Sequence[Column], limit: int, rank: str | None = None) -> DataFrame:
    """Take one row of each bucket in turn, buckets in bucket_order, until limit rows are taken.

    Row r of a bucket is taken in turn r, so the sample is the first rows by (turn, bucket order): a
    ranked window per bucket, cut to limit before its shuffle, and one ordered limit.
    """
    w = Window.partitionBy(*bucket).orderBy(*order)
    turn = rows.withColumn("__turn", F.row_number().over(w)).where(F.col("__turn") <= max(0, limit))
    key = [F.col("__turn"), *bucket_order]
    out = turn.orderBy(*key).limit(max(0, limit))
    if rank is not None:
        # at most limit rows are left
        out = out.withColumn(rank, F.row_number().over(Window.orderBy(*key)).cast("long"))
    return out.drop("__turn")


def first_ranked(rows: DataFrame, order: Sequence[Column], limit: int, rank: str) -> DataFrame:
    """The first rows in order with their rank from 1: an ordered limit, then a window over the rows that are left."""
    return rows.orderBy(*order).limit(limit).withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark ranks within map tasks first."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def capped(rows: DataFrame, group: Sequence[str], order: Sequence[Column], per_group: int, limit: int) -> DataFrame:
    """At most per_group rows a group, then at most limit rows in all, in the given order."""
    return top_per_group(rows, group, order, per_group).orderBy(*order).limit(limit)


def top_groups(rows: DataFrame, group: str, score: str, n: int) -> DataFrame:
    """Rows of the n groups with the best score (at least 0), ties by name."""
    best = rows.groupBy(group).agg(F.greatest(F.max(score), F.lit(0)).alias("__best")).orderBy(F.desc("__best"), group).limit(n)
    return rows.join(best.select(group), group, "left_semi")


def budget_plan(rows: DataFrame, library: str, order: Sequence[Column], max_targets: int, max_libraries: int) -> DataFrame:
    """Greedy budget in row order: libraries are admitted by first appearance, each takes an even share.

    The share is ceil(max_targets / max_libraries); the first max_targets admitted rows are kept.
    """
    share = max(1, -(-max_targets // max_libraries))
    first = Window.partitionBy(library).orderBy(*order)
    shared = rows.where((F.col(library).isNotNull()) & (F.col(library).cast("string") != "")).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= share)
    # the first rows of libraries, in order: only max_libraries of them are kept
    admitted = shared.where("__n = 1").orderBy(*order).limit(max_libraries).select(library)
    return shared.join(admitted, library, "left_semi").orderBy(*order).limit(max_targets).drop("__n")


def first_distinct(rows: DataFrame, key: Sequence[str], rank: str, n: int) -> DataFrame:
    """All rows of the first n distinct keys in order of their least rank."""
    first = rows.groupBy(*key).agg(F.min(rank).alias("__first")).orderBy("__first", *key).limit(n)
    return rows.join(first.drop("__first"), list(key), "left_semi")


def systematic_sample(rows: DataFrame, order: Sequence[Column], k: int, key: str) -> DataFrame:
    """k rows at even steps of the order: positions round(i (n - 1) / (k - 1)), halves to even.

    Positions come from a range partitioned sort: row counts of the partitions are added up, so no
    single task numbers all rows. Fewer rows than k: all of them. key must make the order total.
    """
    n = rows.count()
    if n <= k or k < 1:
        return rows if k >= 1 else rows.limit(0)
    wanted = sorted({round(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)})
    spots = rows.sparkSession.createDataFrame([(w,) for w in wanted], "__pos long")
    # k positions: a bounded broadcast
    return numbered(rows, order, "__pos").join(F.broadcast(spots), "__pos", "left_semi").drop("__pos")


def selection_counts(before: DataFrame, after: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, discovered, selected, excluded)."""
    a = before.groupBy(*by).agg(F.count("*").alias("discovered"))
    b = after.groupBy(*by).agg(F.count("*").alias("selected"))
    both = a.join(b, list(by), "left") if by else a.crossJoin(b)  # without `by` both are a single row
    chosen = F.coalesce("selected", F.lit(0).cast("long"))
    return both.select(*by, "discovered", chosen.alias("selected"), (F.col("discovered") - chosen).alias("excluded"))
