"""Grouped summaries of evidence tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def capability_metrics(files: DataFrame, capabilities: str, methods: str) -> DataFrame:
    """Per capability: files, prevalence (6 digits), files per 1000 (3), methods in them and per 1000 methods (3).

    Totals are one row and join by broadcast. Halves go up.
    """
    total = files.agg(F.count("*").alias("__files"), F.sum(methods).alias("__methods"))
    per = files.select(F.explode(capabilities).alias("capability"), F.col(methods).alias("m")).groupBy("capability").agg(F.count("*").alias("matching_files"), F.sum("m").cast("long").alias("methods_in_files"))
    rate = lambda a, b, digits, by=1: F.when(F.col(b) > 0, F.round(F.col(a) * by / F.col(b), digits)).otherwise(0.0)
    return per.crossJoin(F.broadcast(total)).select(
        "capability", "matching_files", rate("matching_files", "__files", 6).alias("prevalence"), rate("matching_files", "__files", 3, 1000.0).alias("per_1000_files"),
        "methods_in_files", rate("methods_in_files", "__methods", 3, 1000.0).alias("methods_per_1000"),
    )


def conditional_counts(hits: DataFrame, name: str, is_code: Column, ownership: Column) -> DataFrame:
    """Per capability in one pass: all files, own code, dependency code, other files."""
    own, other = ownership.isin("first_party", "unknown"), ownership.isin("third_party", "platform")
    return hits.groupBy(F.col(name).alias("capability")).agg(
        F.count("*").alias("total"), F.count_if(is_code & own).alias("comparison"), F.count_if(is_code & other).alias("dependency"), F.count_if(~is_code).alias("non_code")
    )


def ownership_files(files: DataFrame, is_code: Column) -> DataFrame:
    """(ownership, files, code_files)."""
    return files.groupBy("ownership").agg(F.count("*").alias("files"), F.count_if(is_code).alias("code_files"))


def ownership_capabilities(hits: DataFrame, name: str) -> DataFrame:
    """(ownership, capability, n) of rows of one capability each."""
    return hits.groupBy("ownership", F.col(name).alias("capability")).agg(F.count("*").alias("n"))


def package_rollup(files: DataFrame, samples: int = 20) -> DataFrame:
    """(package, file_count, ownership, sample_files, capabilities) from (package, file, ownership, capabilities).

    ownership is that of the first file; sample_files are the first by name; capabilities are counted,
    most frequent first, ties by the first file that has them. The samples are cut before they are
    gathered, so a package with a third of all files costs no task its whole list.
    """
    base = files.groupBy("package").agg(F.count("*").alias("file_count"), F.min_by("ownership", "file").alias("ownership"))
    w = Window.partitionBy("package").orderBy("file")
    first = files.select("package", "file", F.row_number().over(w).alias("n")).where(F.col("n") <= samples).groupBy("package").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("sample_files"))
    caps = files.select("package", "file", F.explode("capabilities").alias("c")).groupBy("package", "c").agg(F.count("*").alias("k"), F.min("file").alias("f"))
    line = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("neg"), "f", "c")))
    listed = caps.groupBy("package").agg(F.array_join(F.transform(line, lambda x: F.concat(x["c"], F.lit("="), (-x["neg"]).cast("string"))), ",").alias("capabilities"))
    out = _with(_with(base, first, "package"), listed, "package")
    return out.withColumn("capabilities", F.coalesce("capabilities", F.lit("")))


def _with(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join by a key that may be null."""
    other = right.withColumnRenamed(key, "__key")
    return left.join(other, left[key].eqNullSafe(other["__key"]), "left").drop("__key")


def stratified_per_group(rows: DataFrame, group: str, bucket: Sequence[str], order: Sequence[Column], bucket_order: Sequence[Column], limit: int) -> DataFrame:
    """Round-robin over buckets within each group: rows of equal turn in bucket order, at most limit a group."""
    turn = rows.withColumn("__turn", F.row_number().over(Window.partitionBy(group, *bucket).orderBy(*order))).where(F.col("__turn") <= limit)
    pick = Window.partitionBy(group).orderBy(F.col("__turn"), *bucket_order)
    return turn.withColumn("__pick", F.row_number().over(pick)).where(F.col("__pick") <= limit).drop("__turn", "__pick")


def with_head(rows: DataFrame, bucket: Sequence[str], score: str, name: str) -> DataFrame:
    """Adds the best score of each bucket, from a pre-aggregated join."""
    return rows.join(rows.groupBy(*bucket).agg(F.max(score).alias(name)), list(bucket))


def distinct_lists(rows: DataFrame, key: str, value: str, limit: int) -> DataFrame:
    """(key, n, values): row count and the first distinct values in order, cut before they are gathered."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(value)
    top = rows.select(key, value).distinct().withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit)
    return _with(n, top.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values")), key)


def models_and_top(rows: DataFrame, group: Sequence[str], model: str, order: Sequence[Column], k: int) -> DataFrame:
    """All models and the k best other rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    rest = rows.where(~F.col(model)).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")
    return rows.where(F.col(model)).unionByName(rest)


def counters(rows: DataFrame, by: Sequence[str], **sums: Column) -> DataFrame:
    """Row count and named sums per group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def flags(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row of any-of flags; without rows all are false."""
    return rows.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in conditions.items()])
