"""Joins across layers: Java to native, tasks to targets, and validated imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import jni_prefix


def symbol_matches(symbol: Column, method: Column, expected: Column) -> Column:
    """Whether an exported symbol implements a native method."""
    return F.contains(symbol, expected) | F.endswith(symbol, F.concat(F.lit("_"), method)) | F.contains(symbol, F.concat(F.lit("_"), method, F.lit("__")))


def link_by_stem(files: DataFrame, libraries: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """(file, library, match_type): files(file, stems, n_methods) to libraries(library, stem) they load.

    Stems join by equality. A file with native methods whose stems match nothing is linked to every
    library (match_type fallback): as many rows as the result has by its definition. Libraries are
    broadcast for it up to `broadcast_rows` of them, beyond that both sides stay distributed.
    """
    wanted = files.select("file", "n_methods", F.explode_outer(F.array_distinct("stems")).alias("stem"))
    hits = wanted.join(libraries, "stem").select("file", "library").distinct().withColumn("match_type", F.lit("load_library"))
    rest = files.where("n_methods > 0").join(hits.select("file").distinct(), "file", "left_anti").select("file")
    every = libraries.select("library").distinct()
    every = F.broadcast(every) if every.count() <= broadcast_rows else every
    return hits.unionByName(rest.crossJoin(every).withColumn("match_type", F.lit("fallback")))


def link_symbols(methods: DataFrame, symbols: DataFrame, by: Sequence[str] = ("library",)) -> DataFrame:
    """methods(package, class_name, method, by...) to symbols(symbol, by...) that may implement them.

    The equality on `by` makes a hash join; the name test is its residual condition.
    """
    m = methods.withColumn("expected", jni_prefix(F.col("package"), F.col("class_name"), F.col("method")))
    return m.join(symbols, list(by)).where(symbol_matches(F.col("symbol"), F.col("method"), F.col("expected")))


def cascading(left: DataFrame, right: DataFrame, exact: Sequence[str], loose: Sequence[str], order: Sequence[Column], take: Sequence[str]) -> DataFrame:
    """left with columns `take` of right, by all of `exact`, else by `loose`; of several the last in order.

    level tells which key matched: exact, loose or none. Nulls match nothing.
    """
    value = F.struct(*take)
    last = lambda keys, name: right.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name))
    both = left.join(last(exact, "__e"), list(exact), "left").join(last(loose, "__l"), list(loose), "left")
    level = F.when(F.col("__e").isNotNull(), "exact").when(F.col("__l").isNotNull(), "loose").otherwise("none")
    got = both.withColumn("__v", F.coalesce("__e", "__l")).withColumn("level", level)
    return got.select(*left.columns, *[F.col(f"__v.{c}").alias(c) for c in take], "level")


def first_by(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in key]
    got = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__v"))
    return got.select(*key, *[F.col(f"__v.{c}").alias(c) for c in rest])


def last_by(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in key]
    got = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__v"))
    return got.select(*key, *[F.col(f"__v.{c}").alias(c) for c in rest])


#: The import contract's schema version.
RESULT_SCHEMA = "2026-07-23.ida-manual-result.v2"


def validate_import(results: DataFrame, tasks: DataFrame, libraries: DataFrame, schema: str = RESULT_SCHEMA) -> DataFrame:
    """results with error (null: accepted), verification and matched task.

    results: (ord, schema_version, library_sha256, abi, library_name, tool_version, task_id, symbol,
    address, pseudocode). tasks: (task_id, task_type, library_sha256, abi, symbol, address). libraries:
    (library_sha256, abi, library_name). The first failed check names the error; of results for one
    function the first by ord is accepted. Lookups are equality joins on aggregated keys.
    """
    e = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    r = results.select("*", F.lower(F.coalesce("library_sha256", F.lit(""))).alias("sha"), e("symbol").alias("sym"), e("address").alias("adr"), e("task_id").alias("tid"))
    libs = libraries.groupBy(F.lower("library_sha256").alias("sha")).agg(F.collect_set(F.struct("abi", "library_name")).alias("__libs"))
    t = tasks.withColumn("sha", F.lower("library_sha256"))
    functions = t.where("task_type = 'function'")
    pick = lambda *keys: functions.groupBy("sha", "abi", *keys)
    exact = pick("symbol", "address").agg(F.max("task_id").alias("x_id")).select("sha", "abi", F.col("symbol").alias("sym"), F.col("address").alias("adr"), "x_id")
    by_sym = pick("symbol").agg(F.count("*").alias("s_n"), F.max("task_id").alias("s_id"), F.max("address").alias("s_adr")).select("sha", "abi", F.col("symbol").alias("sym"), "s_n", "s_id", "s_adr")
    by_adr = pick("address").agg(F.count("*").alias("a_n"), F.max("task_id").alias("a_id"), F.max("symbol").alias("a_sym")).select("sha", "abi", F.col("address").alias("adr"), "a_n", "a_id", "a_sym")
    found = t.where("task_type = 'library_discovery'").groupBy("sha", "abi").agg(F.collect_set("task_id").alias("__found"))
    j = r.join(libs, "sha", "left").join(exact, ["sha", "abi", "sym", "adr"], "left").join(by_sym, ["sha", "abi", "sym"], "left").join(by_adr, ["sha", "abi", "adr"], "left").join(found, ["sha", "abi"], "left")
    both = F.col("sym").isNotNull() & F.col("adr").isNotNull()
    of_abi = F.filter("__libs", lambda x: x["abi"] == F.col("abi"))
    named = F.filter(of_abi, lambda x: x["library_name"] == F.col("library_name"))
    n = F.when(both, F.col("x_id").isNotNull().cast("long")).when(F.col("sym").isNotNull(), F.col("s_n")).otherwise(F.col("a_n"))
    n = F.coalesce(n, F.lit(0))
    task = F.when(both, F.col("x_id")).when(F.col("sym").isNotNull(), F.col("s_id")).otherwise(F.col("a_id"))
    discovered = F.col("__found").isNotNull() & F.col("adr").isNotNull()
    error = (
        F.when(F.coalesce("schema_version", F.lit("")) != schema, "unsupported schema_version")
        .when(~F.col("sha").rlike("^[0-9a-f]{64}$"), "library_sha256 is not a SHA-256")
        .when(F.col("__libs").isNull(), "library_sha256 is unknown")
        .when(F.size(of_abi) == 0, "abi does not match the library")
        .when(e("library_name").isNotNull() & (F.size(named) == 0), "library_name does not match the library")
        .when(e("tool_version").isNull(), "tool version is required")
        .when(F.col("tid").isNull(), "task_id is required")
        .when(F.col("sym").isNull() & F.col("adr").isNull(), "symbol or address is required")
        .when(both & F.col("x_id").isNull() & (F.col("s_n").isNotNull() | F.col("a_n").isNotNull()), "symbol and address identify different tasks")
        .when(n > 1, "function identity is ambiguous")
        .when((n == 0) & ~discovered, "function is not in the task manifest")
        .when((n == 0) & ~F.array_contains("__found", F.col("tid")), "task_id does not match the discovery task")
        .when((n == 1) & (F.col("tid") != task), "task_id does not match the function")
    )
    how = F.when(n == 1, "binary_hash_verified_manifest_task_metadata_matched").otherwise("binary_hash_verified_manual_internal_address")
    j = j.withColumn("__error", error).withColumn("verification", how)
    j = j.withColumn("__sym", F.coalesce("sym", "a_sym", F.lit(""))).withColumn("__adr", F.coalesce("adr", "s_adr", F.lit("")))
    first = j.where("__error is null").groupBy("sha", "__sym", "__adr").agg(F.min("ord").alias("__first"))
    j = j.join(first, ["sha", "__sym", "__adr"], "left")
    final = F.coalesce(
        F.col("__error"),
        F.when(F.col("ord") != F.col("__first"), "duplicate result for the function"),
        F.when(e("pseudocode").isNull(), "pseudocode is empty"),
    )
    return j.select(*results.columns, final.alias("error"), F.when(final.isNull(), F.col("verification")).alias("verification"))


def queued_candidates(queue: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate of each queued task, in the queue's columns first: queue(task_id, ...), candidates(task_id, ord, ...).

    Of candidates with one id the last by ord counts; tasks without a candidate go.
    """
    found = last_by(candidates, ["task_id"], [F.col("ord")]).drop("ord")
    return queue.join(found, "task_id")
