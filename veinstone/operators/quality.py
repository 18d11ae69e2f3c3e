"""Field status, completeness, phase status and dependency state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import CRITICAL_FIELDS, FIELD_WEIGHTS, REQUIRED_FIELDS


def field_status(value: Column, error: Column | None = None, supported: Column | None = None, empty_is_valid: bool = False) -> Column:
    """unsupported, error, missing or success. An empty text is missing unless it is valid."""
    missing = value.isNull() if empty_is_valid else value.isNull() | (F.trim(value.cast("string")) == "")
    out = F.when(missing, "missing").otherwise("success")
    if error is not None:
        out = F.when(error.isNotNull(), "error").otherwise(out)
    if supported is not None:
        out = F.when(~supported, "unsupported").otherwise(out)
    return out


def field_rows(rows: DataFrame, key: Sequence[str], fields: Mapping[str, Column]) -> DataFrame:
    """(key, field, status), a row a field: an inline unpivot, nothing is shuffled."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("status")) for n, c in fields.items()])
    return rows.select(*key, F.inline(pairs))


def completeness(status: DataFrame, key: Sequence[str], weights: Mapping[str, float] = FIELD_WEIGHTS, critical: Sequence[str] = CRITICAL_FIELDS, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """(key, completeness, status, failed_critical): weights of successful fields, 4 digits, and the roll-up."""
    ok = F.col("status") == "success"
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("field") == name, w).otherwise(weight)
    seen = lambda names: F.size(F.array_except(F.array(*map(F.lit, sorted(names))), F.coalesce(F.collect_set(F.when(ok, F.col("field"))), F.array().cast("array<string>"))))
    lost = F.array_except(F.array(*map(F.lit, sorted(critical))), F.collect_set(F.when(ok, F.col("field"))))
    return status.groupBy(*key).agg(
        F.round(F.sum(F.when(ok, weight).otherwise(0.0)), 4).alias("completeness"),
        F.when(seen(critical) > 0, "failed").when(seen(required) > 0, "partial").otherwise("success").alias("status"),
        F.array_join(lost, ", ").alias("failed_critical"),
    )


def completeness_summary(rows: DataFrame, score: str = "completeness", status: str = "status") -> DataFrame:
    """One row: average (4 digits) and least completeness, and counts of each status."""
    return rows.agg(
        F.round(F.avg(score), 4).alias("average"), F.min(score).alias("least"),
        *[F.count_if(F.col(status) == s).alias(s) for s in ("success", "partial", "failed")],
    )


def validation_errors(**checks: Column) -> Column:
    """Names of the checks that hold, in order; nulls do not hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def archive_status(archives: DataFrame) -> DataFrame:
    """Adds validation_errors and success from zip_error, manifest_present and manifest_readable."""
    errors = F.array_compact(F.array(
        F.col("zip_error"),
        F.when(~F.col("manifest_present"), "android_manifest_missing"),
        F.when(F.col("manifest_present") & ~F.col("manifest_readable"), "android_manifest_empty_or_unreadable"),
        F.when(F.col("zip_error").isNull() & (F.col("entry_count") == 0), "empty_apk_archive"),
    ))
    return archives.withColumn("validation_errors", errors).withColumn("success", F.size("validation_errors") == 0)


def phase_status(failed: Column, partial: Column, skipped: Column | None = None) -> Column:
    out = F.when(failed, "failed").when(partial, "partial").otherwise("success")
    return out if skipped is None else F.when(skipped, "skipped").otherwise(out)


def native_status(errors: Column, libraries: Column, wanted: Column, plan_status: Column, failures: Column, import_status: Column, handoff_status: Column) -> Column:
    """Status of the native stage from counts and the statuses of its parts.

    failed: errors and no library at all. partial: errors, a decompilation that was wanted and is not
    complete or has failures, or an import or handoff that is itself partial or failed.
    """
    short = lambda c: F.coalesce(c.isin("partial", "failed"), F.lit(False))
    undone = wanted & ((F.coalesce(plan_status, F.lit("")) != "completed") | (failures > 0))
    return phase_status((errors > 0) & (libraries == 0), (errors > 0) | undone | short(import_status) | short(handoff_status))


def all_success(status: Column) -> Column:
    """Skipped phases do not count against success."""
    return F.coalesce(F.bool_and(status.isin("success", "skipped")), F.lit(True))


def dependency_state(required: DataFrame, present: DataFrame, upstream: DataFrame) -> DataFrame:
    """One row (required_sources, valid_sources, missing, invalid, failed_upstream, complete).

    required(source, kind), present(source, kind), upstream(phase, status). A source is missing if it is
    absent and invalid if it is of another kind. Every upstream phase must have succeeded.
    """
    got = required.join(present.select("source", F.col("kind").alias("found")), "source", "left")
    absent, odd = F.col("found").isNull(), F.col("found") != F.col("kind")
    state = got.agg(
        F.count("*").alias("required_sources"), F.count_if(~absent & ~odd).alias("valid_sources"),
        F.array_sort(F.collect_set(F.when(absent, F.col("source")))).alias("missing"), F.array_sort(F.collect_set(F.when(odd, F.col("source")))).alias("invalid"),
    )
    bad = upstream.where("status <> 'success'").agg(F.array_sort(F.collect_set("phase")).alias("failed_upstream"))
    # both sides are one row
    return state.crossJoin(bad).withColumn("complete", (F.size("missing") == 0) & (F.size("invalid") == 0) & (F.size("failed_upstream") == 0))


def coverage(done: Column, expected: Column) -> Column:
    """min(1, done / expected) to 4 digits; null without anything expected. Halves go up."""
    return F.when(expected > 0, F.round(F.least(F.lit(1.0), done / expected), 4))
