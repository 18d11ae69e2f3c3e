"""The evidence stage: union of units, comparison filter, sample, counts and report."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unit_id
from ..functions.rules import dangerous
from ..operators import aggregates, ranking
from ..sources.documents import markdown_table

SAMPLE = 250
# The packet's columns of a unit, in order.
COLUMNS = (
    "unit_id", "kind", "phase", "source_type", "label", "file", "path", "line", "apk", "entry", "split", "package", "ownership", "class_name", "method_names", "native_methods",
    "native_libraries", "library", "library_name", "library_sha256", "abi", "address", "symbol", "target_kind", "name", "model_path", "sha256", "size_bytes", "capabilities", "confidence",
    "score", "reasons", "feature_hash", "pseudocode_path", "pseudocode_excerpt", "pseudocode_fingerprint", "evidence_source", "identity_verification", "decompiled", "algorithm_recovered",
    "algorithm_body_candidate", "semantic_role", "semantic_confidence", "semantic_reasons", "instruction_count", "basic_block_count", "cfg_edge_count", "call_targets", "string_refs",
    "token_fingerprint", "token_shingle_signature", "graph_fingerprint", "subgraph_count", "operator_count", "tensor_count", "operator_counts", "source_file",
)
#: Columns that are the first non-empty of several, and units' own names for packet columns.
FIRST_OF = {"label": ("signature", "name", "path", "file"), "name": ("name", "symbol"), "model_path": ("model_path", "path"), "ownership": ("ownership", "category"), "apk": ("apk", "archive")}


def union_units(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All units with the name of the table they come from; missing columns are null, missing ids are made."""
    def ready(name: str, df: DataFrame) -> DataFrame:
        got = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
        made = unit_id(F.lit(name), got("kind"), F.coalesce(got("file"), got("path"), got("library")), got("name"))
        return df.withColumn("unit_id", F.coalesce(got("unit_id"), made)).withColumn("source_file", F.lit(name))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [ready(n, d) for n, d in parts.items()])


def unit_order() -> list[Column]:
    return [F.desc(F.coalesce("confidence", F.lit(0.0))), F.coalesce("phase", F.lit("")), F.coalesce("kind", F.lit("")), F.coalesce("unit_id", F.lit(""))]


def is_dependency() -> Column:
    return F.col("phase").isin("code", "native") & F.coalesce("category", F.lit("unknown")).isin("third_party", "platform")


def comparison(units: DataFrame) -> DataFrame:
    """Units of the application: no dependencies, and of the code phase only Java and Kotlin."""
    ext = F.lower(F.coalesce(F.nullif("source_type", F.lit("")), F.regexp_extract(F.coalesce("file", F.lit("")), r"\.([^./]+)$", 1)))
    code = F.when(ext != "", ext.isin("java", "kt")).otherwise(F.col("kind") != "resource_source")
    return units.where(~is_dependency() & ~((F.col("phase") == "code") & ~code))


def sample(units: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """Units in turn over (phase, kind, alphabetically first capability)."""
    caps = F.array_sort(F.coalesce("capabilities", F.array().cast("array<string>")))
    rows = units.withColumns({"__p": F.coalesce("phase", F.lit("unknown")), "__k": F.coalesce("kind", F.lit("unknown")), "__c": F.coalesce(F.get(caps, F.lit(0)), F.lit("<none>"))})
    score = F.coalesce("score", F.lit(0)) if "score" in units.columns else F.lit(0)
    order = [F.desc(F.coalesce("confidence", F.lit(0.0))), F.desc(score), F.coalesce("unit_id", F.lit(""))]
    key = ["__p", "__k", "__c"]
    return ranking.round_robin(rows, key, order, [F.col(k) for k in key], limit).drop(*key)


def kind_counts(units: DataFrame, chosen: DataFrame) -> DataFrame:
    """(phase, kind, discovered, selected, excluded)."""
    return ranking.selection_counts(units, chosen, ["phase", "kind"])


def capability_totals(units: DataFrame) -> DataFrame:
    """Counts by capability and phase, and totals by capability. Units of phases differ: totals do not compare."""
    rows = units.select("phase", F.explode("capabilities").alias("capability"))
    return rows.rollup("capability", "phase").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where("level < 3").drop("level")


def report(title: str, counts: DataFrame, totals: DataFrame, limit: int = 200) -> str:
    """A short Markdown report from two small aggregates; a table of more than `limit` rows says how many it has left out."""

    def shown(table: DataFrame, *order: str) -> list[str]:
        rows = table.orderBy(*order).limit(limit + 1).collect()
        out = [markdown_table(rows[:limit], table.columns)]
        return out if len(rows) <= limit else [*out, "", f"{table.count() - limit} further rows are in the tables."]

    note = "Totals over phases mix different units and do not compare between inputs."
    return "\n".join([f"# {title}", "", "## Units", "", *shown(counts, "phase", "kind"), "", "## Capabilities", "", note, "", *shown(totals, "capability", "phase"), ""])


def high_value(units: DataFrame) -> DataFrame:
    """The packet's columns of units; columns that no table has are null, and no capabilities an empty list."""
    kind = dict(units.dtypes)

    def column(c: str) -> Column:
        found = [F.nullif(F.col(x), F.lit("")) if kind[x] == "string" else F.col(x) for x in FIRST_OF.get(c, (c,)) if x in kind]
        if c == "capabilities":
            found.append(F.array().cast("array<string>"))
        return (F.coalesce(*found) if found else F.lit(None).cast("string")).alias(c)

    return units.select(*map(column, COLUMNS))


def models(records: DataFrame, limit: int = 40) -> DataFrame:
    """The first models by archive and path, with their facts, for the packet."""
    m = F.col("model")
    rows = records.where("kind = 'model'").orderBy("archive", "path").limit(limit)
    return rows.select(
        F.col("archive").alias("apk"), "path", F.col("entry_size").alias("size_bytes"), "sha256", m["format"].alias("format"), m["tflite_magic_present"].alias("tflite_magic_present"), m["tflite_magic_offsets"].alias("tflite_magic_offsets"),
        m["embedded_tflite_magic_present"].alias("embedded_tflite_magic_present"), m["likely_wrapped_or_encrypted"].alias("likely_wrapped_or_encrypted"), m["entropy_first_mb"].alias("entropy_first_mb"),
        m["operator_hints"].alias("operator_hints"), m["capabilities"].alias("capabilities"), F.slice(m["strings_sample"], 1, 20).alias("strings_sample"),
    )


def brief_manifest(manifests: DataFrame) -> DataFrame:
    """A manifest's row in short: its lists as counts, and its dangerous permissions by name.

    manifests(apk, success, status, completeness_score, field_warnings, package, app_name, version_name,
    version_code, permissions, activities, services, receivers, providers).
    """
    size = lambda c: F.coalesce(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0))
    parts = ("activities", "services", "receivers", "providers")
    return manifests.select(
        "apk", "success", "status", "completeness_score", size(F.col("field_warnings")).alias("field_warning_count"), "package", "app_name", "version_name", "version_code", size(F.col("permissions")).alias("permissions_count"),
        dangerous(F.coalesce("permissions", F.array().cast("array<string>"))).alias("dangerous_permissions"), F.struct(*[size(F.col(c)).alias(c) for c in parts]).alias("component_counts"),
    )


def url_lists(code: DataFrame, native: DataFrame, limit: int = 100) -> DataFrame:
    """(source, urls): the first distinct URLs of both stages, cut before they are gathered; inputs have a urls array."""
    rows = code.select(F.lit("code_urls").alias("source"), F.explode("urls").alias("url")).unionByName(native.select(F.lit("native_urls").alias("source"), F.explode("urls").alias("url")))
    return aggregates.distinct_lists(rows, "source", "url", limit).select("source", F.col("values").alias("urls"))


def packet(units: DataFrame, header: Mapping[str, Any], limit: int = SAMPLE) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """(sample, counts, header with the numbers of the selection)."""
    own = comparison(units)
    chosen = sample(own, limit)
    counts = kind_counts(own, chosen)
    got = counts.agg(F.sum("discovered").alias("d"), F.sum("selected").alias("s"), F.sum("excluded").alias("e")).first()
    excluded = units.where(is_dependency()).groupBy("phase").count().collect()
    return high_value(chosen), counts, {**header, "units": got["d"] or 0, "selected": got["s"] or 0, "excluded": got["e"] or 0, "dependency_units": {r["phase"]: r["count"] for r in excluded}}
