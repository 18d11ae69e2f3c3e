"""The code stage: one record a source file, its rollups, and evidence units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, rules, text
from ..operators import aggregates, taxonomy
from ..operators.taxonomy import DEFAULT_TAXONOMY, Capability
from .config import Config


def index_files(files: DataFrame, config: Config = Config(), tax: Sequence[Capability] = DEFAULT_TAXONOMY, sketch: str = "blake2b_64") -> DataFrame:
    """One record a file of (file, text[, size]): extracts, capabilities, ownership, hashes and snippets.

    A file whose text is null could not be read: its record has read_status failed, ownership from its
    path, and nulls or empty lists otherwise. All is computed inside the file's row; nothing is shuffled.
    """
    t = F.col("text")
    x = files.withColumn("path_package", rules.package_of_path(F.col("file")))
    ext = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    x = x.withColumns({
        "source_type": ext, "read_status": F.when(t.isNull(), "failed").otherwise("success"), "char_count": F.length(t), "line_count": F.when(t.isNotNull(), F.size(text.lines(t))),
        "sha256": F.sha2(t.cast("binary"), 256), "package": F.coalesce(text.first_match(t, text.PACKAGE), F.col("path_package")), "class_names": text.extract_all(t, text.CLASS),
        "method_names": text.extract_all(t, text.METHOD), "imports": text.extract_all(t, text.IMPORT), "native_methods": text.extract_all(t, text.NATIVE_METHOD),
        "load_libraries": text.extract_all(t, text.LOAD_LIBRARY), "urls": text.extract_all(t, text.URL, 0),
        "hits": taxonomy.classify([t, F.col("file")], tax),
    })
    own = rules.code_ownership(F.col("package"), F.col("file"), config.app_package, config.first_party_prefixes, config.third_party_prefixes)
    return x.withColumns({
        "class_name": F.get("class_names", F.lit(0)), "capabilities": taxonomy.names(F.col("hits")), "ownership": own,
        "sketch": hashing.shingle_sketch(t, algorithm=sketch),
        "score": F.aggregate("hits", F.lit(0), lambda a, h: a + h["score"]),
    })


def readable(index: DataFrame) -> DataFrame:
    return index.where("read_status = 'success'")


def file_order() -> list[Column]:
    """Index records: ownership, best score, file."""
    return [rules.ownership_rank(F.coalesce("ownership.category", F.lit("unknown"))), F.desc("score"), F.col("file")]


def unit_order() -> list[Column]:
    """Units of the code stage: ownership, best confidence, kind, file."""
    return [rules.ownership_rank(F.coalesce("category", F.lit("unknown"))), F.desc(F.coalesce("confidence", F.lit(0.0))), F.coalesce("kind", F.lit("")), F.coalesce("file", F.lit(""))]


def is_comparison() -> Column:
    """Java or Kotlin of the application itself or of unknown origin."""
    return F.col("source_type").isin("java", "kt") & F.col("ownership.category").isin("first_party", "unknown")


def capability_counts(index: DataFrame) -> DataFrame:
    hits = readable(index).select("source_type", "ownership", F.explode("capabilities").alias("name"))
    return aggregates.conditional_counts(hits, "name", F.col("source_type").isin("java", "kt"), F.col("ownership.category"))


def metrics(index: DataFrame, comparison_only: bool = False) -> DataFrame:
    rows = readable(index)
    rows = rows.where(is_comparison()) if comparison_only else rows
    return aggregates.capability_metrics(rows.withColumn("n_methods", F.size("method_names")), "capabilities", "n_methods")


def packages(index: DataFrame) -> DataFrame:
    """Package rollup of code files, in index order: files by ownership, score and name."""
    rows = readable(index).where(F.col("source_type").isin("java", "kt"))
    return aggregates.package_rollup(rows.select(F.coalesce("package", F.lit("<unknown>")).alias("package"), "file", F.col("ownership.category").alias("ownership"), "capabilities"))


def snippets(index: DataFrame, tax: Sequence[Capability] = DEFAULT_TAXONOMY, per_file: int = 12) -> DataFrame:
    return taxonomy.snippet_lines(readable(index).select("file", "text", "hits", "source_type", "package", F.col("ownership.category").alias("category")), "text", "hits", tax, per_file)


def sampled_snippets(snips: DataFrame, limit: int = 40) -> DataFrame:
    """Per capability, snippets in turn over (ownership, package)."""
    rows = snips.withColumn("package", F.coalesce("package", F.lit("<unknown>"))).select("file", "line", "snippet", "source_type", "package", "category", F.explode("capabilities").alias("capability"))
    return aggregates.stratified_per_group(rows, "capability", ["category", "package"], [F.col("file"), F.col("line")], [rules.ownership_rank(F.col("category")), F.col("package")], limit)


def units(index: DataFrame, snips: DataFrame, limit: int = 40) -> DataFrame:
    """Evidence units: one a readable file and one a sampled snippet."""
    n = snips.groupBy("file").agg(F.count("*").alias("n_snippets"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "snippet"))), lambda s: s["snippet"]), "\n").alias("shown"))
    files = readable(index).join(n, "file", "left")
    body = F.concat_ws("\n", "file", F.coalesce("package", F.lit("")), F.array_join("imports", " "), F.array_join("method_names", " "), F.coalesce("shown", F.lit("")))
    whole = files.select(
        hashing.unit_id(F.lit("java"), F.col("file")).alias("unit_id"), F.lit("code").alias("phase"), rules.unit_kind(F.size("native_methods"), F.size("load_libraries"), F.col("file")).alias("kind"),
        "file", "source_type", "package", F.col("ownership.category").alias("category"), rules.signature(F.col("package"), F.col("class_name"), F.col("file")).alias("signature"), "capabilities",
        text.compact(F.col("load_libraries"), 80).alias("native_libraries"), text.compact(F.col("native_methods"), 80).alias("native_methods"), text.compact(F.col("urls"), 40).alias("urls"),
        hashing.token_fingerprint(body).alias("token_fingerprint"), rules.confidence(F.size("capabilities"), F.coalesce("n_snippets", F.lit(0))).alias("confidence"),
    )
    part = sampled_snippets(snips, limit).select(
        hashing.unit_id(F.lit("java_snippet"), F.col("capability"), F.col("file"), F.col("line"), F.col("snippet")).alias("unit_id"), F.lit("code").alias("phase"), F.lit("code_snippet").alias("kind"),
        "file", "source_type", "package", "category", "line", F.array("capability").alias("capabilities"), F.col("snippet").alias("text"), hashing.token_fingerprint(F.col("snippet")).alias("token_fingerprint"),
        F.lit(0.65).alias("confidence"),
    )
    return whole.unionByName(part, allowMissingColumns=True)
