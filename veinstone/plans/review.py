"""Links and rows for review: the Java to native bridge map, probe reviews and accepted imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, rules, text
from ..operators import linking, taxonomy

#: Candidates that a mapping lists at most, of each kind; beside the lists it counts them all.
LISTED = 40
#: Characters of a name after an underscore by which methods and symbols are brought together.
_KEY = 12
CALL = r"\b(?:sub_[0-9A-Fa-f]+|[A-Za-z_][A-Za-z0-9_:]*)\s*\("


def _stems(*names: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.nullif(rules.library_stem(n), F.lit("")) for n in names])))


def claims(files: DataFrame) -> DataFrame:
    """A row a native method, or a file that only loads libraries: files(file, package, class_name, native_methods, load_libraries)."""
    some = files.where((F.size("native_methods") > 0) | (F.size("load_libraries") > 0))
    methods = F.when(F.size("native_methods") > 0, F.col("native_methods")).otherwise(F.array(F.lit(None).cast("string")))
    rows = some.select("file", "package", "class_name", "load_libraries", F.array_distinct(F.transform("load_libraries", lambda x: rules.library_stem(x))).alias("stems"), F.posexplode(methods).alias("pos", "method"))
    return rows.withColumn("expected", F.when(F.col("method").isNotNull(), rules.jni_prefix(F.col("package"), F.col("class_name"), F.col("method"))))


def _name_keys(name: Column) -> Column:
    """What follows each underscore of a name, cut to 1 to _KEY characters: every method that fits the name has its start here."""
    at = F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substr(name, i, F.lit(1)) == "_")
    return F.array_distinct(F.flatten(F.transform(F.when(F.length(name) > 0, at), lambda i: F.array(*[F.substr(name, i + 1, F.lit(k)) for k in range(1, _KEY + 1)]))))


def _listed(pairs: DataFrame, by: str, order: Sequence[str], limit: int, name: str) -> DataFrame:
    """(by, name, n_name): for each `by` the first `limit` values in order, and how many there are in all."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    first = pairs.withColumn("n", n).where(F.col("n") <= limit)
    first = first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda s: s["value"]).alias(name))
    return pairs.groupBy(by).agg(F.count("*").alias(f"n_{name}")).join(first, by, "left")


def _candidates(wanted: DataFrame, named: DataFrame) -> DataFrame:
    """(want, ord, value): for each want(method, expected, stems) all rows of named(name, stems, ord, value) that may implement it.

    A method is compared only with names that have its first characters after an underscore, whatever the
    number of names; libraries that the file loads must agree where it loads any.
    """
    rows = wanted.select("want", "want.*")
    named = named.withColumnRenamed("stems", "lib")
    start = F.substr("method", F.lit(1), F.least(F.length("method"), F.lit(_KEY)))
    keyed = named.select("name", "lib", "ord", "value", F.explode(_name_keys(F.col("name"))).alias("key"))
    agrees = (F.size("stems") == 0) | F.arrays_overlap("stems", "lib")
    by_name = rows.where("method <> ''").select("*", start.alias("key")).join(keyed, "key")
    by_name = by_name.where(agrees & linking.symbol_matches(F.col("name"), F.col("method"), F.col("expected")))
    loaded = rows.where("method is null").select("want", "stems", F.explode("stems").alias("stem")).join(named.select("lib", F.explode("lib").alias("stem"), "ord", "value"), "stem")
    loaded = loaded.where(F.get(F.array_intersect("stems", "lib"), F.lit(0)) == F.col("stem"))  # once, of however many common stems
    return by_name.select("want", "ord", "value").unionByName(loaded.select("want", "ord", "value"))


def bridge_map(files: DataFrame, symbols: DataFrame, units: DataFrame, limit: int = LISTED) -> DataFrame:
    """One row a claim: matched libraries, candidate symbols and candidate targets, each the first `limit` in order.

    symbols(library, library_name, abi, symbol, address, ord); units(unit_id, kind, name, library, abi,
    score, ord) of the kinds native_library, native_target and manual_ida_function. confidence: candidate
    if there is a symbol or target, else library_only. n_libraries, n_symbols and n_targets count all that
    there are, listed or not. What a claim finds depends on its names and libraries alone, so equal claims
    of many files are looked up once.
    """
    rows = claims(files).withColumn("want", F.struct("method", "expected", "stems"))
    wanted = rows.select("want").distinct()
    value = F.struct("library", "library_name", "abi", "symbol", "address")
    syms = symbols.select(F.col("symbol").alias("name"), _stems(F.col("library_name"), F.col("library")).alias("stems"), "ord", value.alias("value"))
    targets = units.where("kind in ('native_target', 'manual_ida_function')").select("name", _stems(F.col("library")).alias("stems"), "ord", F.struct("unit_id", "library", "name", "abi", "score").alias("value"))
    libs = units.where("kind = 'native_library'").select(F.explode(_stems(F.col("name"), F.col("library"))).alias("stem"), "ord", F.struct("unit_id", "name", "library", "abi").alias("value"))
    matched = rows.select("stems").distinct().select("stems", F.explode("stems").alias("stem")).join(libs, "stem")
    found = rows.join(_listed(_candidates(wanted, syms), "want", ["ord"], limit, "syms"), "want", "left").join(_listed(_candidates(wanted, targets), "want", ["ord"], limit, "tgts"), "want", "left")
    found = found.join(_listed(matched, "stems", ["stem", "ord"], limit, "libs"), "stems", "left")
    listed = lambda c: F.coalesce(c, F.array())
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return found.select(
        F.col("file").alias("java_file"), "package", "class_name", F.col("method").alias("native_method"), F.col("expected").alias("expected_jni_prefix"), "load_libraries",
        listed(F.col("libs")).alias("matched_native_libraries"), listed(F.col("syms")).alias("candidate_symbols"), listed(F.col("tgts")).alias("candidate_native_targets"),
        F.when(F.col("n_syms").isNotNull() | F.col("n_tgts").isNotNull(), "candidate").otherwise("library_only").alias("confidence"),
        n(F.col("n_libs")).alias("n_libraries"), n(F.col("n_syms")).alias("n_symbols"), n(F.col("n_tgts")).alias("n_targets"),
    )


def merged_rounds(first: DataFrame, second: DataFrame) -> DataFrame:
    """Results of two probe rounds with the round's number; columns of one side only are null in the other."""
    return first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)), allowMissingColumns=True)


def probe_reviews(results: DataFrame, probe: str) -> DataFrame:
    """Review rows of a probe: results(library, name, kind, score, capabilities, success, error, stderr, features...) plus outcomes.

    The features are instruction_count, basic_block_count, cfg_edge_count, pseudocode_line_count and
    feature_hash, as plans.native.function_features gives them.
    """
    o = rules.probe_outcome(F.col("success"), F.col("error"), F.col("stderr"), F.col("name"), F.col("instruction_count"), F.col("basic_block_count"), F.col("pseudocode_line_count"))
    rows = results.withColumn("__o", o)
    return rows.select(
        hashing.unit_id(F.lit("native_probe"), F.lit(probe), F.col("library"), F.col("name")).alias("unit_id"), F.lit("native_probe").alias("phase"), F.lit("native_probe_target").alias("kind"), F.lit(probe).alias("probe"),
        "library", rules.file_name(F.col("library")).alias("library_name"), "name", F.col("kind").alias("target_kind"), "score", F.coalesce("capabilities", F.array().cast("array<string>")).alias("capabilities"),
        "success", "error", "__o.outcome", "__o.outcome_class", "__o.research_value", "feature_hash", "instruction_count", "basic_block_count", "cfg_edge_count",
    )


def review_order() -> list[Column]:
    """Probe reviews: outcome class, best score, library, name."""
    return [F.coalesce("outcome_class", F.lit("")), F.desc(F.coalesce("score", F.lit(0))), F.coalesce("library_name", F.lit("")), F.coalesce("name", F.lit(""))]


def seed_order() -> list[Column]:
    return [F.desc(F.coalesce("score", F.lit(0))), F.coalesce("library_name", F.lit("")), F.coalesce("name", F.lit(""))]


def import_evidence(accepted: DataFrame) -> DataFrame:
    """Evidence units of accepted manual results, as linking.validate_import leaves them (error is null)."""
    code = F.coalesce("pseudocode", F.lit(""))
    calls = F.least(F.regexp_count(code, F.lit(CALL)), F.lit(200))
    sha, abi = F.lower("library_sha256"), F.col("abi")
    rows = accepted.where("error is null").withColumn("__r", rules.semantic_role(F.col("symbol"), code, calls=calls))
    lines = F.filter(text.lines(code), lambda x: F.trim(x) != "")
    fingerprint = hashing.token_fingerprint(code, 200_000)
    return rows.select(
        hashing.unit_id(F.lit("manual_ida"), sha, abi, F.col("address"), F.col("symbol")).alias("unit_id"), F.lit("native").alias("phase"), F.lit("manual_ida_function").alias("kind"), F.lit("ida_classroom_manual").alias("evidence_source"),
        F.lit(True).alias("decompiled"), (F.col("__r.role") == "algorithm").alias("algorithm_body_candidate"), F.lit(False).alias("algorithm_recovered"), "task_id", "library_name", sha.alias("library_sha256"), sha.alias("sha256"), "abi", "address",
        "symbol", F.col("symbol").alias("name"), F.col("verification").alias("identity_verification"), F.col("__r.role").alias("semantic_role"), F.col("__r.confidence").alias("semantic_confidence"), F.col("__r.reasons").alias("semantic_reasons"),
        taxonomy.names(taxonomy.classify(F.concat_ws("\n", "symbol", F.substring(code, 1, 200_000)))).alias("capabilities"), F.substring(code, 1, 6000).alias("pseudocode_excerpt"), F.size(text.lines(code)).alias("pseudocode_line_count"),
        F.size(lines).alias("pseudocode_nonempty_line_count"), F.sha2(code, 256).alias("pseudocode_sha256"), fingerprint.alias("pseudocode_fingerprint"), fingerprint.alias("token_fingerprint"),
        F.when(F.col("verification") == "binary_hash_verified_manifest_task_metadata_matched", 0.82).otherwise(0.75).alias("confidence"),
    )
