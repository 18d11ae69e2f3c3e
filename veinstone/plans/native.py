"""The native stage: strings, ownership, ranked targets, plan, review tasks and units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, rules, text
from ..operators import linking, ranking, scoring, taxonomy
from .config import Config

LIBRARY = "library string, name string, abi string, sha256 string, size_bytes long, strings array<string>, symbols array<struct<name:string,address:string,size_bytes:bigint,is_jni:boolean>>"


def interesting(libraries: DataFrame, limit: int = 500) -> DataFrame:
    """libraries with interesting strings: (value, capabilities, urls), first `limit` with a hit, and counts over all.

    A string counts if it has a capability or a URL. Everything stays inside the library's row.
    """
    def judge(s: Column) -> Column:
        urls = F.regexp_extract_all(s, F.lit(text.URL), F.lit(0))
        return F.struct(F.substring(s, 1, 500).alias("value"), taxonomy.names(taxonomy.classify(s)).alias("capabilities"), F.slice(urls, 1, 20).alias("urls"))

    rows = libraries.withColumn("__all", F.filter(F.transform(F.coalesce("strings", F.array().cast("array<string>")), judge), lambda r: (F.size(r["capabilities"]) > 0) | (F.size(r["urls"]) > 0)))
    flat = F.flatten(F.transform("__all", lambda r: r["capabilities"]))
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(flat)), lambda c: F.struct(c.alias("key"), F.size(F.filter(flat, lambda y: y == c)).alias("value"))))
    urls = F.slice(F.array_sort(F.array_distinct(F.flatten(F.transform("__all", lambda r: r["urls"])))), 1, 200)
    return rows.withColumns({"interesting_strings": F.slice("__all", 1, limit), "capability_counts": counts, "urls": urls}).drop("__all")


def analyzed(libraries: DataFrame, config: Config = Config()) -> DataFrame:
    """Library records: interesting strings, ownership, ABI role and model signal."""
    jni = F.transform(F.filter(F.coalesce("symbols", F.expr("array()").cast("array<struct<name:string,address:string,size_bytes:bigint,is_jni:boolean>>")), lambda s: s["is_jni"]), lambda s: s["name"])
    x = interesting(libraries).withColumn("ownership", rules.native_ownership(F.col("name"), F.col("sha256"), jni, config.app_package, config.first_party_hashes, config.third_party_hashes))
    arm = x.agg(F.coalesce(F.bool_or(F.lower("abi") == "arm64-v8a"), F.lit(False)).alias("arm64"))
    joined = F.array_join(F.transform("interesting_strings", lambda s: s["value"]), " ")
    # one row: whether any library is for the primary ABI
    return x.crossJoin(F.broadcast(arm)).withColumns({"abi_role": rules.abi_role(F.col("abi"), F.col("arm64")), "model_signal": scoring.model_signal(F.map_keys("capability_counts"), joined)}).drop("arm64")


def symbols(records: DataFrame) -> DataFrame:
    """(library, name, address, kind, ...) a distinct symbol; without any a row of kind library."""
    kind = F.when(F.col("s.is_jni"), "jni_symbol").otherwise("exported_symbol")
    rows = records.select("library", F.col("name").alias("library_name"), "sha256", "abi", "abi_role", "model_signal", "capability_counts", F.col("ownership.category").alias("category"), F.posexplode_outer("symbols").alias("i", "s"))
    rows = rows.select("*", F.coalesce(F.col("s.name"), "library_name").alias("name"), rules.address(F.col("s.address")).alias("address"), F.col("s.size_bytes").alias("size_bytes"), F.when(F.col("s").isNull(), "library").otherwise(kind).alias("kind")).drop("s")
    w = Window.partitionBy("library", "name", "address").orderBy("i")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "i")


def targets(records: DataFrame, hints: DataFrame | None, config: Config = Config()) -> DataFrame:
    """Ranked callable targets within the budgets.

    hints: (library, symbol, address, java_method); symbol null for a library that is only loaded.
    """
    rows = symbols(records).withColumn("t", scoring.text_score(F.concat_ws(" ", "library", F.when(F.col("kind") != "library", F.col("name")))))
    if hints is None:
        rows = rows.withColumns({"n_exact": F.lit(0), "n_library": F.lit(0)})
    else:
        exact = hints.where("symbol is not null").groupBy("library", F.col("symbol").alias("name")).agg(F.count("*").cast("int").alias("n_exact"))
        loose = hints.where("symbol is null").groupBy("library").agg(F.count("*").cast("int").alias("n_library"))
        rows = rows.join(exact, ["library", "name"], "left").join(loose, "library", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_exact", "n_library")})
    role = rules.semantic_role(F.col("name"))
    wanted = F.array(*map(F.lit, config.target_capabilities)).cast("array<string>")
    desired = F.arrays_overlap(F.col("t.capabilities"), wanted) if config.target_capabilities else F.lit(False)
    rows = rows.withColumn("role", F.when(F.col("kind") == "library", "uncertain").otherwise(role["role"]))
    parts = scoring.target_components(F.col("t.score"), F.col("kind"), desired, F.when((F.col("kind") == "library") & (F.col("abi_role") != "primary_production"), "other").otherwise(F.col("abi_role")), F.col("model_signal"),
                                      F.when(F.col("kind") == "library", 0).otherwise(F.col("n_exact")), F.when(F.col("kind") == "library", 0).otherwise(F.col("n_library")), F.col("role") == "wrapper",
                                      F.when(F.col("kind") == "library", "unknown").otherwise(F.col("category")))
    rows = rows.withColumn("score_components", parts).withColumn("score", scoring.total(F.col("score_components"))).where("score > 0")
    rows = rows.withColumn("capabilities", F.col("t.capabilities")).withColumn("reasons", F.col("t.reasons")).drop("t", "capability_counts")
    return ranking.capped(ranking.top_groups(rows, "library", "score", config.max_libraries), ["library"], target_order(), config.per_library, config.max_targets)


def target_order() -> list[Column]:
    """Best score, primary ABI, library, address (as text), name."""
    return [F.desc("score"), (F.col("abi_role") != "primary_production").cast("int"), F.col("library"), F.coalesce("address", F.lit("")), F.col("name")]


def decompile_plan(ranked: DataFrame, config: Config = Config()) -> DataFrame:
    """Callable targets with a wanted capability (all, if none has one) within the plan's budget."""
    rows = ranked.where(rules.is_callable(F.col("kind")))
    if config.target_capabilities:
        hit = rows.where(F.arrays_overlap("capabilities", F.array(*map(F.lit, config.target_capabilities))))
        rows = rows if hit.isEmpty() else hit
    return ranking.budget_plan(rows, "library", target_order(), config.max_decompile_targets, config.max_libraries)


#: Least score of a target that is worth a decompiler, and of one with a capability.
HIGH_SCORE, HIGH_SCORE_WITH_CAPABILITY = 18, 12
#: Decompilers that run unattended.
AUTOMATED = ("rizin", "radare2")


def decompile_decision(ranked: DataFrame, tool: str | None) -> DataFrame:
    """One row (attempt, reason, candidate_count, high_value_target_count, top_score): whether to decompile at all.

    ranked(kind, score, capabilities). tool is the decompiler at hand, or null. The first reason that
    holds counts: no callable target, no tool, a tool that does not run unattended, targets of high
    value, only others. top_score is that of the high-value targets, else of all callable ones.
    """
    score = F.coalesce("score", F.lit(0))
    high = (score >= HIGH_SCORE) | ((F.size(F.coalesce("capabilities", F.array().cast("array<string>"))) > 0) & (score >= HIGH_SCORE_WITH_CAPABILITY))
    n = ranked.where(rules.is_callable(F.col("kind"))).agg(F.count("*").alias("n"), F.count_if(high).alias("h"), F.max(F.when(high, score)).alias("top_high"), F.max(score).alias("top"))
    reason = (
        F.when(F.col("n") == 0, "no_callable_native_targets").when(F.lit(tool is None), "decompiler_missing").when(F.lit(tool not in AUTOMATED), "decompiler_adapter_not_automated")
        .when(F.col("h") > 0, "high_value_native_targets").otherwise("low_value_native_targets")
    )
    judged = F.col("reason").isin("high_value_native_targets", "low_value_native_targets")
    return n.withColumn("reason", reason).select(
        (F.col("reason") == "high_value_native_targets").alias("attempt"), "reason", F.col("n").alias("candidate_count"), F.when(F.col("reason") == "high_value_native_targets", F.col("h")).alias("high_value_target_count"),
        F.when(judged, F.coalesce("top_high", "top")).alias("top_score"),
    )


def function_order() -> list[Column]:
    """Functions of a library: best score, kind, address (as text), name."""
    return [F.desc("score"), F.coalesce("kind", F.lit("")), F.coalesce("address", F.lit("")), F.coalesce("name", F.lit(""))]


def library_order() -> list[Column]:
    """Libraries: most capability hits, name, ABI."""
    total = F.aggregate(F.map_values("capability_counts"), F.lit(0), lambda a, x: a + x)
    return [F.desc(F.coalesce(total, F.lit(0))), F.coalesce("name", F.lit("")), F.coalesce("abi", F.lit(""))]


def native_unit_order() -> list[Column]:
    return [F.desc(F.coalesce("confidence", F.lit(0.0))), F.coalesce("kind", F.lit("")), F.coalesce("name", F.lit(""))]


def feature_order() -> list[Column]:
    """Function features: library, best score, name."""
    return [F.coalesce("library", F.lit("")), F.desc(F.coalesce("score", F.lit(0))), F.coalesce("name", F.lit(""))]


def symbol_order() -> list[Column]:
    return [F.coalesce("address", F.lit("")), F.coalesce("name", F.lit(""))]


def function_index(records: DataFrame, per_library: int | None = None) -> DataFrame:
    """Scored functions of each library with their rank in function_order; per_library keeps the first ones only."""
    rows = symbols(records).withColumn("t", scoring.text_score(F.concat_ws(" ", "library", F.when(F.col("kind") != "library", F.col("name")))))
    rows = rows.withColumn("score", scoring.index_score(F.col("t.score"), F.col("kind"))).withColumn("capabilities", F.col("t.capabilities")).drop("t")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("library").orderBy(*function_order())))
    return rows if per_library is None else rows.where(F.col("rank") <= per_library)


def hints(index: DataFrame, records: DataFrame) -> DataFrame:
    """Java to native links: (library, symbol, address, java_file, java_method, match_type), once each."""
    files = index.select("file", "package", "class_name", "native_methods", F.transform("load_libraries", lambda x: rules.library_stem(x)).alias("stems"), F.size("native_methods").alias("n_methods")).where("n_methods > 0 or size(stems) > 0")
    libs = records.select("library", F.explode(F.array_distinct(F.array(rules.library_stem(F.col("name")), rules.library_stem(F.col("library"))))).alias("stem"))
    pairs = linking.link_by_stem(files, libs)
    loaded = pairs.where("match_type = 'load_library'").select("library", F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("address"), F.col("file").alias("java_file"), F.lit(None).cast("string").alias("java_method"), F.lit("load_library").alias("match_type"))
    methods = pairs.join(files, "file").select("library", "file", "package", "class_name", F.explode("native_methods").alias("method"))
    syms = records.select("library", F.explode("symbols").alias("s")).select("library", F.col("s.name").alias("symbol"), rules.address(F.col("s.address")).alias("address"))
    exact = linking.link_symbols(methods, syms).select("library", "symbol", "address", F.col("file").alias("java_file"), F.col("method").alias("java_method"), F.lit("jni_symbol").alias("match_type"))
    return loaded.unionByName(exact).distinct()


def tasks(records: DataFrame, ranked: DataFrame, links: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """Review tasks: one a function, and one a library for what it does not export.

    The base score is the ranked target's where there is one, else the index score. A function's links
    are those to it, else those to its library without a symbol.
    """
    f = symbols(records).where("kind <> 'library'").withColumn("t", scoring.text_score(F.concat_ws(" ", "library", "name")))
    f = f.withColumn("index_score", scoring.index_score(F.col("t.score"), F.col("kind")))
    best = ranked.groupBy("library", "name").agg(F.max("score").alias("target_score"))
    exact = links.where("symbol is not null").groupBy("library", F.col("symbol").alias("name")).agg(F.count("*").cast("int").alias("n_exact"))
    loose = links.groupBy("library").agg(F.count_if(F.col("symbol").isNull()).cast("int").alias("n_loose"), F.count("*").cast("int").alias("n_links"))
    f = f.join(best, ["library", "name"], "left").join(exact, ["library", "name"], "left").join(loose, "library", "left")
    f = f.join(degree, ["library", "name"], "left") if degree is not None else f.withColumn("degree", F.lit(0))
    n = F.coalesce("n_exact", "n_loose", F.lit(0))
    parts = scoring.task_components(F.coalesce("target_score", "index_score"), n, F.col("abi_role"), F.col("model_signal"), F.coalesce(F.col("degree").cast("int"), F.lit(0)), rules.semantic_role(F.col("name"))["role"] == "wrapper")
    cols = ["library", "library_name", "sha256", "abi", "abi_role"]
    one = f.select(hashing.unit_id(F.lit("ida_task"), F.col("sha256"), F.col("abi"), F.col("address"), F.col("name")).alias("task_id"), F.lit("function").alias("task_type"), *cols, F.col("name").alias("symbol"), "address", parts.alias("score_components"))
    lib = records.select("library", F.col("name").alias("library_name"), "sha256", "abi", "abi_role", "model_signal").join(loose, "library", "left")
    found = scoring.discovery_components(F.coalesce("n_links", F.lit(0)), F.col("abi_role"), F.col("model_signal"))
    none = F.lit(None).cast("string")
    two = lib.select(hashing.unit_id(F.lit("ida_library_discovery"), F.col("sha256"), F.col("abi")).alias("task_id"), F.lit("library_discovery").alias("task_type"), *cols, none.alias("symbol"), none.alias("address"), found.alias("score_components"))
    return one.unionByName(two).withColumn("priority", scoring.total(F.col("score_components")))


def review_queue(rows: DataFrame, limit: int = 120) -> DataFrame:
    """Tasks in turn over (sha256, abi), buckets by their best priority, with a rank."""
    head = rows.groupBy("sha256", "abi").agg(F.max("priority").alias("head"))
    joined = rows.join(head, ["sha256", "abi"])
    order = [F.desc("priority"), (F.col("abi_role") != "primary_production").cast("int"), F.coalesce("library_name", F.lit("")), F.coalesce("address", F.lit("")), F.coalesce("symbol", F.lit(""))]
    return ranking.round_robin(joined, ["sha256", "abi"], order, [F.desc("head"), F.col("sha256"), F.col("abi")], limit, rank="rank").drop("head")


def handoff(queue: DataFrame, libraries: int = 12) -> DataFrame:
    """All queued tasks of the first libraries in rank order."""
    return ranking.first_distinct(queue, ["sha256", "abi"], "rank", libraries)


def units(records: DataFrame, ranked: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Evidence units: one a library, one a target (with its decompiler features, where results has them)."""
    strings = F.slice(F.transform("interesting_strings", lambda s: s["value"]), 1, 80)
    caps = taxonomy.in_taxonomy_order(F.map_keys("capability_counts"))
    names = F.array_join(F.transform(F.coalesce("symbols", F.expr("array()").cast("array<struct<name:string,address:string,size_bytes:bigint,is_jni:boolean>>")), lambda s: s["name"]), " ")
    body = F.concat_ws("\n", "name", F.array_join(caps, " "), names, F.array_join(strings, " "))
    libs = records.select(
        hashing.unit_id(F.lit("native_library"), F.coalesce("sha256", "library"), F.col("abi"), F.col("name")).alias("unit_id"), F.lit("native").alias("phase"), F.lit("native_library").alias("kind"), "library", "name", "abi", "sha256",
        caps.alias("capabilities"), F.col("ownership.category").alias("category"), hashing.token_fingerprint(body).alias("token_fingerprint"), rules.confidence(F.size(caps), F.size(strings)).alias("confidence"),
    )
    rows = ranked
    if results is not None:
        last = linking.last_by(results.select("library", "name", "address", "ord", "success", "feature_hash"), ["library", "name", "address"], [F.col("ord")]).drop("ord")
        rows = rows.join(last.select(F.col("library").alias("__l"), F.col("name").alias("__n"), F.col("address").alias("__a"), "success", "feature_hash"), (F.col("library") == F.col("__l")) & (F.col("name") == F.col("__n")) & F.col("address").eqNullSafe(F.col("__a")), "left")
    else:
        rows = rows.withColumns({"success": F.lit(None).cast("boolean"), "feature_hash": F.lit(None).cast("string")})
    t = rows.select(
        hashing.unit_id(F.lit("native_target"), F.col("library"), F.col("kind"), F.col("name"), F.col("address")).alias("unit_id"), F.lit("native").alias("phase"), F.lit("native_target").alias("kind"), "library", "name", "abi", "sha256",
        "capabilities", "category", "score", "success", "feature_hash", hashing.token_fingerprint(F.concat_ws("\n", "library", "kind", "name", F.lit(""))).alias("token_fingerprint"),
        rules.target_confidence(F.col("score"), F.size("capabilities")).alias("confidence"),
    )
    return libs.unionByName(t, allowMissingColumns=True)


OPS = "array<struct<type:string,opcode:string,disasm:string,comment:string,refs:array<struct<type:string,name:string,addr:string>>>>"
BLOCKS = "array<struct<jump:string,fail:string>>"


def function_features(rows: DataFrame) -> DataFrame:
    """Features of decompiled functions: (library, name, pseudocode, ops, blocks) with ops and blocks as JSON text."""
    ops = F.from_json("ops", OPS)
    x = rows.withColumns({"__ops": F.coalesce(ops, F.expr("array()").cast(OPS)), "__blocks": F.coalesce(F.from_json("blocks", BLOCKS), F.expr("array()").cast(BLOCKS)), "__code": F.coalesce("pseudocode", F.lit(""))})
    said = lambda o: F.concat_ws(" ", o["opcode"], o["disasm"], o["comment"])
    refs = F.flatten(F.transform("__ops", lambda o: F.concat(F.regexp_extract_all(said(o), F.lit(r"(?:str|aav|obj)\.[A-Za-z0-9_.$-]{3,}"), F.lit(0)), F.regexp_extract_all(said(o), F.lit(r'"([^"\n]{4,160})"'), F.lit(1)))))
    strings = F.slice(F.array_sort(F.array_distinct(F.concat(refs, F.regexp_extract_all("__code", F.lit(r'"([^"\n]{4,160})"'), F.lit(1))))), 1, 100)
    code = lambda o: F.coalesce(F.nullif(o["opcode"], F.lit("")), o["disasm"], F.lit(""))
    direct = F.transform(F.filter("__ops", lambda o: F.coalesce(o["type"] == "call", F.lit(False)) | F.startswith(code(o), F.lit("bl ")) | F.contains(F.concat(F.lit(" "), code(o), F.lit(" ")), F.lit(" call "))), lambda o: F.substring(code(o), 1, 240))
    far = F.flatten(F.transform("__ops", lambda o: F.transform(F.filter(F.coalesce(o["refs"], F.expr("array()").cast("array<struct<type:string,name:string,addr:string>>")), lambda r: F.lower(r["type"]).isin("call", "code")), lambda r: F.coalesce(F.nullif(r["name"], F.lit("")), r["addr"]))))
    calls = F.slice(F.array_sort(F.array_distinct(F.array_compact(F.concat(direct, far)))), 1, 200)
    words = F.slice(F.array_compact(F.transform("__ops", lambda o: text.mnemonic(o["type"], F.coalesce(o["opcode"], F.lit(""))))), 1, 3000)
    edges = F.aggregate("__blocks", F.lit(0), lambda a, b: a + b["jump"].isNotNull().cast("int") + b["fail"].isNotNull().cast("int"))
    lines = F.size(F.filter(F.split("__code", r"\r\n|[\n\r]"), lambda s: F.trim(s) != ""))
    x = x.withColumns({
        "instruction_count": F.size("__ops"), "basic_block_count": F.size("__blocks"), "cfg_edge_count": edges, "pseudocode_nonempty_line_count": lines, "mnemonics": words, "call_targets": calls, "string_refs": strings,
        "pseudocode_fingerprint": hashing.token_fingerprint(F.col("__code")),
    })
    toks = F.concat(F.array(F.coalesce("library", F.lit("")), F.coalesce("name", F.lit(""))), F.col("mnemonics"), F.col("call_targets"), F.col("string_refs"), F.array("pseudocode_fingerprint"))
    return x.withColumn("feature_hash", hashing.feature_hash(toks)).drop("__ops", "__blocks", "__code")


def seed_targets(functions: DataFrame, profile: scoring.ProbeProfile, limit: int = 80) -> DataFrame:
    """Functions that a probe profile admits, best first: (library, library_name, name, kind, score, capabilities)."""
    x = linking.first_by(functions, ["library", "name"], [-F.col("score"), F.col("kind")]).withColumn("s", scoring.seed_score(F.col("score"), F.col("library_name"), F.col("name"), F.col("kind"), F.col("capabilities"), profile))
    out = x.where("s.admitted").withColumn("score", F.col("s.score")).drop("s")
    return out.orderBy(F.desc("score"), "library_name", "name").limit(limit)


def strings_of(data: DataFrame, sequence: Sequence[str] = ("library", "bytes")) -> DataFrame:
    """(library, strings) of binaries by the printable-string scan."""
    return data.select(sequence[0], text.printable_strings(F.col(sequence[1])).alias("strings"))
