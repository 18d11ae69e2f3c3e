"""Registered queries of whole stages and their parts over the driver's tables, with the SQL that states them.

Bound by shape as in queries.py: parts stand for archive entries, suppliers for libraries, orders for
functions, documents for source files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, rules, text
from .operators import aggregates, quality, scoring, taxonomy
from .plans import code_index, native, packet, resources, review
from .plans.config import Config
from .queries import SF, _NORMAL, query, source_files, table
from .sources import archives as src

# ---- archives


def _entry_path() -> Column:
    k = F.col("p_partkey")
    return (
        F.when(k % 11 == 0, "AndroidManifest.xml").when(k % 11 == 1, F.concat(F.lit("classes"), k, F.lit(".dex"))).when(k % 11 == 2, F.concat(F.lit("lib/arm64-v8a/lib"), k, F.lit(".so")))
        .when(k % 11 == 3, F.concat(F.lit("lib/x86/Lib"), k, F.lit(".SO"))).when(k % 11 == 4, F.concat(F.lit("assets/net"), k, F.lit(".tflite"))).when(k % 11 == 5, F.concat(F.lit("assets/ocr_"), k, F.lit(".json")))
        .when(k % 11 == 6, F.concat(F.lit("res/plain"), k, F.lit(".xml"))).when((k % 11 == 7) & (k % 5 == 0), F.concat(F.lit("../out"), k)).otherwise(F.concat(F.lit("assets/x"), k, F.lit(".bin")))
    )


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entries of archives (a manufacturer and brand each)."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.concat(F.lit("splits/"), F.when(k % 97 == 0, "base").otherwise(F.concat(F.lit("split_config."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))))), F.lit(".apk")).alias("archive"), _entry_path().alias("path"),
        F.col("p_size").cast("long").alias("entry_size"), F.lit(False).alias("is_dir"), F.lit(None).cast("string").alias("error"),
    )


_ENTRIES = """en AS (SELECT 'splits/' || CASE WHEN p_partkey % 97 = 0 THEN 'base' ELSE 'split_config.' || lower(replace(p_brand, '#', '_')) END || '.apk' AS archive, CAST(p_size AS BIGINT) AS entry_size, p_partkey,
    CASE WHEN p_partkey % 11 = 0 THEN 'AndroidManifest.xml' WHEN p_partkey % 11 = 1 THEN 'classes' || p_partkey || '.dex' WHEN p_partkey % 11 = 2 THEN 'lib/arm64-v8a/lib' || p_partkey || '.so' WHEN p_partkey % 11 = 3 THEN 'lib/x86/Lib' || p_partkey || '.SO'
         WHEN p_partkey % 11 = 4 THEN 'assets/net' || p_partkey || '.tflite' WHEN p_partkey % 11 = 5 THEN 'assets/ocr_' || p_partkey || '.json' WHEN p_partkey % 11 = 6 THEN 'res/plain' || p_partkey || '.xml'
         WHEN p_partkey % 11 = 7 AND p_partkey % 5 = 0 THEN '../out' || p_partkey ELSE 'assets/x' || p_partkey || '.bin' END AS path FROM part),
    ek AS (SELECT *, CASE WHEN path = 'AndroidManifest.xml' THEN 'manifest' WHEN path LIKE '%.dex' THEN 'dex' WHEN path LIKE 'lib/%' THEN 'native' WHEN path LIKE '%.tflite' THEN 'model' WHEN path LIKE '%ocr_%.json' THEN 'resource' ELSE 'other' END AS kind FROM en)"""
_ZIP_ERROR = "CASE WHEN min(path) FILTER (WHERE starts_with(path, '../')) IS NOT NULL THEN 'unsafe_member:' || min(path) FILTER (WHERE starts_with(path, '../')) WHEN max(entry_size) > 45 THEN 'entry_too_large' WHEN sum(entry_size) > 1500 THEN 'archive_too_large' END"


@query(f"WITH {_ENTRIES} SELECT path, kind FROM ek")
def q_entry_kind(spark: SparkSession, d: str) -> DataFrame:
    rows = _entries(spark, d)
    return rows.select("path", rules.entry_kind(F.col("path"), F.size(taxonomy.classify(F.col("path"))) > 0).alias("kind"))


@query(f"WITH {_ENTRIES} SELECT archive, count(*) AS entry_count, CAST(sum(entry_size) AS BIGINT) AS total_bytes, {_ZIP_ERROR} AS zip_error FROM en GROUP BY 1")
def q_archive_limits(spark: SparkSession, d: str) -> DataFrame:
    return src.check_limits(_entries(spark, d), src.Limits(entry_bytes=45, total_bytes=1500))


_INVENTORY = f"""{_ENTRIES}, iv AS (SELECT archive, count(*) AS entry_count, count(*) FILTER (WHERE kind = 'dex') AS dex_count, count(*) FILTER (WHERE kind = 'native') AS native_library_count, count(*) FILTER (WHERE kind = 'model') AS model_file_count,
    count(*) FILTER (WHERE kind = 'resource') AS resource_candidate_count, bool_or(kind = 'manifest') AS manifest_present, bool_or(starts_with(path, '../')) AS unsafe, bool_or(kind = 'resource') AS ocr, bool_or(kind = 'model') AS ml,
    CASE WHEN archive = 'splits/base.apk' THEN 'base' ELSE 'config_other' END AS split_type FROM ek GROUP BY 1)"""


@query(f"""WITH {_INVENTORY} SELECT archive, entry_count, dex_count, native_library_count, model_file_count, resource_candidate_count, manifest_present, split_type, NOT unsafe AND manifest_present AS success,
    concat_ws(',', CASE WHEN unsafe THEN 'unsafe_member' END, CASE WHEN NOT manifest_present THEN 'android_manifest_missing' END) AS errors, concat_ws(',', CASE WHEN ocr THEN 'ocr' END, CASE WHEN ml THEN 'local_ml' END) AS capabilities FROM iv""")
def q_inventory(spark: SparkSession, d: str) -> DataFrame:
    rows = src.inventory(_entries(spark, d))
    errors = F.transform("validation_errors", lambda e: F.regexp_replace(e, ":.*$", ""))
    return rows.select("archive", "entry_count", *[F.col(c).cast("long").alias(c) for c in ("dex_count", "native_library_count", "model_file_count", "resource_candidate_count")], "manifest_present", "split_type", "success", F.array_join(errors, ",").alias("errors"), F.array_join("capabilities", ",").alias("capabilities"))


@query(f"""WITH {_INVENTORY} SELECT count(*) AS archives, count(*) > 1 AS has_splits, count(*) FILTER (WHERE dex_count > 0) AS dex_archives, count(*) FILTER (WHERE native_library_count > 0) AS native_archives, count(*) FILTER (WHERE model_file_count > 0) AS model_archives,
    count(*) FILTER (WHERE unsafe OR NOT manifest_present) AS invalid_archives, array_to_string(list_sort(list_distinct(list(split_type))), ',') AS split_types FROM iv""")
def q_split_summary(spark: SparkSession, d: str) -> DataFrame:
    return src.split_summary(src.inventory(_entries(spark, d))).withColumn("split_types", F.array_join("split_types", ","))


@query(f"WITH {_ENTRIES} SELECT archive, path, string_split(path, '/')[2] AS abi, string_split(path, '/')[3] AS name, entry_size FROM ek WHERE kind = 'native'")
def q_native_entries(spark: SparkSession, d: str) -> DataFrame:
    return src.native_entries(_entries(spark, d))


@query(f"""WITH {_ENTRIES}, a AS (SELECT archive, CAST(sum(entry_size) AS BIGINT) AS size, bool_or(kind = 'dex') AS has_dex FROM ek GROUP BY 1) SELECT archive, size, has_dex FROM a WHERE archive <> 'splits/base.apk' ORDER BY has_dex DESC, size DESC, archive LIMIT 1""")
def q_select_primary(spark: SparkSession, d: str) -> DataFrame:
    rows = _entries(spark, d).where("archive <> 'splits/base.apk'").groupBy("archive").agg(F.sum("entry_size").alias("size"), F.bool_or(F.endswith("path", F.lit(".dex"))).alias("has_dex"))
    return src.select_primary(rows)


@query(f"""WITH {_ENTRIES}, c AS (SELECT archive, path, entry_size, CASE WHEN kind = 'model' THEN 'model' ELSE 'resource_candidate' END AS kind, CASE WHEN kind = 'model' THEN 20 ELSE 3 END AS score FROM ek WHERE kind = 'model' OR path LIKE '%ocr_%.json'),
    r AS (SELECT *, row_number() OVER (PARTITION BY archive, kind ORDER BY score DESC, path) AS n FROM c)
    SELECT archive, count(*) FILTER (WHERE kind = 'model') AS models_discovered, count(*) FILTER (WHERE kind <> 'model') AS resources_discovered, count(*) FILTER (WHERE kind = 'model') AS models, count(*) FILTER (WHERE kind <> 'model' AND n <= 3) AS resources,
           count(*) FILTER (WHERE kind <> 'model' AND n > 3) AS resources_excluded FROM r GROUP BY 1""")
def q_resource_summary(spark: SparkSession, d: str) -> DataFrame:
    found = resources.candidates(_entries(spark, d))
    return resources.summary(found, resources.selected(found, 3))


@query(f"WITH {_ENTRIES} SELECT coalesce(nullif(regexp_extract(path, '(\\.[^./]+)$', 1), ''), '') AS extension, count(*) AS files, CAST(sum(entry_size) AS BIGINT) AS bytes FROM (SELECT lower(path) AS path, entry_size FROM en) GROUP BY 1")
def q_by_extension(spark: SparkSession, d: str) -> DataFrame:
    return src.by_extension(_entries(spark, d).select(F.col("path").alias("file"), F.col("entry_size").alias("size")))


# ---- rules


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'native_bridge' WHEN o_orderkey % 2 = 0 THEN 'resource_source' ELSE 'source_file' END AS kind, 'a.b' || o_custkey AS package, 'base' AS split,
    CASE WHEN o_orderkey % 7 = 0 THEN 'base/sources/a/b' || o_custkey || '/F' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.xml' ELSE '.java' END ELSE 'a.b' || o_custkey || '.C' || o_orderkey END AS signature FROM orders""")
def q_file_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.concat(F.lit("base/sources/a/b"), "o_custkey", F.lit("/F"), k, F.when(k % 2 == 0, ".xml").otherwise(".java"))
    rows = table(spark, d, "orders").select("o_orderkey", path.alias("path"), F.when(k % 7 != 0, F.concat(F.lit("C"), k)).alias("cls"))
    package = rules.package_of_path(F.col("path"))
    return rows.select("o_orderkey", rules.unit_kind((k % 3 == 0).cast("int"), (k % 5 == 0).cast("int"), F.col("path")).alias("kind"), package.alias("package"), rules.split_name(F.col("path")).alias("split"), rules.signature(package, F.col("cls"), F.col("path")).alias("signature"))


@query("""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'first_party' WHEN 1 THEN 'first_party' WHEN 2 THEN 'platform' WHEN 3 THEN 'third_party' WHEN 4 THEN 'third_party' WHEN 5 THEN 'unknown' WHEN 6 THEN 'third_party' ELSE 'unknown' END AS category,
    CAST(CASE p_partkey % 9 WHEN 0 THEN 1.0 WHEN 1 THEN 0.98 WHEN 2 THEN 0.98 WHEN 3 THEN 1.0 WHEN 4 THEN 0.92 WHEN 5 THEN 0.45 WHEN 6 THEN 0.75 ELSE 0.25 END AS DOUBLE) AS confidence FROM part""")
def q_ownership_cascade(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 9
    package = F.when(k == 0, "own.lib.x").when(k == 1, "com.acme.app.ui").when(k == 2, "android.view").when(k == 3, "dep.one").when(k == 4, "okhttp3.internal").when(k == 5, "com.acme.other").when(k == 6, "q.r").when(k == 7, "q.r").otherwise("")
    path = F.when(k == 6, "x/vendor/y.java").otherwise("a/b.java")
    own = rules.code_ownership(package, path, "com.acme.app", ("own.lib",), ("dep",))
    return table(spark, d, "part").select("p_partkey", own["category"].alias("category"), own["confidence"].alias("confidence"))


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'first_party' WHEN 1 THEN 'third_party' WHEN 2 THEN 'first_party' WHEN 3 THEN 'platform' WHEN 4 THEN 'third_party' ELSE 'unknown' END AS category,
    CAST(CASE s_suppkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 WHEN 3 THEN 0.95 WHEN 4 THEN 0.9 ELSE 0.3 END AS DOUBLE) AS confidence FROM supplier""")
def q_native_ownership(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 6
    name = F.when(k == 3, rules.PLATFORM_LIBRARIES[0]).when(k == 4, rules.THIRD_PARTY_LIBRARIES[0]).otherwise(F.concat(F.lit("libq"), "s_suppkey", F.lit(".so")))
    sha = F.when(k == 0, "A" * 64).when(k == 1, "b" * 64).otherwise("c" * 64)
    own = rules.native_ownership(name, sha, F.when(k == 2, F.array(F.lit("Java_com_acme_app_Main_run"))), "com.acme.app", ("a" * 64,), ("b" * 64,))
    return table(spark, d, "supplier").select("s_suppkey", own["category"].alias("category"), own["confidence"].alias("confidence"))


@query("""SELECT o_orderkey, round(least(0.95, 0.35 + least(o_custkey, 60) / 100.0 + 0.05 * (o_orderkey % 4)), 6) AS confidence, 'Java_a_b' || o_custkey || '_C_1_run' || o_orderkey AS prefix, 'Scan' || o_custkey AS stem, 'f_' || o_orderkey || '_x' AS safe,
    o_orderkey % 3 <> 2 AS callable FROM orders""")
def q_name_rules(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 3 == 0, "jni_symbol").when(k % 3 == 1, "exported_symbol").otherwise("string")
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(rules.target_confidence(c, k % 4), 6).alias("confidence"), rules.jni_prefix(F.concat(F.lit("a.b"), c), F.lit("C$1"), F.concat(F.lit("run"), k)).alias("prefix"),
        rules.library_stem(F.concat(F.lit("x/libScan"), c, F.lit(".so")), lower=False).alias("stem"), rules.safe_name(F.concat(F.lit("..f /"), k, F.lit("?x._"))).alias("safe"), rules.is_callable(kind).alias("callable"),
    )


# ---- code stage


@query(f"""WITH {SF} SELECT file, sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS char_count, CAST(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS BIGINT) AS line_count, 'success' AS read_status, lang AS source_type FROM sf
    UNION ALL SELECT 'gone/' || p_partkey || '.java', NULL, NULL, NULL, 'failed', 'java' FROM part""")
def q_index_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("file"), "text", "lang")
    index = code_index.index_files(files.select(F.concat("file", F.lit("."), "lang").alias("file"), "text").unionByName(table(spark, d, "part").select(F.concat(F.lit("gone/"), "p_partkey", F.lit(".java")).alias("file"), F.lit(None).cast("string").alias("text"))))
    name = F.when(F.col("read_status") == "success", F.regexp_replace("file", r"\.[^.]*$", "")).otherwise(F.col("file"))
    return index.select(name.alias("file"), "sha256", F.col("char_count").cast("long").alias("char_count"), F.col("line_count").cast("long").alias("line_count"), "read_status", "source_type")


@query(f"""WITH {SF} SELECT substr(sha256('java' || chr(31) || source || '/' || doc_id || '.' || source_type), 1, 24) AS unit_id, CASE WHEN source_type = 'xml' THEN 'resource_source' ELSE 'source_file' END AS kind, source || '/' || doc_id || '.' || source_type AS file,
    sha256({_NORMAL.format(x="source || '/' || doc_id || '.' || source_type || chr(10) || chr(10) || chr(10) || chr(10)")}) AS token_fingerprint, 0.2::DOUBLE AS confidence FROM sf""")
def q_source_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of files whose texts are left out, so that no capability or method is found in them."""
    files = source_files(spark, d).select(F.concat(F.col("source"), F.lit("/"), "doc_id", F.lit("."), "source_type").alias("file"), F.lit("").alias("text"))
    index = code_index.index_files(files)
    return code_index.units(index, code_index.snippets(index)).select("unit_id", "kind", "file", "token_fingerprint", "confidence")


# ---- packet


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Documents and orders as units of the code and native stages."""
    k = F.col("o_orderkey")
    code = source_files(spark, d).select("file", "source_type", F.col("ownership").alias("category"), F.array("lang").alias("capabilities"), F.lit("code").alias("phase"), F.lit("source_file").alias("kind"), F.lit(0.5).alias("confidence"), F.col("doc_id").cast("string").alias("unit_id"))
    own = table(spark, d, "orders").select(
        F.concat(F.lit("/x/lib"), "o_custkey", F.lit(".so")).alias("library"), F.concat(F.lit("f"), k).alias("name"), F.when(k % 3 == 0, "third_party").when(k % 3 == 1, "first_party").alias("category"), F.array("o_orderstatus").alias("capabilities"),
        F.lit("native").alias("phase"), F.lit("native_target").alias("kind"), (k % 10 / 10).alias("confidence"),
    )
    return packet.union_units({"code_units": code, "native_units": own})


_UNITS = f"""{SF}, u AS (SELECT 'code' AS phase, 'source_file' AS kind, ownership AS category, source_type, lang AS cap, 0.5 AS confidence, CAST(doc_id AS VARCHAR) AS unit_id, 'code_units' AS source_file FROM sf
    UNION ALL SELECT 'native', 'native_target', CASE o_orderkey % 3 WHEN 0 THEN 'third_party' WHEN 1 THEN 'first_party' END, NULL, o_orderstatus, o_orderkey % 10 / 10.0,
    substr(sha256('native_units' || chr(31) || 'native_target' || chr(31) || '/x/lib' || o_custkey || '.so' || chr(31) || 'f' || o_orderkey), 1, 24), 'native_units' FROM orders),
    cu AS (SELECT * FROM u WHERE coalesce(category, 'unknown') NOT IN ('third_party', 'platform') AND (phase <> 'code' OR source_type IN ('java', 'kt')))"""
_SAMPLE = f"""{_UNITS}, rr AS (SELECT *, row_number() OVER (PARTITION BY phase, kind, cap ORDER BY confidence DESC, unit_id) AS turn FROM cu), sm AS (SELECT * FROM rr ORDER BY turn, phase, kind, cap LIMIT 250)"""


@query(f"WITH {_UNITS} SELECT unit_id, phase, source_file FROM u")
def q_unit_union(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("unit_id", "phase", "source_file")


@query(f"WITH {_UNITS} SELECT phase, coalesce(category, 'none') AS category, count(*) AS n FROM cu GROUP BY 1, 2")
def q_comparison_units(spark: SparkSession, d: str) -> DataFrame:
    return packet.comparison(_evidence(spark, d)).groupBy("phase", F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {_UNITS} SELECT cap AS capability, phase, count(*) AS n FROM u GROUP BY ROLLUP (cap, phase) HAVING cap IS NOT NULL")
def q_capability_totals(spark: SparkSession, d: str) -> DataFrame:
    return packet.capability_totals(_evidence(spark, d))


@query(f"WITH {_SAMPLE}, a AS (SELECT phase, kind, count(*) AS discovered FROM cu GROUP BY 1, 2), s AS (SELECT phase, kind, count(*) AS selected FROM sm GROUP BY 1, 2) SELECT phase, kind, discovered, coalesce(selected, 0) AS selected, discovered - coalesce(selected, 0) AS excluded FROM a LEFT JOIN s USING (phase, kind)")
def q_packet_counts(spark: SparkSession, d: str) -> DataFrame:
    return packet.packet(_evidence(spark, d), {})[1]


@query(f"WITH {_SAMPLE} SELECT unit_id, kind, phase, CASE WHEN phase = 'code' THEN category END AS code_category, cap AS capability, CAST(confidence AS DOUBLE) AS confidence, 57 AS n_columns, source_file FROM sm")
def q_packet_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = packet.packet(_evidence(spark, d), {})[0]
    return rows.select("unit_id", "kind", "phase", F.when(F.col("phase") == "code", F.col("ownership")).alias("code_category"), F.col("capabilities")[0].alias("capability"), "confidence", F.lit(len(rows.columns)).alias("n_columns"), "source_file")


@query("SELECT CASE i WHEN 0 THEN 'code_urls' ELSE 'native_urls' END AS source, array_to_string(list_sort(list_distinct(list(url)))[1:100], ' ') AS urls FROM (SELECT page_id % 2 AS i, url FROM pages) GROUP BY i")
def q_url_lists(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.array("url").alias("urls"))
    return packet.url_lists(pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1")).select("source", F.array_join("urls", " ").alias("urls"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS apk, CAST(o_orderkey % 3 AS INT) AS permissions_count, CASE WHEN o_orderkey % 3 = 2 THEN 'x.READ_SMS' ELSE '' END AS dangerous, 1 AS activities, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS INT) AS services, 0 AS providers FROM orders""")
def q_brief_manifest(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    names = F.array().cast("array<string>")
    rows = table(spark, d, "orders").select(
        k.cast("string").alias("apk"), F.lit(True).alias("success"), F.lit("success").alias("status"), F.lit(1.0).alias("completeness_score"), names.alias("field_warnings"), none.alias("package"), none.alias("app_name"), none.alias("version_name"), none.alias("version_code"),
        F.slice(F.array(F.lit("x.INTERNAL"), F.lit("x.READ_SMS")), F.lit(1), (k % 3).cast("int")).alias("permissions"), F.array(F.lit("A")).alias("activities"), F.when(k % 2 == 0, F.array(F.lit("S"), F.lit("T"))).alias("services"), names.alias("receivers"), F.lit(None).cast("array<string>").alias("providers"),
    )
    got = packet.brief_manifest(rows)
    return got.select("apk", "permissions_count", F.array_join("dangerous_permissions", ",").alias("dangerous"), "component_counts.activities", "component_counts.services", "component_counts.providers")


# ---- counters and statuses


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders GROUP BY 1")
def q_counters(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.counters(table(spark, d, "orders"), ["o_orderstatus"], customers=F.col("o_custkey").cast("long"))


@query("SELECT count(*) FILTER (WHERE o_totalprice > 1) > 0 AS any_paid, count(*) FILTER (WHERE o_totalprice < 0) > 0 AS any_debt FROM orders")
def q_flags(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.flags(table(spark, d, "orders"), any_paid=F.col("o_totalprice") > 1, any_debt=F.col("o_totalprice") < 0)


@query("""SELECT round(avg(c), 4) AS average, min(c) AS least, count(*) FILTER (WHERE s = 'success') AS success, count(*) FILTER (WHERE s = 'partial') AS partial, count(*) FILTER (WHERE s = 'failed') AS failed
    FROM (SELECT o_custkey % 64 / 64.0::DOUBLE AS c, CASE o_orderkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'skipped' END AS s FROM orders)""")
def q_completeness_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 64 / 64.0).alias("completeness"), F.when(k == 0, "success").when(k == 1, "partial").when(k == 2, "failed").otherwise("skipped").alias("status"))
    return quality.completeness_summary(rows)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 AND o_custkey % 4 = 0 THEN 'failed' WHEN o_orderkey % 5 = 1 OR o_orderkey % 3 = 0 AND (o_custkey % 2 = 0 OR o_custkey % 7 = 0) OR o_custkey % 11 = 0 THEN 'partial' ELSE 'success' END AS status FROM orders""")
def q_native_status(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = quality.native_status((k % 5 == 1).cast("int"), c % 4, k % 3 == 0, F.when(c % 2 == 1, "completed"), (c % 7 == 0).cast("int"), F.when(c % 11 == 0, "partial").otherwise("completed"), F.lit(None).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", status.alias("status"))


@query("""WITH a AS (SELECT DISTINCT archive, error, present, readable, n FROM (SELECT o_orderkey AS archive, CASE WHEN o_orderkey % 5 = 0 THEN 'bad' END AS error, o_orderkey % 3 <> 0 AS present, o_orderkey % 2 = 0 AS readable, o_orderkey % 4 AS n FROM orders))
    SELECT archive, concat_ws(',', error, CASE WHEN NOT present THEN 'android_manifest_missing' END, CASE WHEN present AND NOT readable THEN 'android_manifest_empty_or_unreadable' END, CASE WHEN error IS NULL AND n = 0 THEN 'empty_apk_archive' END) AS errors,
        error IS NULL AND present AND readable AND n > 0 AS success FROM a""")
def q_archive_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("archive"), F.when(k % 5 == 0, "bad").alias("zip_error"), (k % 3 != 0).alias("manifest_present"), (k % 2 == 0).alias("manifest_readable"), (k % 4).alias("entry_count"))
    return quality.archive_status(rows).select("archive", F.array_join("validation_errors", ",").alias("errors"), "success")


# ---- native stage


def _libraries(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as libraries with two symbols each, of three ABIs."""
    k = F.col("s_suppkey")
    abi = F.when(k % 3 == 0, "arm64-v8a").when(k % 3 == 1, "armeabi-v7a").otherwise("x86")
    none = F.lit(None).cast("string")
    symbol = lambda name, jni: F.struct(name.alias("name"), none.alias("address"), F.lit(8).cast("long").alias("size_bytes"), F.lit(jni).alias("is_jni"))
    syms = F.array(symbol(F.concat(F.lit("Java_q_C_run"), k), True), symbol(F.concat(F.lit("zz"), k), False), symbol(F.concat(F.lit("zz"), k), False))
    return table(spark, d, "supplier").select(
        F.concat(F.lit("lib/"), abi, F.lit("/libq"), k, F.lit(".so")).alias("library"), F.concat(F.lit("libq"), k, F.lit(".so")).alias("name"), abi.alias("abi"), F.sha2(k.cast("string"), 256).alias("sha256"), F.col("s_suppkey").cast("long").alias("size_bytes"),
        F.array(F.lit("zz"), F.when(k % 2 == 0, "tflite").otherwise("http://a.b/c")).alias("strings"), syms.alias("symbols"),
    )


_LIBS = """lb AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'arm64-v8a' WHEN 1 THEN 'armeabi-v7a' ELSE 'x86' END AS abi, sha256(CAST(s_suppkey AS VARCHAR)) AS sha,
    CASE s_suppkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 6 ELSE 0 END AS abi_bonus, CASE WHEN s_suppkey % 2 = 0 THEN 10 ELSE 0 END AS model FROM supplier)"""


@query(f"""WITH {_LIBS} SELECT 'lib/' || abi || '/libq' || k || '.so' AS library, CASE k % 3 WHEN 0 THEN 'primary_production' WHEN 1 THEN 'secondary_production' ELSE 'cross_validation' END AS abi_role, k % 2 = 0 AS model_signal,
    CASE WHEN k % 2 = 0 THEN 'tflite' ELSE 'http://a.b/c' END AS strings, CASE WHEN k % 2 = 0 THEN '' ELSE 'http://a.b/c' END AS urls FROM lb""")
def q_library_records(spark: SparkSession, d: str) -> DataFrame:
    x = native.analyzed(_libraries(spark, d))
    shown = F.transform("interesting_strings", lambda s: s["value"])
    return x.select("library", "abi_role", "model_signal", F.array_join(F.filter(shown, lambda v: ~F.startswith(v, F.lit("http"))), ",").alias("texts"), F.array_join(shown, ",").alias("all"), F.array_join("urls", ",").alias("urls")).select("library", "abi_role", "model_signal", F.col("all").alias("strings"), "urls")


@query(f"""WITH {_LIBS}, f AS (SELECT k, abi, sha, 'Java_q_C_run' || k AS name, CAST(abi_bonus + model AS BIGINT) AS bonus, 10 AS kind_bonus FROM lb UNION ALL SELECT k, abi, sha, 'zz' || k, abi_bonus + model, 4 FROM lb)
    SELECT substr(sha256('ida_task' || chr(31) || sha || chr(31) || abi || chr(31) || name), 1, 24) AS task_id, 'function' AS task_type, CAST(bonus + kind_bonus AS BIGINT) AS priority FROM f
    UNION ALL SELECT substr(sha256('ida_library_discovery' || chr(31) || sha || chr(31) || abi), 1, 24), 'library_discovery', 1 + abi_bonus + model FROM lb""")
def q_review_tasks(spark: SparkSession, d: str) -> DataFrame:
    records = native.analyzed(_libraries(spark, d))
    none = spark.createDataFrame([], "library string, symbol string, name string, score int")
    out = native.tasks(records, none.select("library", "name", "score"), none.select("library", "symbol"))
    return out.select("task_id", "task_type", F.col("priority").cast("long").alias("priority"))


@query(f"""WITH {_LIBS}, f AS (SELECT k, 'lib/' || abi || '/libq' || k || '.so' AS library, 'Java_q_C_run' || k AS name, 10 AS score, 1 AS rank FROM lb UNION ALL SELECT k, 'lib/' || abi || '/libq' || k || '.so', 'zz' || k, 4, 2 FROM lb) SELECT library, name, score, rank FROM f""")
def q_function_index(spark: SparkSession, d: str) -> DataFrame:
    return native.function_index(native.analyzed(_libraries(spark, d))).select("library", "name", F.col("score").cast("int").alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {_LIBS} SELECT substr(sha256('native_library' || chr(31) || sha || chr(31) || abi || chr(31) || 'libq' || k || '.so'), 1, 24) AS unit_id, 'native_library' AS kind, CASE WHEN k % 2 = 0 THEN 'local_ml' ELSE '' END AS capability FROM lb""")
def q_library_units(spark: SparkSession, d: str) -> DataFrame:
    records = native.analyzed(_libraries(spark, d))
    rows = native.units(records, native.targets(records, None)).where("kind = 'native_library'")
    return rows.select("unit_id", "kind", F.array_join("capabilities", ",").alias("capability"))


@query("""WITH t AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'jni_symbol' WHEN 1 THEN 'exported_symbol' ELSE 'string' END AS kind, CAST(l_quantity AS INT) % 20 AS score, l_returnflag = 'R' AS cap FROM lineitem), c AS (SELECT *, score >= 18 OR cap AND score >= 12 AS high FROM t WHERE kind <> 'string')
    SELECT count(*) FILTER (WHERE high) > 0 AS attempt, 'high_value_native_targets' AS reason, count(*) AS candidate_count, count(*) FILTER (WHERE high) AS high_value_target_count, max(score) FILTER (WHERE high) AS top_score FROM c""")
def q_decompile_decision(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    kind = F.when(n == 0, "jni_symbol").when(n == 1, "exported_symbol").otherwise("string")
    rows = table(spark, d, "lineitem").select(kind.alias("kind"), (F.col("l_quantity").cast("int") % 20).alias("score"), F.when(F.col("l_returnflag") == "R", F.array(F.lit("ocr"))).alias("capabilities"))
    return native.decompile_decision(rows, "rizin")


@query("""WITH f AS (SELECT p_partkey AS k FROM part), s AS (SELECT s_suppkey AS k FROM supplier)
    SELECT 'F' || f.k AS java_file, 'run' || f.k % 100 AS native_method, 'Java_q_C_run' || f.k % 100 AS expected_jni_prefix, CAST(CASE WHEN f.k % 2 = 0 THEN (SELECT count(*) FROM s WHERE s.k = f.k % 200) ELSE 0 END AS BIGINT) AS n_libraries,
        CAST((SELECT count(*) FROM s WHERE starts_with(CAST(s.k AS VARCHAR), CAST(f.k % 100 AS VARCHAR)) AND (f.k % 2 = 1 OR s.k = f.k % 200)) AS BIGINT) AS n_symbols FROM f WHERE f.k % 3 <> 0
    UNION ALL SELECT 'F' || f.k, NULL, NULL, CAST((SELECT count(*) FROM s WHERE s.k = f.k % 200) AS BIGINT), CAST((SELECT count(*) FROM s WHERE s.k = f.k % 200) AS BIGINT) FROM f WHERE f.k % 3 = 0 AND f.k % 2 = 0""")
def q_bridge_map(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files that declare a method, load a library or both; suppliers as libraries with a symbol."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    none = F.array().cast("array<string>")
    files = table(spark, d, "part").select(
        F.concat(F.lit("F"), k).alias("file"), F.lit("q").alias("package"), F.lit("C").alias("class_name"), F.when(k % 3 != 0, F.array(F.concat(F.lit("run"), k % 100))).otherwise(none).alias("native_methods"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("q"), k % 200))).otherwise(none).alias("load_libraries"),
    )
    name = F.concat(F.lit("libq"), s, F.lit(".so"))
    libs = table(spark, d, "supplier")
    symbols = libs.select(name.alias("library"), name.alias("library_name"), F.lit("x86").alias("abi"), F.concat(F.lit("Java_q_C_run"), s).alias("symbol"), F.lit(None).cast("string").alias("address"), s.alias("ord"))
    units = libs.select(F.concat(F.lit("u"), s).alias("unit_id"), F.lit("native_library").alias("kind"), name.alias("name"), name.alias("library"), F.lit("x86").alias("abi"), F.lit(1).alias("score"), s.alias("ord"))
    got = review.bridge_map(files, symbols, units)
    return got.select("java_file", "native_method", "expected_jni_prefix", "n_libraries", "n_symbols")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity <= 45 AS ok, CASE WHEN l_quantity > 48 THEN 'Timed out' WHEN l_quantity > 46 THEN 'library_not_found' WHEN l_quantity > 45 THEN 'crash' END AS error, CAST(l_quantity AS INT) AS ins, l_linenumber AS blk FROM lineitem)
    SELECT substr(sha256('native_probe' || chr(31) || 'p' || chr(31) || '/x/lib' || l_orderkey || '.so' || chr(31) || 'f' || l_linenumber), 1, 24) AS unit_id, 'lib' || l_orderkey || '.so' AS library_name, CASE WHEN NOT ok AND error = 'Timed out' THEN 'tool_limit' WHEN NOT ok AND error = 'library_not_found' THEN 'input_error'
        WHEN NOT ok THEN 'tool_or_target_error' WHEN ins <= 5 THEN 'technical_success_semantic_low' WHEN blk >= 3 AND ins >= 20 THEN 'usable_function_structure' ELSE 'partial_function_structure' END AS outcome_class FROM x""")
def q_probe_reviews(spark: SparkSession, d: str) -> DataFrame:
    q, none = F.col("l_quantity"), F.lit(None).cast("string")
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("/x/lib"), "l_orderkey", F.lit(".so")).alias("library"), F.concat(F.lit("f"), "l_linenumber").alias("name"), F.lit("jni_symbol").alias("kind"), F.lit(1).alias("score"), F.array().cast("array<string>").alias("capabilities"), (q <= 45).alias("success"),
        F.when(q > 48, "Timed out").when(q > 46, "library_not_found").when(q > 45, "crash").alias("error"), none.alias("stderr"), q.cast("int").alias("instruction_count"), F.col("l_linenumber").alias("basic_block_count"), F.lit(0).alias("cfg_edge_count"),
        F.lit(0).alias("pseudocode_line_count"), none.alias("feature_hash"),
    )
    first, second = rows.where("instruction_count <= 25"), rows.where("instruction_count > 25")
    return review.probe_reviews(review.merged_rounds(first, second), "p").select("unit_id", "library_name", "outcome_class")


@query(f"""SELECT substr(sha256('manual_ida' || chr(31) || sha256(CAST(o_custkey AS VARCHAR)) || chr(31) || 'x86' || chr(31) || 'fn' || o_orderkey), 1, 24) AS unit_id, CASE WHEN o_orderkey % 2 = 0 THEN 0.82 ELSE 0.75 END::DOUBLE AS confidence, sha256('return ' || o_orderkey || ';') AS pseudocode_sha256,
    sha256({_NORMAL.format(x="'return ' || o_orderkey || ';'")}) AS token_fingerprint, 1::BIGINT AS n_lines, 'uncertain' AS semantic_role FROM orders WHERE o_orderkey % 3 <> 0""")
def q_import_evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    how = F.when(k % 2 == 0, "binary_hash_verified_manifest_task_metadata_matched").otherwise("binary_hash_verified_manual_internal_address")
    rows = table(spark, d, "orders").select(
        F.when(k % 3 == 0, "bad").alias("error"), how.alias("verification"), F.upper(F.sha2(F.col("o_custkey").cast("string"), 256)).alias("library_sha256"), F.lit("x86").alias("abi"), F.lit("l.so").alias("library_name"), F.lit("t").alias("task_id"),
        F.concat(F.lit("fn"), k).alias("symbol"), F.lit(None).cast("string").alias("address"), F.concat(F.lit("return "), k, F.lit(";")).alias("pseudocode"),
    )
    return review.import_evidence(rows).select("unit_id", "confidence", "pseudocode_sha256", "token_fingerprint", F.col("pseudocode_line_count").cast("long").alias("n_lines"), "semantic_role")


@query("""SELECT o_orderkey, 3 AS instruction_count, 2 AS basic_block_count, 3 AS cfg_edge_count, 'bl sym.x' || o_orderkey AS call_targets, 'call,mov,add' AS mnemonics, 'text' || o_orderkey AS string_refs FROM orders""")
def q_function_features(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    ops = F.concat(F.lit('[{"type":"call","opcode":"bl sym.x'), k, F.lit('"},{"opcode":"mov r0, r1"},{"type":"add"}]'))
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("l").alias("library"), F.lit("f").alias("name"), F.concat(F.lit('say("text'), k, F.lit('");')).alias("pseudocode"), ops.alias("ops"), F.lit('[{"jump":"1","fail":"2"},{"jump":"3"}]').alias("blocks"))
    got = native.function_features(rows)
    return got.select("o_orderkey", "instruction_count", "basic_block_count", "cfg_edge_count", F.array_join("call_targets", ",").alias("call_targets"), F.array_join("mnemonics", ",").alias("mnemonics"), F.array_join("string_refs", ",").alias("string_refs"))


# ---- scores and texts


@query("""SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 3 + 4 WHEN 1 THEN 3 + 4 WHEN 2 THEN 0 ELSE 4 END AS INT) AS score, CASE p_partkey % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'document_pdf' ELSE '' END AS capabilities,
    CAST(CASE p_partkey % 4 WHEN 0 THEN 7 + 10 WHEN 1 THEN 7 + 4 WHEN 2 THEN 2 ELSE 4 END AS INT) AS index_score FROM part""")
def q_text_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "ocr_x").when(k == 1, "pdf_x").when(k == 2, "nothing").otherwise("jni_q")
    kind = F.when(k == 0, "jni_symbol").when(k == 1, "exported_symbol").when(k == 2, "string").otherwise("other")
    t = scoring.text_score(name)
    return table(spark, d, "part").select("p_partkey", t["score"].alias("score"), F.array_join(t["capabilities"], ",").alias("capabilities"), scoring.index_score(t["score"], kind).alias("index_score"))


@query("""SELECT p_partkey, contains(' ' || array_to_string(list_transform(regexp_extract_all(p_name, '[A-Za-z]+'), lambda x: lower(x)), ' ') || ' ', ' red ') AS has_red, CASE WHEN contains(lower(p_name), 'blue') THEN 'blue' ELSE '' END || CASE WHEN contains(lower(p_name), 'red') THEN 'red' ELSE '' END AS hints, contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin') AS marked,
    sha256(p_name || chr(10) || p_type) AS feature_hash, sha256(p_name) AS sha256, nullif(regexp_extract(p_name, '([a-z]+) ', 1), '') AS first_word FROM part""")
def q_text_predicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", taxonomy.keyword_in(F.col("p_name"), "red").alias("has_red"), F.array_join(text.operator_hints(F.array("p_name"), ("blue", "red")), "").alias("hints"), rules.has_any(F.lower("p_type"), ("steel", "tin")).alias("marked"),
        hashing.feature_hash(F.array("p_name", "p_type")).alias("feature_hash"), F.sha2(F.col("p_name").cast("binary"), 256).alias("sha256"), text.first_match(F.col("p_name"), "([a-z]+) ").alias("first_word"),
    )


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'document_pdf,ocr' WHEN 1 THEN 'ocr' ELSE '' END AS capabilities FROM part""")
def q_taxonomy_order(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    values = F.when(k == 0, F.array(F.lit("ocr"), F.lit("document_pdf"), F.lit("ocr"))).when(k == 1, F.array(F.lit("ocr"), F.lit("strange"))).otherwise(F.array(F.lit("none")))
    return table(spark, d, "part").select("p_partkey", F.array_join(taxonomy.in_taxonomy_order(values), ",").alias("capabilities"))


@query("""SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS n_classes, 'run' || o_orderkey AS name, '0x' || lower(to_hex(o_orderkey)) AS address FROM orders""")
def q_listings(spark: SparkSession, d: str) -> DataFrame:
    """DEX headers and symbol listings made of order and customer keys."""
    k, c = F.col("o_orderkey"), F.lpad(F.hex("o_custkey"), 8, "0")
    le = F.concat(*[F.substring(c, i, 2) for i in (7, 5, 3, 1)])
    dex = F.unhex(F.concat(F.lit("6465780A30333500"), F.lit("00" * (0x60 - 8)), le, F.lit("00" * 12)))
    line = F.concat(F.lit(" 1: "), F.lpad(F.hex(k), 16, "0"), F.lit(" 144 FUNC GLOBAL DEFAULT 12 run"), k, F.lit("@@V1\n 2: 0000000000000000 0 FUNC GLOBAL DEFAULT UND free\n"))
    rows = table(spark, d, "orders").select("o_orderkey", src.dex_classes(dex).alias("n_classes"), src.elf_symbols(line).alias("s"))
    return rows.select("o_orderkey", "n_classes", F.col("s")[0]["name"].alias("name"), F.col("s")[0]["address"].alias("address"))


@query("""SELECT preset, max_targets, least(budget, (SELECT count(*) FROM supplier)) AS libraries FROM (VALUES ('standard', 300, 8::BIGINT), ('handoff', 600, 16::BIGINT)) t(preset, max_targets, budget)""")
def q_presets(spark: SparkSession, d: str) -> DataFrame:
    """The libraries that each preset's budget keeps of all suppliers'."""
    out = None
    for name in ("standard", "handoff"):
        c = Config().with_preset(name)
        n = native.targets(native.analyzed(_libraries(spark, d)), None, c).agg(F.countDistinct("library").alias("libraries")).select(F.lit(name).alias("preset"), F.lit(c.max_targets).alias("max_targets"), "libraries")
        out = n if out is None else out.unionByName(n)
    return out
