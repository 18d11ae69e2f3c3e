"""Registered queries of the evidence operators over the driver's tables, with the SQL that states them.

The tables are bound by shape: documents stand for source files, suppliers for libraries, line items for
symbols or targets of a library, orders for tasks, pages for archive entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, rules, text
from .operators import aggregates, graph, linking, quality, ranking, scoring, taxonomy
from .plans import packet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _owner_of(n: Column) -> Column:
    return F.when(n < 5, "first_party").when(n < 10, "unknown").when(n < 15, "third_party").otherwise("platform")


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """documents as source files: file, source_type (java, kt, xml) and ownership."""
    docs = table(spark, d, "documents")
    kind = F.col("doc_id") % 5
    return docs.select(
        "doc_id", "text", "lang", "source", F.concat_ws("/", "source", "lang", "doc_id").alias("file"),
        F.when(kind < 2, "java").when(kind < 4, "kt").otherwise("xml").alias("source_type"),
        _owner_of(F.substr("source", F.lit(4)).cast("int")).alias("ownership"),
    )


SF = """sf AS (SELECT doc_id, text, lang, source, source || '/' || lang || '/' || doc_id AS file,
    CASE WHEN doc_id % 5 < 2 THEN 'java' WHEN doc_id % 5 < 4 THEN 'kt' ELSE 'xml' END AS source_type,
    CASE WHEN CAST(substr(source, 4) AS INT) < 5 THEN 'first_party' WHEN CAST(substr(source, 4) AS INT) < 10 THEN 'unknown'
         WHEN CAST(substr(source, 4) AS INT) < 15 THEN 'third_party' ELSE 'platform' END AS ownership FROM documents)"""
RANK = "CASE ownership WHEN 'first_party' THEN 0 WHEN 'unknown' THEN 1 WHEN 'third_party' THEN 2 ELSE 3 END"


def _tokens_sql(col: str) -> str:
    return rf"list_transform(regexp_extract_all(regexp_replace({col}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))"


def _classified_sql(src: str = "sf", keep: str = "doc_id, file, source_type, ownership, source") -> str:
    """CTE cl: (keep, name, score) of the evaluation taxonomy over a CTE with a text column."""
    parts = []
    for c in taxonomy.EVAL_TAXONOMY:
        hit = lambda w: f"CAST(contains(tk, ' {taxonomy.sequence_of(w)} ') AS INT)"
        affix = lambda w: f"CAST(contains(tk, ' {w} ') OR regexp_matches(tk, ' {w}[a-z0-9]+ | [a-z0-9]+{w} ') AS INT)"
        reg = " + ".join(map(hit, c.keywords)) or "0"
        strong = " + ".join(affix(w) if w in c.affix else hit(w) for w in c.strong) or "0"
        parts.append(f"SELECT {keep}, '{c.name}' AS name, {reg} AS reg, {strong} AS strong, {c.min_regular} AS least FROM tk")
    return f"tk AS (SELECT {keep}, ' ' || array_to_string({_tokens_sql('text')}, ' ') || ' ' AS tk FROM {src}), cl AS (SELECT {keep}, name, CAST(reg + 3 * strong AS BIGINT) AS score FROM ({' UNION ALL '.join(parts)}) WHERE strong > 0 OR reg >= least)"


def _classified(spark: SparkSession, d: str) -> DataFrame:
    """source files with `hits`, without their text."""
    return source_files(spark, d).withColumn("hits", taxonomy.classify(F.col("text"), taxonomy.EVAL_TAXONOMY)).drop("text")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("*", F.explode("hits").alias("h")).select("doc_id", "file", "source_type", "ownership", "source", "h.name", F.col("h.score").cast("long").alias("score"))


# ---- text and taxonomy


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t[1:40], ' ') AS head, sha256(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents)")
def q_tokens_camel(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 40), " ").alias("head"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query(f"WITH {SF}, {_classified_sql()} SELECT doc_id, name, score FROM cl")
def q_classify(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("doc_id", "name", "score")


@query(f"""WITH {SF}, {_classified_sql()}, n AS (SELECT count(*) AS files, sum(len(text) - len(replace(text, chr(10), '')) + 1) AS methods FROM sf),
    m AS (SELECT doc_id, len(text) - len(replace(text, chr(10), '')) + 1 AS k FROM sf)
    SELECT name AS capability, count(*) AS matching_files, round(count(*) / any_value(files), 6) AS prevalence, round(count(*) * 1000.0 / any_value(files), 3) AS per_1000_files,
           CAST(sum(k) AS BIGINT) AS methods_in_files, round(sum(k) * 1000.0 / any_value(methods), 3) AS methods_per_1000
    FROM cl JOIN m USING (doc_id), n GROUP BY name""")
def q_classify_metrics(spark: SparkSession, d: str) -> DataFrame:
    files = source_files(spark, d)
    files = files.select("doc_id", taxonomy.names(taxonomy.classify(F.col("text"), taxonomy.EVAL_TAXONOMY)).alias("capabilities"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_methods"))
    return aggregates.capability_metrics(files, "capabilities", "n_methods")


@query(f"""WITH {SF}, {_classified_sql()}
    SELECT name AS capability, count(*) AS total, count(*) FILTER (WHERE source_type <> 'xml' AND ownership IN ('first_party', 'unknown')) AS comparison,
           count(*) FILTER (WHERE source_type <> 'xml' AND ownership IN ('third_party', 'platform')) AS dependency, count(*) FILTER (WHERE source_type = 'xml') AS non_code FROM cl GROUP BY name""")
def q_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.conditional_counts(_hits(spark, d), "name", F.col("source_type") != "xml", F.col("ownership"))


@query(f"WITH {SF}, {_classified_sql()} SELECT ownership, name AS capability, count(*) AS n FROM cl GROUP BY 1, 2")
def q_ownership_capability(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.ownership_capabilities(_hits(spark, d), "name")


@query(f"WITH {SF} SELECT ownership, count(*) AS files, count(*) FILTER (WHERE source_type <> 'xml') AS code_files FROM sf GROUP BY 1")
def q_ownership_files(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.ownership_files(source_files(spark, d), F.col("source_type") != "xml")


_SNIPPETS_SQL = f"""{SF}, {_classified_sql()}, ln AS (SELECT doc_id, file, ownership, source, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS text, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS line FROM sf),
    lt AS (SELECT doc_id, file, ownership, source, line, text, ' ' || array_to_string({_tokens_sql('text')}, ' ') || ' ' AS tk FROM ln),
    lc AS (SELECT lt.doc_id, lt.file, lt.ownership, lt.source, line, text, name FROM lt JOIN cl ON lt.doc_id = cl.doc_id AND CASE name
        {' '.join("WHEN '" + c.name + "' THEN " + ' OR '.join([f"contains(tk, ' {taxonomy.sequence_of(w)} ')" for w in c.keywords + c.strong] + [f"regexp_matches(tk, ' {w}[a-z0-9]+ | [a-z0-9]+{w} ')" for w in c.strong if w in c.affix]) for c in taxonomy.EVAL_TAXONOMY)} END),
    ls AS (SELECT doc_id, any_value(file) AS file, any_value(ownership) AS ownership, any_value(source) AS source, line, any_value(text) AS text, list(DISTINCT name) AS names FROM lc GROUP BY doc_id, line),
    sn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM ls)"""


@query(f"WITH {_SNIPPETS_SQL} SELECT doc_id, CAST(line AS BIGINT) AS line, array_to_string(list_sort(names), ',') AS capabilities, substr(trim(text), 1, 240) AS snippet FROM sn WHERE n <= 12")
def q_snippets_top12(spark: SparkSession, d: str) -> DataFrame:
    return _snippets(spark, d).select("doc_id", F.col("line").cast("long").alias("line"), F.array_join(F.array_sort("capabilities"), ",").alias("capabilities"), "snippet")


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    files = source_files(spark, d).withColumn("hits", taxonomy.classify(F.col("text"), taxonomy.EVAL_TAXONOMY))
    return taxonomy.snippet_lines(files, "text", "hits", taxonomy.EVAL_TAXONOMY)


@query(f"""WITH {_SNIPPETS_SQL}, e AS (SELECT *, unnest(names) AS capability FROM sn WHERE n <= 12),
    r AS (SELECT *, row_number() OVER (PARTITION BY capability, ownership, source ORDER BY file, line) AS turn FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY turn, {RANK}, source) AS pick FROM r)
    SELECT capability, file, CAST(line AS BIGINT) AS line FROM k WHERE pick <= 40""")
def q_stratified_snippets(spark: SparkSession, d: str) -> DataFrame:
    rows = _snippets(spark, d).select("file", "line", "ownership", "source", F.explode("capabilities").alias("capability"))
    out = aggregates.stratified_per_group(rows, "capability", ["ownership", "source"], [F.col("file"), F.col("line")], [rules.ownership_rank(F.col("ownership")), F.col("source")], 40)
    return out.select("capability", "file", F.col("line").cast("long").alias("line"))


@query(f"""WITH {SF}, {_classified_sql()}, a AS (SELECT source AS package, count(*) AS file_count, arg_min(ownership, file) AS ownership, array_to_string(list(file ORDER BY file)[1:20], ',') AS sample_files
        FROM sf WHERE source_type <> 'xml' GROUP BY 1),
    c AS (SELECT source AS package, name, count(*) AS n, min(file) AS f FROM cl WHERE source_type <> 'xml' GROUP BY 1, 2),
    l AS (SELECT package, string_agg(name || '=' || n, ',' ORDER BY n DESC, f, name) AS capabilities FROM c GROUP BY 1)
    SELECT a.package, file_count, ownership, sample_files, coalesce(capabilities, '') AS capabilities FROM a LEFT JOIN l ON a.package = l.package""")
def q_package_rollup(spark: SparkSession, d: str) -> DataFrame:
    files = _classified(spark, d).where("source_type <> 'xml'").select(F.col("source").alias("package"), "file", "ownership", taxonomy.names(F.col("hits")).alias("capabilities"))
    return aggregates.package_rollup(files)


@query(r"""WITH n AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+', ' URL ', 'g'), '0x[0-9A-Fa-f]+', ' HEX ', 'g'), '\b[0-9]+\b', ' NUM ', 'g')), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]'), ' ') AS t FROM documents)
    SELECT doc_id, CAST(length(t) AS BIGINT) AS n, sha256(t) AS digest FROM n""")
def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.normalize(F.col("text"), None).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("digest"))


_NORMAL = r"array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace({x}, 'https?://\S+', ' URL ', 'g'), '0x[0-9A-Fa-f]+', ' HEX ', 'g'), '\b[0-9]+\b', ' NUM ', 'g')), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]'), ' ')"


@query(f"SELECT doc_id, sha256({_NORMAL.format(x="coalesce(text, '')")}) AS fingerprint FROM documents")
def q_token_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", hashing.token_fingerprint(F.col("text"), None).alias("fingerprint"))


@query("SELECT o_orderkey, substr(sha256('task' || chr(31) || o_orderkey || chr(31) || o_orderstatus), 1, 24) AS unit_id FROM orders")
def q_unit_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", hashing.unit_id(F.lit("task"), F.col("o_orderkey"), F.lit(None).cast("string"), F.col("o_orderstatus")).alias("unit_id"))


_SKETCH = f"""WITH t AS (SELECT doc_id, list_filter(string_split({_NORMAL.format(x='text')}, ' '), lambda x: x <> '') AS t FROM documents),
    s AS (SELECT doc_id, len(t) AS n, list_sort(list_distinct([substr(sha256(array_to_string(t[i:i+4], chr(31))), 1, 16) for i in range(1, len(t) - 3)]))[1:8] AS h FROM t)
    SELECT doc_id, CAST(n AS BIGINT) AS token_count, CAST(greatest(n - 4, 0) AS BIGINT) AS shingle_count, array_to_string(h, ',') AS hashes FROM s"""


@query(_SKETCH)
def q_shingle_bottomk_sha(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", hashing.shingle_sketch(F.col("text"), size=8, algorithm="sha256_64").alias("s"))
    return s.select("doc_id", F.col("s.token_count").cast("long").alias("token_count"), F.col("s.shingle_count").cast("long").alias("shingle_count"), F.array_join("s.hashes", ",").alias("hashes"))


@query()
def q_shingle_bottomk_blake(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", hashing.shingle_sketch(F.col("text")).alias("s"))
    return s.select("doc_id", "s.token_count", "s.shingle_count", "s.retained_hash_count", F.array_join("s.hashes", ",").alias("hashes"))


@query(r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(url || ' ' || html, 'https?://[A-Za-z0-9._~:/?#\[\]@!$&''()*+,;=%-]+'))), ' ') AS urls FROM pages")
def q_url_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(text.extract_all(F.concat_ws(" ", "url", "html"), text.URL, 0), " ").alias("urls"))


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n, array_to_string(list_sort(list_distinct(list(url)))[1:200], ' ') AS urls FROM pages GROUP BY 1")
def q_url_hosts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "url")
    return aggregates.distinct_lists(rows, "host", "url", 200).select("host", "n", F.array_join("values", " ").alias("urls"))


@query("SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: regexp_matches(x, '(?i)\\b(the|and)\\b'))) AS matching, len(list_filter(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: regexp_matches(x, '(?i)\\bwarn(?:ing)?\\b'))) AS warnings FROM documents")
def q_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.matching_lines(F.col("text"), r"(?i)\b(the|and)\b").cast("long").alias("matching"), text.matching_lines(F.col("text"), text.WARNING_LINE).cast("long").alias("warnings"))


@query("""SELECT doc_id, CAST(i AS BIGINT) AS chunk, sha256(substr(text, CAST(greatest(i * 1000 - 64, 0) + 1 AS BIGINT), CAST(least(i * 1000, 64) + 1000 AS BIGINT))) AS digest
    FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil(length(text) / 1000.0), 1) AS BIGINT))) AS i FROM documents)""")
def q_chunks_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"), 1000, 64)).alias("chunk", "c"))
    return docs.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.sha2("c", 256).alias("digest"))


@query(r"""WITH x AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x20-\x7e]', chr(10), 'g'), '[\x20-\x7e]{4,}') AS s FROM documents)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n, sha256(array_to_string(s, chr(10))) AS digest FROM x""")
def q_printable_strings(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", text.printable_strings(F.col("text").cast("binary")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "\n"), 256).alias("digest"))


@query("""WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), x AS (SELECT doc_id, unnest(range(1, length(h) + 1, 2)) AS i, h FROM b),
    c AS (SELECT doc_id, substr(h, i, 2) AS byte, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY 1)
    SELECT doc_id, round(sum(-(n / t) * log2(n / t)), 4) AS entropy FROM c JOIN t USING (doc_id) GROUP BY 1""")
def q_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", hashing.byte_entropy(F.col("text").cast("binary")).alias("entropy"))


@query("""WITH p AS (SELECT page_id, string_split(html, '<p>') AS s FROM pages),
    o AS (SELECT page_id, [CAST(length(array_to_string(s[1:k], '<p>')) AS BIGINT) for k in range(1, len(s))][1:20] AS o FROM p)
    SELECT page_id, array_to_string(o, ',') AS offsets FROM o""")
def q_magic(spark: SparkSession, d: str) -> DataFrame:
    # ASCII is compared with characters in the SQL, so the page goes through without its other characters' bytes
    page = F.col("html")
    return table(spark, d, "pages").select("page_id", F.array_join(text.magic_offsets(F.encode(page, "ISO-8859-1"), "<p>"), ",").alias("offsets"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


# ---- rules


@query("""SELECT p_partkey, name, CASE WHEN name = 'base.apk' THEN 'base' WHEN p_partkey % 6 = 1 THEN 'config_abi' WHEN p_partkey % 6 = 2 THEN 'config_density' WHEN p_partkey % 6 = 3 THEN 'config_language'
        WHEN p_partkey % 6 = 4 THEN 'dynamic_feature' ELSE 'single_or_unknown' END AS split_type
    FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'base.apk' WHEN 1 THEN 'split_config.arm64_v8a.apk' WHEN 2 THEN 'config.xxhdpi.apk' WHEN 3 THEN 'split_config.en.apk' WHEN 4 THEN 'feature_' || p_partkey || '.apk' ELSE 'app' || p_partkey || 'store.apk' END AS name FROM part)""")
def q_split_type(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "base.apk").when(k == 1, "split_config.arm64_v8a.apk").when(k == 2, "config.xxhdpi.apk").when(k == 3, "split_config.en.apk").when(k == 4, F.concat(F.lit("feature_"), "p_partkey", F.lit(".apk"))).otherwise(F.concat(F.lit("app"), "p_partkey", F.lit("store.apk")))
    return table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("split_type", rules.split_type(F.col("name")))


_HOST = "array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')), '.')"


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS package FROM pages)
    SELECT page_id, package, CASE WHEN package = 'com.example' OR starts_with(package, 'com.example.') THEN 'first_party' WHEN package = 'org.example' OR starts_with(package, 'org.example.') THEN 'third_party' ELSE 'unknown' END AS category FROM h""")
def q_ownership_prefix(spark: SparkSession, d: str) -> DataFrame:
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\.")), ".")
    rows = table(spark, d, "pages").select("page_id", host.alias("package"))
    return rows.withColumn("category", rules.code_ownership(F.col("package"), F.lit(""), "com.example", (), ("org.example",))["category"])


@query("""SELECT p_partkey, array_to_string(list_filter(['android.permission.CAMERA', 'android.permission.' || upper(p_type), 'x.read_sms', p_name], lambda p: contains(upper(p), 'CAMERA') OR contains(upper(p), 'READ_SMS')), ',') AS dangerous FROM part""")
def q_permissions_filter(spark: SparkSession, d: str) -> DataFrame:
    asked = F.array(F.lit("android.permission.CAMERA"), F.concat(F.lit("android.permission."), F.upper("p_type")), F.lit("x.read_sms"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(rules.dangerous(asked), ",").alias("dangerous"))


@query("""SELECT o_orderkey, '0x' || lower(to_hex(o_orderkey)) AS from_decimal, '0x' || lower(to_hex(o_orderkey)) AS from_hex, '0xa' || lower(to_hex(o_orderkey)) AS bare, CAST(NULL AS VARCHAR) AS bad FROM orders""")
def q_address_normalize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", rules.address(k.cast("string")).alias("from_decimal"), rules.address(F.concat(F.lit("0X00"), F.hex(k))).alias("from_hex"),
        rules.address(F.concat(F.lit("A"), F.hex(k))).alias("bare"), rules.address(F.concat(F.lit("-"), k)).alias("bad"),
    )


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity <= 45 AS ok, CASE WHEN l_quantity > 48 THEN 'Timed out' WHEN l_quantity > 46 THEN 'library_not_found' WHEN l_quantity > 45 THEN 'crash' END AS error, CAST(l_quantity AS INT) AS ins, l_linenumber AS blk FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN NOT ok AND error = 'Timed out' THEN 'timeout' WHEN NOT ok AND error = 'library_not_found' THEN 'library_not_found' WHEN NOT ok THEN 'decompiler_failed'
        WHEN ins <= 5 THEN 'wrapper_or_import_thunk' WHEN blk >= 3 AND ins >= 20 THEN 'semantic_success' ELSE 'technical_success' END AS outcome FROM x""")
def q_probe_outcome(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    error = F.when(q > 48, "Timed out").when(q > 46, "library_not_found").when(q > 45, "crash")
    out = rules.probe_outcome(q <= 45, error, F.lit(None).cast("string"), F.lit("f"), q.cast("int"), F.col("l_linenumber"), F.lit(0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", out["outcome"].alias("outcome"))


_MARK = lambda ms, x: "(" + " OR ".join(f"contains({x}, '{m}')" for m in ms) + ")"


@query(f"""WITH x AS (SELECT p_partkey, p_name AS name, lower(p_name) AS low FROM part)
    SELECT p_partkey, CASE WHEN {_MARK(rules.WRAPPERS, 'low')} OR regexp_matches(name, '(?:^|[_:.])(?:get|set|is|has)[A-Z_]|(?:getter|setter)(?:$|[_:.])') THEN 'wrapper' WHEN {_MARK(rules.RUNTIMES, 'low')} THEN 'model_runtime'
        WHEN {_MARK(rules.UTILITIES, 'low')} AND NOT {_MARK(rules.ALGORITHMS, 'low')} THEN 'utility' ELSE 'uncertain' END AS role FROM x""")
def q_semantic_role(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rules.semantic_role(F.col("p_name"))["role"].alias("role"))


@query("""SELECT p_partkey, CASE WHEN ext IN ('tflite', 'onnx') OR (ext = 'bin' AND contains(lower(path), 'model')) THEN 'model' ELSE 'other' END AS kind, NOT contains(path, '..') AS safe
    FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'tflite' WHEN 1 THEN 'onnx' WHEN 2 THEN 'bin' ELSE 'txt' END AS ext, CASE WHEN p_partkey % 7 = 0 THEN '../' ELSE '' END || 'assets/' || CASE WHEN p_partkey % 3 = 0 THEN 'Model' ELSE 'x' END || p_partkey || '.' || CASE p_partkey % 4 WHEN 0 THEN 'tflite' WHEN 1 THEN 'onnx' WHEN 2 THEN 'bin' ELSE 'txt' END AS path FROM part)""")
def q_entry_predicates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.when(k % 4 == 0, "tflite").when(k % 4 == 1, "onnx").when(k % 4 == 2, "bin").otherwise("txt")
    path = F.concat(F.when(k % 7 == 0, "../").otherwise(""), F.lit("assets/"), F.when(k % 3 == 0, "Model").otherwise("x"), k, F.lit("."), ext)
    rows = table(spark, d, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", F.when(rules.is_model(F.col("path")), "model").otherwise("other").alias("kind"), rules.safe_member(F.col("path")).alias("safe"))


# ---- ranking


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """Line items as targets of a library (the supplier)."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("library"), F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("score"), F.col("l_returnflag").alias("kind"), F.col("l_shipdate").alias("at"))


_T = "t AS (SELECT l_suppkey AS library, l_orderkey AS task, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS score, l_returnflag AS kind FROM lineitem)"


def _order() -> list[Column]:
    return [F.desc("score"), F.col("library"), F.col("task"), F.col("line")]


@query(f"WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY score DESC, task, line) AS n FROM t) SELECT library, task, line, score FROM r WHERE n <= 5")
def q_topk_per_library(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_per_group(_targets(spark, d), ["library"], _order(), 5).select("library", "task", "line", "score")


@query(f"WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY score DESC, task, line) AS n FROM t) SELECT library, task, line, score FROM r WHERE n <= 3 ORDER BY score DESC, library, task, line LIMIT 100")
def q_capped_targets(spark: SparkSession, d: str) -> DataFrame:
    return ranking.capped(_targets(spark, d), ["library"], _order(), 3, 100).select("library", "task", "line", "score")


@query(f"WITH {_T}, b AS (SELECT library FROM t GROUP BY library ORDER BY max(score) DESC, library LIMIT 8) SELECT library, count(*) AS n, max(score) AS best FROM t WHERE library IN (SELECT library FROM b) GROUP BY library")
def q_top_libraries(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_groups(_targets(spark, d), "library", "score", 8).groupBy("library").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query(f"""WITH {_T}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, library, task, line) AS ord FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY ord) AS n, min(ord) OVER (PARTITION BY library) AS f FROM o),
    k AS (SELECT *, dense_rank() OVER (ORDER BY f) AS lib FROM r) SELECT library, task, line, score FROM k WHERE lib <= 8 AND n <= 5 ORDER BY ord LIMIT 40""")
def q_budget_plan(spark: SparkSession, d: str) -> DataFrame:
    return ranking.budget_plan(_targets(spark, d), "library", _order(), 40, 8).select("library", "task", "line", "score")


@query(f"""WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, line ORDER BY score DESC, task, library) AS turn FROM t) SELECT kind, line, task, library, score FROM r ORDER BY turn, kind, line, task LIMIT 250""")
def q_round_robin_units(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.round_robin(_targets(spark, d), ["kind", "line"], [F.desc("score"), F.col("task"), F.col("library")], [F.col("kind"), F.col("line")], 250)
    return out.select("kind", "line", "task", "library", "score")


@query(f"""WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY library, kind ORDER BY score DESC, task, line) AS turn, max(score) OVER (PARTITION BY library, kind) AS head FROM t)
    SELECT row_number() OVER (ORDER BY turn, head DESC, library, kind) AS rank, library, kind, task, line, score FROM r QUALIFY rank <= 120""")
def q_review_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = aggregates.with_head(_targets(spark, d), ["library", "kind"], "score", "head")
    out = ranking.round_robin(rows, ["library", "kind"], [F.desc("score"), F.col("task"), F.col("line")], [F.desc("head"), F.col("library"), F.col("kind")], 120, rank="rank")
    return out.select("rank", "library", "kind", "task", "line", "score")


@query(f"""WITH {_T}, q AS (SELECT *, row_number() OVER (ORDER BY score DESC, library, task, line) AS rank FROM t QUALIFY rank <= 500), k AS (SELECT *, min(rank) OVER (PARTITION BY library, kind) AS f FROM q)
    SELECT library, kind, task, line FROM (SELECT *, dense_rank() OVER (ORDER BY f) AS n FROM k) WHERE n <= 12""")
def q_handoff_first_n(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.first_ranked(_targets(spark, d), _order(), 500, "rank")
    return ranking.first_distinct(rows, ["library", "kind"], "rank", 12).select("library", "kind", "task", "line")


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER () AS c FROM orders), k AS (SELECT DISTINCT CAST(round_even(i * (c - 1) / 99.0, 0) AS BIGINT) AS pos FROM (SELECT unnest(range(0, 100)) AS i), (SELECT count(*) AS c FROM orders))
    SELECT o_orderkey FROM n JOIN k USING (pos)""")
def q_systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ranking.systematic_sample(rows, [F.col("o_totalprice"), F.col("o_orderkey")], 100, "o_orderkey").select("o_orderkey")


@query("""WITH e AS (SELECT n_name AS archive, p_partkey, p_size % 3 = 0 AS model, p_size + CASE WHEN p_size % 3 = 0 THEN 20 ELSE 0 END AS score, p_name AS path FROM part JOIN nation ON p_partkey % 25 = n_nationkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY archive, model ORDER BY score DESC, path, p_partkey) AS n FROM e) SELECT archive, p_partkey, model FROM r WHERE model OR n <= 8""")
def q_resource_topk(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").join(F.broadcast(table(spark, d, "nation")), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    rows = p.select(F.col("n_name").alias("archive"), "p_partkey", (F.col("p_size") % 3 == 0).alias("model"), "p_size", F.col("p_name").alias("path")).withColumn("score", F.col("p_size") + F.when(F.col("model"), 20).otherwise(0))
    return aggregates.models_and_top(rows, ["archive"], "model", [F.desc("score"), F.col("path"), F.col("p_partkey")], 8).select("archive", "p_partkey", "model")


# ---- joins


@query("""WITH f AS (SELECT p_partkey AS file, 'supplier#' || lpad(CAST(p_partkey % 3000 AS VARCHAR), 9, '0') AS stem, p_partkey % 4 AS n_methods FROM part),
    l AS (SELECT s_suppkey AS library, lower(s_name) AS stem FROM supplier), h AS (SELECT DISTINCT file, library, 'load_library' AS match_type FROM f JOIN l USING (stem))
    SELECT * FROM h UNION ALL SELECT file, library, 'fallback' FROM (SELECT file FROM f WHERE n_methods > 0 AND file NOT IN (SELECT file FROM h)), l UNION ALL SELECT 0, 0, 'none' WHERE false""")
def q_link_fallback(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    files = table(spark, d, "part").select(k.alias("file"), F.array(F.concat(F.lit("supplier#"), F.lpad((k % 3000).cast("string"), 9, "0"))).alias("stems"), (k % 4).alias("n_methods"))
    libraries = table(spark, d, "supplier").select(F.col("s_suppkey").alias("library"), rules.library_stem(F.col("s_name")).alias("stem"))
    return linking.link_by_stem(files, libraries)


@query("""SELECT n_name, p_partkey FROM nation JOIN part ON n_regionkey = p_partkey % 5 WHERE contains(p_name, 'Java_' || n_regionkey || '_' || n_name || '_' || substr(p_type, 1, 3)) OR ends_with(p_name, '_' || substr(p_type, 1, 3)) OR ends_with('x_' || p_partkey % 25, '_' || n_nationkey)""")
def q_theta_symbol_match(spark: SparkSession, d: str) -> DataFrame:
    methods = table(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("library").cast("long"), F.col("n_regionkey").cast("string").alias("package"), F.col("n_name").alias("class_name"), F.col("n_nationkey").cast("string").alias("method"))
    symbols = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("library"), F.concat(F.lit("x_"), F.col("p_partkey") % 25).alias("symbol"))
    return linking.link_symbols(methods, symbols).select("n_name", "p_partkey")


@query("""WITH r AS (SELECT o_custkey AS c, o_orderstatus AS s, o_orderkey AS k, o_orderpriority AS p FROM orders), e AS (SELECT c, s, arg_max(p, k) AS p FROM r GROUP BY 1, 2), l AS (SELECT c, arg_max(p, k) AS p FROM r GROUP BY 1)
    SELECT c_custkey, st, coalesce(e.p, l.p) AS priority, CASE WHEN e.p IS NOT NULL THEN 'exact' WHEN l.p IS NOT NULL THEN 'loose' ELSE 'none' END AS level
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'P' END AS st FROM customer) x LEFT JOIN e ON e.c = c_custkey AND e.s = st LEFT JOIN l ON l.c = c_custkey""")
def q_cascading_join(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("P").alias("st"))
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("st"), "o_orderkey", F.col("o_orderpriority").alias("priority"))
    return linking.cascading(left, right, ["c_custkey", "st"], ["c_custkey"], [F.col("o_orderkey")], ["priority"])


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer""")
def q_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@query("""WITH t AS (SELECT o_orderkey, sha256(CAST(o_custkey AS VARCHAR)) AS sha, substr(sha256('f' || chr(31) || o_orderkey), 1, 24) AS tid FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 1 THEN 'unsupported schema_version' WHEN o_orderkey % 7 = 2 THEN 'library_sha256 is not a SHA-256' WHEN o_orderkey % 7 = 3 THEN 'abi does not match the library'
        WHEN o_orderkey % 7 = 4 THEN 'symbol or address is required' WHEN o_orderkey % 7 = 5 THEN 'task_id does not match the function' WHEN o_orderkey % 7 = 6 THEN 'function is not in the task manifest' END AS error FROM t""")
def q_import_validation(spark: SparkSession, d: str) -> DataFrame:
    k, sha = F.col("o_orderkey"), F.sha2(F.col("o_custkey").cast("string"), 256)
    o = table(spark, d, "orders").select("o_orderkey", sha.alias("sha"), hashing.unit_id(F.lit("f"), k).alias("tid"), F.concat(F.lit("fn_"), k).alias("name"))
    tasks = o.select(F.col("tid").alias("task_id"), F.lit("function").alias("task_type"), F.col("sha").alias("library_sha256"), F.lit("arm64-v8a").alias("abi"), F.col("name").alias("symbol"), rules.address(k).alias("address"))
    libs = o.select(F.col("sha").alias("library_sha256"), F.lit("arm64-v8a").alias("abi"), F.lit("lib.so").alias("library_name")).distinct()
    m = k % 7
    results = o.select(
        k.alias("ord"), F.when(m == 1, "old").otherwise(linking.RESULT_SCHEMA).alias("schema_version"), F.when(m == 2, "zz").otherwise(F.upper("sha")).alias("library_sha256"), F.when(m == 3, "x86").otherwise("arm64-v8a").alias("abi"),
        F.lit("lib.so").alias("library_name"), F.lit("9").alias("tool_version"), F.when(m == 5, "other").otherwise(F.col("tid")).alias("task_id"), F.when(m == 4, " ").when(m == 6, "gone").otherwise(F.col("name")).alias("symbol"),
        F.lit(None).cast("string").alias("address"), F.lit("return 1;").alias("pseudocode"),
    )
    return linking.validate_import(results, tasks, libs).select(F.col("ord").alias("o_orderkey"), "error")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1, 2")
def q_dedup_first_last(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    order = [F.col("ts"), F.col("event_id")]
    first = linking.first_by(e, ["user_id", "event_type"], order).select("user_id", "event_type", F.col("event_id").alias("first_id"))
    last = linking.last_by(e, ["user_id", "event_type"], order).select("user_id", "event_type", F.col("event_id").alias("last_id"))
    return first.join(last, ["user_id", "event_type"])


@query("""SELECT phase, kind, count(*) AS available FROM (SELECT 'source' AS phase, lang AS kind FROM documents UNION ALL SELECT 'page', 'html' FROM pages UNION ALL SELECT 'talk', role FROM conversations) GROUP BY 1, 2""")
def q_union_units(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("source").alias("phase"), F.col("lang").alias("kind"), F.col("doc_id").alias("file"))
    pages = table(spark, d, "pages").select(F.lit("page").alias("phase"), F.lit("html").alias("kind"), F.col("page_id").alias("path"))
    talk = table(spark, d, "conversations").select(F.lit("talk").alias("phase"), F.col("role").alias("kind"))
    units = packet.union_units({"docs": docs, "pages": pages, "talk": talk})
    return packet.kind_counts(units, units).select("phase", "kind", F.col("discovered").alias("available"))


@query("""WITH a AS (SELECT 'source' AS phase, lang AS capability, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'page', CASE WHEN contains(url, '/fr') THEN 'fr' ELSE 'en' END, count(*) FROM pages GROUP BY 2)
    SELECT capability, phase, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY ROLLUP (capability, phase) HAVING grouping(capability) = 0""")
def q_phase_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("source").alias("phase"), F.col("lang").alias("capability"))
    pages = table(spark, d, "pages").select(F.lit("page").alias("phase"), F.when(F.contains("url", F.lit("/fr")), "fr").otherwise("en").alias("capability"))
    return packet.capability_totals(docs.unionByName(pages).select("phase", F.array("capability").alias("capabilities")))


# ---- graph


def _units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as libraries, line items as targets, customers as bridges, over one app row."""
    uid = lambda kind, c: hashing.unit_id(F.lit(kind), F.col(c))
    none = F.lit(None).cast("array<string>")
    row = lambda df, kind, i, name, lib, loads: df.select(
        uid(kind, i).alias("unit_id"), F.lit(kind).alias("kind"), F.lit("p").alias("phase"), name.alias("name"), lib.cast("string").alias("library"), loads.alias("native_libraries"),
        F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("file"), F.lit(0.5).alias("confidence"), F.col(i).cast("long").alias("i"),
    )
    s, o, c = table(spark, d, "supplier"), table(spark, d, "orders"), table(spark, d, "customer")
    libs = row(s, "native_library", "s_suppkey", F.concat(F.lit("lib"), "s_suppkey", F.lit(".so")), F.concat(F.lit("/x/lib"), "s_suppkey", F.lit(".so")), none)
    targets = row(o, "native_target", "o_orderkey", F.lit("f"), F.concat(F.lit("/y/lib"), F.col("o_custkey"), F.lit(".so")), none)
    bridges = row(c, "native_bridge", "c_custkey", F.col("c_name"), F.lit(None), F.array(F.col("c_custkey").cast("string")))
    app = spark.createDataFrame([("com.app", "1", "1.0", "App")], "package string, version_code string, version_name string, app_name string")
    return libs.unionByName(targets).unionByName(bridges), app


@query("""SELECT type, count(*) AS n FROM (SELECT 'contains' AS type FROM supplier UNION ALL SELECT 'contains' FROM orders UNION ALL SELECT 'contains' FROM customer
    UNION ALL SELECT 'loads_native_library' FROM customer JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT 'has_native_target' FROM orders JOIN supplier ON o_custkey = s_suppkey) GROUP BY 1""")
def q_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    units, app = _units(spark, d)
    return graph.evidence_edges(units, app, [F.col("i")]).groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT kind, label, count(*) AS n FROM (SELECT 'app' AS kind, 'com.app' AS label UNION ALL SELECT 'native_library', 'lib' || s_suppkey || '.so' FROM supplier UNION ALL SELECT 'native_target', 'f' FROM orders UNION ALL SELECT 'native_bridge', c_name FROM customer) GROUP BY 1, 2""")
def q_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    units, app = _units(spark, d)
    return graph.evidence_nodes(units, app).groupBy("kind", "label").agg(F.count("*").alias("n"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.concat(F.lit("lib"), F.col("l_suppkey") % 10).alias("library"), F.concat(F.lit("f"), F.col("l_orderkey")).alias("name"), F.concat(F.lit("call sym.p"), F.col("l_partkey") % 500).alias("call"), F.col("l_quantity").cast("long").alias("score"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("k"))
    return li.groupBy("library", "name", "k").agg(F.array_sort(F.collect_set("call")).alias("call_targets"), F.max("score").alias("score"))


_CALLS = "c AS (SELECT DISTINCT 'lib' || l_suppkey % 10 AS library, 'f' || l_orderkey AS name, l_orderkey AS k, 'call sym.p' || l_partkey % 500 AS call FROM lineitem)"


@query(f"WITH {_CALLS} SELECT library, name, CAST(count(*) AS BIGINT) AS degree FROM c GROUP BY 1, 2 UNION ALL SELECT library, call, CAST(count(*) AS BIGINT) FROM c GROUP BY 1, 2")
def q_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(*graph.call_graph(_calls(spark, d)))


@query(f"""WITH {_CALLS}, s AS (SELECT 'lib' || l_suppkey % 10 AS library, l_orderkey AS k, max(CAST(l_quantity AS BIGINT)) AS score FROM lineitem GROUP BY 1, 2),
    f AS (SELECT c.library, replace(call, 'call ', '') AS callee, c.name, score, row_number() OVER (PARTITION BY c.library, call ORDER BY score DESC, c.k) AS n, c.k, row_number() OVER (PARTITION BY c.library, c.k ORDER BY call) AS i FROM c JOIN s ON c.library = s.library AND c.k = s.k)
    SELECT library, callee AS name, score + 6 AS score, name AS caller FROM f WHERE n = 1 ORDER BY f.score DESC, k, library, i LIMIT 200""")
def q_callee_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = _calls(spark, d).withColumn("neg", -F.col("score"))
    return graph.expand_callees(rows, [F.col("neg"), F.col("k"), F.col("library")], 200)


# ---- scores and quality


_CASE_ROLE = "CASE n_nationkey % 3 WHEN 0 THEN 'primary_production' WHEN 1 THEN 'secondary_production' ELSE 'cross_validation' END"


@query(f"""WITH h AS (SELECT o_custkey AS s, count(*) AS hints FROM orders GROUP BY 1)
    SELECT s_suppkey, CAST(s_suppkey % 40 + CASE s_suppkey % 2 WHEN 0 THEN 10 ELSE 4 END + CASE role WHEN 'primary_production' THEN 16 WHEN 'secondary_production' THEN 6 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 10 ELSE 0 END
        + CASE WHEN coalesce(hints, 0) > 0 THEN least(24, 12 * hints) ELSE 0 END - CASE WHEN s_suppkey % 7 = 0 THEN 18 ELSE 0 END - CASE WHEN s_suppkey % 11 = 0 THEN 6 ELSE 0 END AS BIGINT) AS score,
        CAST(s_suppkey % 40 + least(24, 12 * coalesce(hints, 0)) + CASE role WHEN 'primary_production' THEN 16 WHEN 'secondary_production' THEN 6 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 10 ELSE 0 END + least(16, 2 * coalesce(hints, 0))
        - CASE WHEN s_suppkey % 7 = 0 THEN 18 ELSE 0 END AS BIGINT) AS priority
    FROM (SELECT s_suppkey, {_CASE_ROLE} AS role FROM supplier JOIN nation ON s_nationkey = n_nationkey) LEFT JOIN h ON s = s_suppkey""")
def q_native_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = F.col("n_nationkey") % 3
    abi = F.when(n == 0, "arm64-v8a").when(n == 1, "armeabi-v7a").otherwise("x86")
    hints = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("s_suppkey")).agg(F.count("*").alias("hints"))
    rows = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(hints, "s_suppkey", "left")
    hint, role = F.coalesce("hints", F.lit(0)).cast("int"), rules.abi_role(abi, F.lit(True))
    kind, model, wrapper = F.when(k % 2 == 0, "jni_symbol").otherwise("exported_symbol"), k % 5 == 0, k % 7 == 0
    base = (k % 40).cast("int")
    score = scoring.total(scoring.target_components(base, kind, F.lit(False), role, model, hint, F.lit(0), wrapper, F.when(k % 11 == 0, "third_party").otherwise("unknown")))
    priority = scoring.total(scoring.task_components(base, hint, role, model, hint, wrapper))
    return rows.select("s_suppkey", score.cast("long").alias("score"), priority.cast("long").alias("priority"))


_PROFILE = scoring.ProbeProfile("eval", ("libscan.so",), ("libskia",), ("red", "blue"), ("operator",), ("ocr",), vendor_marker="none")


@query("""WITH x AS (SELECT p_partkey, p_size AS base, lower(p_name) AS low, CASE p_partkey % 3 WHEN 0 THEN 'jni_symbol' WHEN 1 THEN 'exported_symbol' ELSE 'string' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 80 WHEN 1 THEN 45 WHEN 2 THEN -100 ELSE 0 END AS lib, CASE WHEN p_partkey % 5 = 0 THEN 13 ELSE 0 END AS cap FROM part),
    s AS (SELECT *, CAST(contains(low, 'red') AS INT) + CAST(contains(low, 'blue') AS INT) AS seeds FROM x)
    SELECT p_partkey, CAST(base + lib + CASE WHEN seeds > 0 THEN 18 + 4 * seeds ELSE 0 END + cap + CASE kind WHEN 'jni_symbol' THEN 12 WHEN 'exported_symbol' THEN 4 ELSE -20 END AS BIGINT) AS score FROM s""")
def q_seed_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    lib = F.when(k % 4 == 0, "libScan.so").when(k % 4 == 1, "xlibscan2.so").when(k % 4 == 2, "libskia.so").otherwise("libz.so")
    kind = F.when(k % 3 == 0, "jni_symbol").when(k % 3 == 1, "exported_symbol").otherwise("string")
    s = scoring.seed_score(F.col("p_size"), lib, F.lower("p_name"), kind, F.when(k % 5 == 0, F.array(F.lit("ocr"))), _PROFILE)
    return table(spark, d, "part").select("p_partkey", s["score"].cast("long").alias("score"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    fields = {
        "package": quality.field_status(F.col("text")), "manifest_xml": quality.field_status(F.col("lang")), "version_name": quality.field_status(F.col("quality")),
        "version_code": quality.field_status(F.col("toxic"), error=F.when(F.col("toxic") == 1, "boom")), "app_name": quality.field_status(F.col("source"), supported=F.col("doc_id") % 2 == 0),
    }
    return quality.field_rows(rows, ["doc_id"], fields)


_F = """f AS (SELECT doc_id, 'package' AS field, CASE WHEN text IS NULL OR trim(text) = '' THEN 'missing' ELSE 'success' END AS status FROM documents UNION ALL SELECT doc_id, 'manifest_xml', CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'missing' ELSE 'success' END FROM documents
    UNION ALL SELECT doc_id, 'version_name', CASE WHEN quality IS NULL THEN 'missing' ELSE 'success' END FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT doc_id, 'version_code', CASE WHEN toxic = 1 THEN 'error' WHEN toxic IS NULL THEN 'missing' ELSE 'success' END FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'app_name', CASE WHEN doc_id % 2 = 1 THEN 'unsupported' ELSE 'success' END FROM documents)"""


@query(f"WITH {_F} SELECT field, status, count(*) AS n FROM f GROUP BY 1, 2")
def q_field_status(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d).groupBy("field", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {_F}, w AS (SELECT doc_id, round(sum(CASE WHEN status = 'success' THEN CASE field WHEN 'package' THEN 0.18 WHEN 'manifest_xml' THEN 0.18 WHEN 'app_name' THEN 0.04 ELSE 0.08 END ELSE 0 END), 4) AS completeness, bool_and(status = 'success') FILTER (field IN ('version_name', 'version_code')) AS req,
    bool_and(status = 'success') FILTER (field IN ('package', 'manifest_xml')) AS crit FROM f GROUP BY 1) SELECT doc_id, CAST(completeness AS DOUBLE) AS completeness, CASE WHEN NOT crit THEN 'failed' WHEN NOT req THEN 'partial' ELSE 'success' END AS status FROM w""")
def q_completeness(spark: SparkSession, d: str) -> DataFrame:
    got = quality.completeness(_fields(spark, d), ["doc_id"], critical=("package", "manifest_xml"), required=("version_name", "version_code"))
    return got.select("doc_id", "completeness", "status")


@query("""WITH r AS (SELECT 'p' || p_partkey AS source, p_partkey % 10 = 0 AS odd, p_partkey IN (SELECT l_partkey FROM lineitem) AS there FROM part)
    SELECT count(*) AS required_sources, count(*) FILTER (WHERE there AND NOT odd) AS valid_sources, coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE NOT there), '') AS missing, coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE there AND odd), '') AS invalid,
        (SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders WHERE NOT starts_with(o_orderpriority, '1')) AS failed_upstream, false AS complete FROM r""")
def q_dependency_state(spark: SparkSession, d: str) -> DataFrame:
    required = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("source"), F.lit("list").alias("kind"))
    present = table(spark, d, "lineitem").select("l_partkey").distinct().select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.when(F.col("l_partkey") % 10 == 0, "dict").otherwise("list").alias("kind"))
    upstream = table(spark, d, "orders").select(F.col("o_orderpriority").alias("phase"), F.when(F.startswith("o_orderpriority", F.lit("1")), "success").otherwise("partial").alias("status")).distinct()
    got = quality.dependency_state(required, present, upstream)
    return got.withColumns({c: F.array_join(c, ",") for c in ("missing", "invalid", "failed_upstream")})


@query("""SELECT l_suppkey, round(least(1.0, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0)), 4) AS coverage FROM lineitem GROUP BY 1""")
def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("done"), F.count_if(F.col("l_linestatus") == "F").alias("expected"))
    return rows.select("l_suppkey", quality.coverage(F.col("done"), F.col("expected")).alias("coverage"))


@query("""SELECT s_suppkey, CAST(CASE WHEN n > 2 THEN least(0.95, 0.35 + 0.08 * 3 + 0.03 * least(n, 8)) ELSE 0.2 END AS DOUBLE) AS confidence FROM (SELECT s_suppkey, s_suppkey % 12 AS n FROM supplier)""")
def q_confidence(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_suppkey") % 12
    return table(spark, d, "supplier").select("s_suppkey", rules.confidence(F.when(n > 2, 3).otherwise(0), n).alias("confidence"))


@query("""SELECT event_type, count(*) AS discovered, count(*) FILTER (WHERE value > 50) AS selected, count(*) - count(*) FILTER (WHERE value > 50) AS excluded FROM events GROUP BY 1""")
def q_selection_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return ranking.selection_counts(e, e.where("value > 50"), ["event_type"])


@query("""WITH x AS (SELECT p_partkey, p_type, [p_type, '', p_name, p_type, p_brand] AS v FROM part) SELECT p_partkey, array_to_string(list_filter([p_type, p_name, p_brand], lambda y: y <> '')[1:2], ',') AS first_two FROM x JOIN part USING (p_partkey, p_type)""")
def q_compact_list(spark: SparkSession, d: str) -> DataFrame:
    values = F.array("p_type", F.lit(""), "p_name", "p_type", "p_brand")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.compact(values, 2), ",").alias("first_two"))
