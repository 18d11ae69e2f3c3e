"""The ten corpus queries over the driver's tables, and the SQL that states their results where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decision_lists, decontamination, deleted_interpolation, importance, jaccard_join, language_id, line_dedup, packing, url_filters, warc_zip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"))


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc_zip.round_trip(spark, table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score(table(spark, sf_dir, "documents"))


def op5_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_lists.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_url_filters, op2_warc_zip, op3_importance_resampling, op4_deleted_interpolation, op5_decision_lists, op6_best_fit_packing, op7_jaccard_join, op8_decontamination, op9_language_id, op10_line_dedup)
}

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op1_url_filters": f"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_A}', '{_Z}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(rhost, rpath, rverdict)),
        m AS (SELECT page_id, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS n
              FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT p.page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict, CASE WHEN rule IS NULL THEN 'default' ELSE 'rule' END AS via
        FROM p LEFT JOIN m ON p.page_id = m.page_id AND n = 1
    """,
    "op2_warc_zip": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
        FROM w
    """,
    "op7_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_A}', '{_Z}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)] END)) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
        b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.node)
        SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
    """,
    "op8_decontamination": rf"""
        WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item, len(w[p:p+12]) AS n, array_to_string(w[p:p+12], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
        d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        dw AS (SELECT doc_id, n, p, array_to_string(w[p:p+n-1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
        h AS (SELECT doc_id, item, p, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
        c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM h) GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND coalesce(n_hit, 0) * 20 >= len(w) AS contaminated
        FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
    """,
    "op10_line_dedup": """
        WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        w AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS p FROM l WHERE len(ls) >= 3),
        k AS (SELECT doc_id, p, trim(ls[p+1]) AS a, trim(ls[p+2]) AS b, trim(ls[p+3]) AS c FROM w),
        g AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS n FROM k WHERE a || b || c <> ''),
        r AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS pos FROM g WHERE n > 1),
        e AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM l),
        t AS (SELECT e.doc_id, count(r.pos) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY e.pos) FILTER (r.pos IS NULL), '') AS text
              FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.pos = r.pos GROUP BY e.doc_id)
        SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CASE WHEN l.text IS NULL THEN NULL ELSE t.text END AS text
        FROM l LEFT JOIN t ON l.doc_id = t.doc_id
    """,
}
