"""URL filters: host and path rules, and block decisions carried over redirect and canonical links.

Built from DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, ascii_lower, let, numbered, written
from .graph import connected_components

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("com", "/", ALLOW),
    Rule("example.com", "/en/", BLOCK),
    Rule("www.example.com", "/en/", ALLOW),
    Rule("net", "/es/", BLOCK),
    Rule("net", "/fr/", BLOCK),
)
#: A rule list is compiled into one expression up to this many rules; a longer one is joined as a table.
MAX_RULES = 2000


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, with A-Z lower-cased; null or no ://: empty."""
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(rest) + 4)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or the end; null or no ://: empty."""
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(rest) + 4)).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as struct (rule, verdict), or null. Ties: the last in text order; of equal texts, allow."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text, r.verdict == ALLOW)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def with_rule(rows: DataFrame, host: str, path: str, rules: tuple[Rule, ...], name: str) -> DataFrame:
    """rows with the column `name`: the longest fitting rule of each, as matched_rule gives it.

    A long list is a table: each row meets the rules of its host and of the domains above it by equality,
    and the best of those whose path fits is kept by a grouped maximum.
    """
    if len(rules) <= MAX_RULES:
        return rows.withColumn(name, matched_rule(F.col(host), F.col(path), rules))
    given = numbered(rows)
    listed = rows.sparkSession.createDataFrame([(r.host, r.path, len(r.text), r.text, r.verdict == ALLOW, i, r.verdict) for i, r in enumerate(rules)], "__h string, __p string, n int, rule string, allow boolean, i int, verdict string")
    parts = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = given.select(ROW, F.col(path).alias("__path"), F.explode(above).alias("__h")).join(listed, "__h").where(F.startswith("__path", F.col("__p")))
    best = met.groupBy(ROW).agg(F.max(F.struct("n", "rule", "allow", "i", "verdict")).alias("m")).select(ROW, F.struct("m.rule", "m.verdict").alias(name))
    return given.join(best, ROW, "left").drop(ROW)


def node_of(url: Column) -> Column:
    """A URL without its fragment and with a lower-case host: what redirects and links name."""
    return let(url, _node)


def _node(url: Column) -> Column:
    scheme = F.lower(F.substring_index(url, "://", 1))
    bare = F.regexp_replace(url, r"#.*$", "")
    return F.when(
        F.contains(url, F.lit("://")),
        F.concat(scheme, F.lit("://"), host_of(url), F.regexp_extract(bare, r"^.*?://[^/?#]*(.*)$", 1)),
    )


def resolve(base: Column, ref: Column) -> Column:
    """An absolute URL for ref as found on the page base: absolute, //host, /path or a sibling path."""
    return let(F.struct(base.alias("b"), ref.alias("r")), lambda x: _resolved(x["b"], x["r"]))


def _resolved(base: Column, ref: Column) -> Column:
    scheme, origin = F.substring_index(base, "://", 1), F.regexp_extract(base, r"^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^(.*?://[^?#]*/)", 1)
    return (
        F.when(ref.isNull() | (ref == ""), None)
        .when(F.contains(ref, F.lit("://")), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(origin, ref))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), ref))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (src, dst) of canonical links and meta refreshes in the pages' HTML."""
    page, doc = F.col(url), F.col(html)
    link = F.regexp_extract(doc, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    meta = F.regexp_extract(doc, r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"'][^\"'>]*?url\s*=\s*([^\"'\s>]+)", 1)
    some = doc.rlike(r"(?i)\brel\s*=\s*[\"']?canonical|\bhttp-equiv\s*=\s*[\"']?refresh")
    found = pages.where(page.isNotNull() & some).select(page.alias("page"), F.explode(F.array(link, meta)).alias("ref")).where("ref <> ''")
    return found.select(node_of(F.col("page")).alias("src"), node_of(resolve(F.col("page"), F.regexp_replace("ref", "&amp;", "&"))).alias("dst"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str | None = "html", default: str = ALLOW) -> DataFrame:
    """Judge every URL: (key, host, path, rule, verdict, via).

    A URL's own rule decides. Without one, the URL is blocked if any URL of its class (connected by
    redirects or canonical links, aliases included) is blocked by rule; an explicit allow keeps its own
    URL allowed but lifts no block from aliases. Otherwise the default holds. via: rule, alias or default.

    redirects: optional further edges (src, dst) as URLs. Null URL, or one without ://: empty host and
    path, the default. Repeated rows and equal URLs are judged alike, a row each; other columns are left
    out. Empty table: no rows.
    """
    own = pages.select(F.col(key).alias("k"), F.col(url).alias("u"))
    edges = []
    if html is not None:
        edges.append(link_edges(pages, url, html))
    if redirects is not None:
        edges.append(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    judged = own.select("k", "u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    judged = with_rule(judged, "host", "path", rules, "m")
    blocked = None
    if edges:
        e = edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1])
        e = written(e, "links").where("src <> dst").distinct()
        if not e.isEmpty():
            comp = written(connected_components(e, "src", "dst"), "aliases")
            named = with_rule(comp.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), "host", "path", rules, "m")
            bad = named.where(F.col("m.verdict") == BLOCK).select("component").distinct()
            blocked = comp.join(bad, "component", "left_semi").select(F.col("node"), F.lit(True).alias("hit"))
    if blocked is None:
        judged = judged.withColumn("hit", F.lit(None).cast("boolean"))
    else:
        judged = judged.withColumn("node", node_of(F.col("u"))).join(blocked, "node", "left")
    via = F.when(F.col("m").isNotNull(), "rule").when(F.col("hit"), "alias").otherwise("default")
    verdict = F.coalesce(F.col("m.verdict"), F.when(F.col("hit"), F.lit(BLOCK)), F.lit(default))
    return judged.select(F.col("k").alias(key), "host", "path", F.col("m.rule").alias("rule"), verdict.alias("verdict"), via.alias("via"))
