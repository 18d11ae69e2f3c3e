"""Evidence graph, call graph, degrees and expansion along calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unit_id
from ..functions.rules import file_name
from ..functions.text import call_target


def _or_null(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def evidence_nodes(units: DataFrame, app: DataFrame) -> DataFrame:
    """(id, kind, phase, label, confidence): the app and one node a unit.

    app has one row (package, version_code, version_name, app_name).
    """
    root = app.select(app_id().alias("id"), F.lit("app").alias("kind"), F.lit(None).cast("string").alias("phase"), F.coalesce(_or_null("package"), _or_null("app_name"), F.lit("app")).alias("label"), F.lit(None).cast("double").alias("confidence"))
    label = F.coalesce(*map(_or_null, ("signature", "name", "path", "file")), F.col("unit_id"))
    return root.unionByName(units.select(F.col("unit_id").alias("id"), "kind", "phase", label.alias("label"), F.col("confidence").cast("double").alias("confidence")))


def app_id() -> Column:
    return unit_id(F.lit("app"), F.col("package"), F.col("version_code"), F.col("version_name"))


def evidence_edges(units: DataFrame, app: DataFrame, order: Sequence[Column]) -> DataFrame:
    """(source, target, type): contains, loads_native_library, has_native_target, has_manual_ida_function.

    Libraries are looked up by name or file name; of equal names the last unit in order wins. A loaded
    library is tried as given, as lib<name>.so and as <name>.so, and the first that is known counts.
    """
    root = app.select(app_id().alias("source"))
    # app is one row
    contains = units.select(F.col("unit_id").alias("target")).crossJoin(F.broadcast(root)).select("source", "target", F.lit("contains").alias("type"))
    libs = units.where("kind = 'native_library'").select("unit_id", F.struct(*order).alias("ord"), F.explode(F.array(F.col("name"), file_name(F.coalesce("library", F.lit(""))))).alias("key"))
    libs = libs.where("key is not null and key <> ''").groupBy("key").agg(F.max_by("unit_id", "ord").alias("lib"))
    loads = units.where("kind = 'native_bridge'").select("unit_id", F.posexplode("native_libraries").alias("i", "wanted"))
    tried = loads.select("unit_id", "i", F.posexplode(F.array(F.col("wanted"), F.concat(F.lit("lib"), "wanted", F.lit(".so")), F.concat("wanted", F.lit(".so")))).alias("k", "key"))
    found = tried.join(libs, "key").groupBy("unit_id", "i").agg(F.min_by("lib", "k").alias("target"))
    loaded = found.select(F.col("unit_id").alias("source"), "target", F.lit("loads_native_library").alias("type"))
    targets = units.where("kind in ('native_target', 'manual_ida_function')").select("unit_id", "kind", file_name(F.coalesce("library", F.lit(""))).alias("key"))
    kind = F.when(F.col("kind") == "manual_ida_function", "has_manual_ida_function").otherwise("has_native_target")
    has = targets.join(libs, "key").select(F.col("lib").alias("source"), F.col("unit_id").alias("target"), kind.alias("type"))
    return contains.unionByName(loaded).unionByName(has)


def call_graph(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, library, name, kind) and edges (source, target, type) of (library, name, call_targets)."""
    source = unit_id(F.lit("native_function"), F.col("library"), F.col("name"))
    calls = results.select(source.alias("source"), "library", F.explode("call_targets").alias("call")).withColumn("target", unit_id(F.lit("native_call"), F.col("library"), F.col("call")))
    functions = results.select(source.alias("id"), "library", "name", F.lit("function").alias("kind")).distinct()
    called = calls.select(F.col("target").alias("id"), "library", F.col("call").alias("name"), F.lit("call_target").alias("kind")).distinct()
    return functions.unionByName(called), calls.select("source", "target", F.lit("calls").alias("type"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(library, name, degree): ends of edges at nodes of that library and name."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return nodes.join(ends, "id").groupBy("library", "name").agg(F.sum("n").alias("degree"))


def expand_callees(results: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """(library, name, score, caller): called functions one step on, first caller wins, score + 6.

    results: (library, name, score, call_targets) plus the columns that order names.
    """
    calls = results.select("library", F.col("name").alias("caller"), "score", F.struct(*order).alias("o"), F.posexplode("call_targets").alias("i", "raw"))
    named = calls.withColumn("callee", call_target(F.col("raw"))).where("callee is not null and library <> ''")
    first = named.groupBy("library", "callee").agg(F.min(F.struct("o", "i", "caller", "score")).alias("f"))
    return first.orderBy("f.o", "f.i").limit(limit).select("library", F.col("callee").alias("name"), (F.col("f.score") + 6).alias("score"), F.col("f.caller").alias("caller"))
