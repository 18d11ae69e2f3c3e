"""The bridge map against the pairwise loop, and the parts of a review around it."""

import json
import random

import duckdb
from pyspark.sql import functions as F

from veinstone import queries, stage_queries
from veinstone.operators import linking, ranking, scoring
from veinstone.plans import code_index, native, packet, review
from veinstone.sources import archives as src

FILE = "file string, package string, class_name string, native_methods array<string>, load_libraries array<string>"
SYMBOL = "library string, library_name string, abi string, symbol string, address string, ord int"
UNIT = "unit_id string, kind string, name string, library string, abi string, score int, ord int"


def stem(name):
    x = name.rsplit("/", 1)[-1].lower()
    return x[3:-3] if x.startswith("lib") and x.endswith(".so") else x.removesuffix(".so")


def fits(symbol, method, expected):
    return expected in symbol or symbol.endswith("_" + method) or f"_{method}__" in symbol


def test_bridge_map_equals_the_pairwise_loop(spark):
    rng = random.Random(3)
    methods = ["a", "go", "run", "run_it", "runFast", "_x", "Über"]
    libs = [f"lib{c}.so" for c in "pqrs"]
    files = [(f"F{i}", rng.choice(["q.w", "", None]), rng.choice(["C", "D$E", None]), rng.sample(methods, rng.randint(0, 3)), rng.sample(["p", "libq.so", "zz"], rng.randint(0, 2))) for i in range(40)]
    symbols = []
    for i in range(150):
        lib = rng.choice(libs)
        name = rng.choice(["Java_q_w_C_", "Java_D_E_", "x_", "", "Java_"]) + rng.choice(methods) + rng.choice(["", "__I", "2", "_"])
        symbols.append((f"/l/{lib}", lib, "x86", name, None, i))
    units = [(f"u{i}", "native_library", lib, f"/l/{lib}", "x86", 1, i) for i, lib in enumerate(libs)] + [(f"t{i}", "native_target", s[3], s[0], "x86", 1, 100 + i) for i, s in enumerate(symbols[:60])]
    limit = 5
    got = review.bridge_map(spark.createDataFrame(files, FILE), spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(units, UNIT), limit).collect()
    want = {}
    for file, package, cls, native_methods, loads in files:
        if not native_methods and not loads:
            continue
        stems = {stem(x) for x in loads}
        near = [u[0] for s in sorted(stems) for u in units if u[1] == "native_library" and stem(u[2]) == s][:limit]
        for m in native_methods or [None]:
            expected = "_".join(["Java", *[x.replace(".", "_").replace("$", "_") for x in (package, cls) if x], m or ""]) if m else None
            ok = lambda lib, name: (not stems or stem(lib) in stems) and (fits(name, m, expected) if m else stem(lib) in stems)  # noqa: B023, E731
            syms = [s[3] for s in symbols if ok(s[0], s[3])][:limit]
            tgts = [u[0] for u in units if u[1] == "native_target" and ok(u[3], u[2])][:limit]
            want[file, m] = (expected, near, syms, tgts, "candidate" if syms or tgts else "library_only")
    seen = {(r["java_file"], r["native_method"]): (r["expected_jni_prefix"], [x["unit_id"] for x in r["matched_native_libraries"]], [x["symbol"] for x in r["candidate_symbols"]], [x["unit_id"] for x in r["candidate_native_targets"]], r["confidence"]) for r in got}
    assert seen == want and len(got) == len(want)


def test_bridge_map_counts_what_its_lists_leave_out(spark, tmp_path):
    spark.range(12).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(131).toDF("s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for name in ("part", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = stage_queries.q_bridge_map(spark, str(tmp_path)).collect()
    assert max(r["n_symbols"] for r in got) == 42  # run1: 1, 10 to 19, 100 to 130
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(queries.ORACLE_SQL["q_bridge_map"]).fetchall()))
    # two rows of one file, its lists cut; a library that shares two stems with the file counts once
    files = [("F", "q", "C", ["run"], []), ("F", "q", "C", ["run"], []), ("G", "", "", [], ["a", "b"])]
    symbols = [("/l/liba.so", "libb.so", "x86", f"Java_q_C_run__{i}", None, i) for i in range(7)]
    units = [(f"u{i}", "native_library", "liba.so", "/l/libb.so", "x86", 1, i) for i in range(3)]
    rows = review.bridge_map(spark.createDataFrame(files, FILE), spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(units, UNIT), 5).collect()
    seen = sorted((r["java_file"], len(r["candidate_symbols"]), r["n_symbols"], len(r["matched_native_libraries"]), r["n_libraries"], r["n_targets"]) for r in rows)
    assert seen == [("F", 5, 7, 0, 0, 0), ("F", 5, 7, 0, 0, 0), ("G", 5, 7, 5, 6, 0)]


def test_decisions(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "kind string, score int, capabilities array<string>")
    decide = lambda df, tool="rizin": tuple(native.decompile_decision(df, tool).first())
    assert decide(rows()) == (False, "no_callable_native_targets", 0, None, None)
    one = rows(("jni_symbol", 12, ["ocr"]), ("string", 99, None), ("exported_symbol", 17, None))
    assert decide(one) == (True, "high_value_native_targets", 2, 1, 12)
    assert decide(one, None)[:2] == (False, "decompiler_missing") and decide(one, "ghidra")[:2] == (False, "decompiler_adapter_not_automated")
    assert decide(rows(("jni_symbol", 17, [])))[1:] == ("low_value_native_targets", 1, None, 17)


def test_queue_profiles_and_hashes(spark, tmp_path):
    queue = spark.createDataFrame([("t1", 1), ("t2", 2), ("t3", 3)], "task_id string, rank int")
    found = spark.createDataFrame([("t1", 1, "old"), ("t1", 2, "new"), ("t3", 1, "x")], "task_id string, ord int, name string")
    assert sorted(tuple(r) for r in linking.queued_candidates(queue, found).collect()) == [("t1", 1, "new"), ("t3", 3, "x")]
    (tmp_path / "p.json").write_text(json.dumps({"description": "d", "priority_libraries": ["a.so"], "default_limits": {"max": 3}}))
    assert scoring.profile_names(tmp_path) == ["p"]
    profile = scoring.read_profile(tmp_path / "p.json")
    assert (profile.name, profile.priority_libraries, profile.seed_name_patterns) == ("p", ("a.so",), ())
    files = spark.createDataFrame([("a", b"abc"), ("b", b"x")], "path string, content binary")
    picked = spark.createDataFrame([("a", "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"), ("b", "00"), ("c", "00")], "path string, sha256 string")
    assert {r["path"]: r["skipped"] for r in src.verified(picked, files).collect()} == {"a": None, "b": "library_hash_mismatch", "c": "library_file_missing"}
    top = ranking.first_ranked(spark.range(20), [F.desc("id")], 3, "rank").collect()
    assert [(r["id"], r["rank"]) for r in sorted(top, key=lambda r: r["rank"])] == [(19, 1), (18, 2), (17, 3)]


def test_orders(spark):
    units = spark.createDataFrame([("platform", 0.9, "k", "a"), ("first_party", 0.2, "k", "b"), ("first_party", 0.5, "k", "c"), (None, 0.9, "k", "d")], "category string, confidence double, kind string, file string")
    assert [r["file"] for r in units.orderBy(*code_index.unit_order()).collect()] == ["c", "b", "d", "a"]
    libs = spark.createDataFrame([("z", {"ocr": 1}), ("a", {"ocr": 1}), ("m", {"ocr": 1, "local_ml": 4}), ("b", None)], "name string, capability_counts map<string,int>").withColumn("abi", F.lit("x86"))
    assert [r["name"] for r in libs.orderBy(*native.library_order()).collect()] == ["m", "a", "z", "b"]
    rows = spark.createDataFrame([("l", 1, "b"), ("l", 9, "c"), ("a", None, "x")], "library string, score int, name string")
    assert [r["name"] for r in rows.orderBy(*native.feature_order()).collect()] == ["x", "c", "b"]


def test_report_says_what_it_leaves_out(spark):
    counts = spark.createDataFrame([("p", f"k{i:02}", 1) for i in range(7)], "phase string, kind string, n int")
    totals = spark.createDataFrame([("c", "p", 7)], "capability string, phase string, n int")
    out = packet.report("T", counts, totals, limit=5)
    assert "k04" in out and "k05" not in out and "2 further rows" in out and out.count("further") == 1
