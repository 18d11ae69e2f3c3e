"""Sources, ranking, stages and whole runs on generated inputs."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from veinstone import cli
from veinstone.operators import linking, numbering, quality, ranking
from veinstone.plans import code_index, native, packet, resources, runs
from veinstone.plans.config import Config
from veinstone.plans.pipeline import Run
from veinstone.sources import archives as src
from veinstone.sources import documents as docs
from veinstone.streaming import progress_counts, stream_units


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def archives(spark, **named):
    return spark.createDataFrame([(n, len(b), b) for n, b in named.items()], "archive string, size long, content binary")


def test_inventory(spark):
    rows = archives(
        spark, good=zipped({"AndroidManifest.xml": b"<x/>", "assets/ocr_scan_model_tensor.json": b"{}", "lib/arm64-v8a/liba.so": b"x", "classes.dex": b"dex"}), bare=zipped({"classes.dex": b"d"}), empty=zipped({}), bad=b"no zip", evil=zipped({"AndroidManifest.xml": b"<x/>", "lib/../../../escaped.so": b"x"}),
    )
    got = {r["archive"]: r for r in src.inventory(src.entries(rows)).collect()}
    assert got["good"]["success"] and got["good"]["capabilities"] == ["ocr", "scan_image", "local_ml"] and got["good"]["native_library_count"] == 1 and got["good"]["dex_count"] == 1
    assert not got["bare"]["success"] and got["bare"]["validation_errors"] == ["android_manifest_missing"]
    assert "empty_apk_archive" in got["empty"]["validation_errors"] and got["bad"]["validation_errors"][0].startswith("invalid_zip")
    assert not got["evil"]["success"] and got["evil"]["validation_errors"][0].startswith("unsafe_member")
    small = src.check_limits(src.entries(rows), src.Limits(entries=2)).where("archive = 'good'").first()
    assert small["zip_error"] == "too_many_entries"
    natives = src.native_entries(src.entries(rows)).collect()
    assert [(r["abi"], r["name"]) for r in natives] == [("arm64-v8a", "liba.so")]


def test_primary_and_nested(spark):
    df = spark.createDataFrame([("a/one.apk", 5, True), ("a/two.apk", 9, False), ("a/three.apk", 5, True)], "archive string, size long, has_dex boolean")
    assert src.select_primary(df).first()["archive"] == "a/one.apk"
    assert src.select_primary(df.union(spark.createDataFrame([("b/Base.apk", 1, False)], df.schema))).first()["archive"] == "b/Base.apk"
    bundle = archives(spark, x=zipped({"splits/base.apk": zipped({"AndroidManifest.xml": b"m"}), "../evil.apk": b"z", "readme": b"r"}))
    got = src.nested_archives(bundle).collect()
    assert [r["archive"] for r in got] == ["base.apk"] and zipfile.ZipFile(io.BytesIO(got[0]["content"])).namelist() == ["AndroidManifest.xml"]


def test_dex_and_symbols(spark):
    head = bytearray(0x70)
    head[:8] = b"dex\n035\0"
    head[0x60:0x64] = (2).to_bytes(4, "little")
    listing = "Num: Value Size Type Bind Vis Ndx Name\n 1: 0000000000001010 144 FUNC GLOBAL DEFAULT 12 Java_a_B_c\n 2: 0000000000002200 0x10 FUNC GLOBAL DEFAULT 12 run@@V1\n 3: 0000000000000000 0 FUNC GLOBAL DEFAULT UND free\n"
    df = spark.createDataFrame([(bytes(head), listing)], "d binary, s string")
    r = df.select(src.dex_classes(F.col("d")).alias("n"), src.elf_symbols(F.col("s")).alias("s")).first()
    assert r["n"] == 2
    assert [(s["name"], s["address"], s["size_bytes"], s["is_jni"]) for s in r["s"]] == [("Java_a_B_c", "0x1010", 144, True), ("run", "0x2200", 16, False)]


def test_resources_keep_the_late_model(spark):
    names = {f"assets/rules/rule_{i:04d}.txt": b"x" for i in range(801)} | {"assets/ocr/model_labels.txt": b"ocr label"}
    rows = archives(spark, a=zipped(names | {"assets/net.tflite": b"\0\0\0\0TFL3conv2d"}))
    found = resources.candidates(src.entries(rows))
    recs = resources.records(rows)
    s = resources.summary(found, recs).first()
    assert (s["resources_discovered"], s["resources"], s["resources_excluded"], s["models"]) == (802, 800, 2, 1)
    got = {r["path"]: r for r in recs.collect()}
    assert "assets/ocr/model_labels.txt" in got and got["assets/net.tflite"]["model"]["tflite_magic_present"] and got["assets/net.tflite"]["model"]["operator_hints"] == ["conv"]
    assert resources.units(recs).count() == 801


FILES = [
    ("base/sources/com/acme/app/Main.java", 'package com.acme.app;\npublic class Main {\n  public native int run(int x);\n  static { System.loadLibrary("scan"); }\n  // tflite interpreter\n}\n' + "x" * 260_000),
    ("base/sources/okio/Dep.java", "package okio;\nclass Dep { /* tflite */ }\n"), ("base/sources/q/Plain.kt", "package q\nclass Plain\n"), ("base/res/config.xml", "<a>tflite_interpreter</a>"), ("base/sources/z/Gone.java", None),
]


def test_code_index(spark):
    index = code_index.index_files(spark.createDataFrame(FILES, "file string, text string"), Config(app_package="com.acme.app")).cache()
    counts = {r["capability"]: r for r in code_index.capability_counts(index).collect()}["local_ml"]
    assert (counts["total"], counts["comparison"], counts["dependency"], counts["non_code"]) == (3, 1, 1, 1)
    main = index.where("file like '%Main.java'").first()
    assert main["native_methods"] == ["run"] and main["load_libraries"] == ["scan"] and main["ownership"]["category"] == "first_party" and main["char_count"] > 260_000
    assert index.where("read_status = 'failed'").first()["ownership"]["category"] == "unknown"
    snips = code_index.snippets(index)
    units = code_index.units(index, snips)
    assert units.where("kind <> 'code_snippet'").count() == 4 and units.where("kind = 'native_bridge'").count() == 1
    assert code_index.packages(index).count() == 3
    assert code_index.metrics(index, comparison_only=True).first()["matching_files"] == 1


def libraries(spark):
    sym = lambda n, a: (n, a, 10, n.startswith("Java_"))
    rows = [
        ("lib/arm64-v8a/libscan.so", "libscan.so", "arm64-v8a", "a" * 64, 10, ["tflite model"], [sym("Java_com_acme_app_Main_run", "0x1000"), sym("getName", "0x2000"), sym("getName", "0x2000")]),
        ("lib/x86/libscan.so", "libscan.so", "x86", "b" * 64, 10, [], [sym("detect_edges", "0x1000"), sym("ocr_scan", None)]),
        ("lib/x86/liblog.so", "liblog.so", "x86", "c" * 64, 10, None, None),
    ]
    return spark.createDataFrame(rows, native.LIBRARY)


def test_native_ranking(spark):
    config = Config(app_package="com.acme.app")
    index = code_index.index_files(spark.createDataFrame(FILES[:1], "file string, text string"), config)
    recs = native.analyzed(libraries(spark), config)
    links = native.hints(index, recs).cache()
    assert {(r["match_type"], r["symbol"]) for r in links.collect()} == {("load_library", None), ("jni_symbol", "Java_com_acme_app_Main_run")}
    ranked = native.targets(recs, links, config).collect()
    assert ranked[0]["name"] == "Java_com_acme_app_Main_run" or max(ranked, key=lambda r: r["score"])["name"] == "Java_com_acme_app_Main_run"
    best = max(ranked, key=lambda r: r["score"])["score_components"]
    assert best["primary_abi_bonus"] == 16 and best["java_jni_bridge_bonus"] == 12 and best["model_dependency_bonus"] == 10
    tasks = native.tasks(recs, native.targets(recs, links, config), links)
    assert tasks.count() == 4 + 3
    queue = native.review_queue(tasks, 3)
    assert len({r["sha256"] for r in queue.collect()}) == 3 and sorted(r["rank"] for r in queue.collect()) == [1, 2, 3]
    assert native.handoff(queue, 1).count() == 1
    assert native.decompile_plan(native.targets(recs, links, config), config).where("kind = 'library'").isEmpty()
    assert native.units(recs, native.targets(recs, links, config)).where("kind = 'native_library'").count() == 3


def test_function_features(spark):
    ops = '[{"type":"call","opcode":"bl sym.x"},{"opcode":"mov r0, \\"hello world\\""},{"type":"add","refs":[{"type":"CALL","name":"fcn.1"}]}]'
    df = spark.createDataFrame([("l", "f", 'say("some text");\n\n', ops, '[{"jump":"1","fail":"2"},{"jump":"3"}]')], "library string, name string, pseudocode string, ops string, blocks string")
    r = native.function_features(df).first()
    assert (r["instruction_count"], r["basic_block_count"], r["cfg_edge_count"], r["pseudocode_nonempty_line_count"]) == (3, 2, 3, 1)
    assert r["call_targets"] == ["bl sym.x", "fcn.1"] and r["mnemonics"] == ["call", "mov", "add"] and r["string_refs"] == ["hello world", "some text"]


def test_round_robin_equals_the_queue_loop(spark):
    rng = random.Random(4)
    for _ in range(3):
        rows = [(rng.randint(0, 5), rng.randint(0, 50), i) for i in range(60)]
        limit = rng.randint(1, 70)
        buckets = {}
        for b, s, i in sorted(rows, key=lambda r: (-r[1], r[2])):
            buckets.setdefault(b, []).append(i)
        want = []
        while any(buckets.values()) and len(want) < limit:
            for b in sorted(buckets):
                if buckets[b] and len(want) < limit:
                    want.append(buckets[b].pop(0))
        df = spark.createDataFrame(rows, "b int, s int, i int")
        got = [r["i"] for r in ranking.round_robin(df, ["b"], [F.desc("s"), F.col("i")], [F.col("b")], limit, rank="r").orderBy("r").collect()]
        assert got == want


def test_budget_plan_equals_the_greedy_loop(spark):
    rng = random.Random(6)
    for total, libs in ((10, 3), (40, 8), (3, 5)):
        rows = [(f"l{rng.randint(0, 9)}", i) for i in range(80)]
        share, used, want = max(1, -(-total // libs)), {}, []
        for lib, i in rows:
            if len(used) >= libs and lib not in used or used.get(lib, 0) >= share:
                continue
            used[lib] = used.get(lib, 0) + 1
            want.append(i)
            if len(want) >= total:
                break
        got = ranking.budget_plan(spark.createDataFrame(rows, "lib string, i int"), "lib", [F.col("i")], total, libs).collect()
        assert sorted(r["i"] for r in got) == want


def test_numbering_and_systematic_sample(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r["k"] == r["p"] for r in numbering.numbered(df, [F.col("k")], "p").collect())
    got = sorted(r["k"] for r in ranking.systematic_sample(df, [F.col("k")], 7, "k").collect())
    assert got == sorted({round(i * 999 / 6) for i in range(7)})


def test_sample_does_not_starve_small_buckets(spark):
    rows = [(f"u{i:03d}", "code", "source_file", ["ocr"], 0.5) for i in range(300)] + [("n", "native", "native_target", ["ocr"], 0.1)]
    df = spark.createDataFrame(rows, "unit_id string, phase string, kind string, capabilities array<string>, confidence double").withColumns({"category": F.lit(None).cast("string"), "source_type": F.lit("java"), "file": F.lit("a.java")})
    chosen, counts, head = packet.packet(df, {})
    assert head["selected"] == 250 and head["excluded"] == 51 and chosen.where("unit_id = 'n'").count() == 1
    assert "| code | source_file | 300 | 249 | 51 |" in packet.report("t", counts, packet.capability_totals(df))


def test_import_validation(spark):
    tasks = spark.createDataFrame([("t1", "function", "a" * 64, "arm", "f", "0x10"), ("t2", "function", "a" * 64, "arm", "g", "0x20"), ("d", "library_discovery", "a" * 64, "arm", None, None)], "task_id string, task_type string, library_sha256 string, abi string, symbol string, address string")
    libs = spark.createDataFrame([("a" * 64, "arm", "l.so")], "library_sha256 string, abi string, library_name string")
    v = linking.RESULT_SCHEMA
    rows = [
        (1, v, "A" * 64, "arm", "l.so", "9", "t1", "f", "0x10", "code"), (2, v, "a" * 64, "arm", None, "9", "t1", "f", "0x20", "code"), (3, v, "a" * 64, "arm", None, "9", "d", None, "0x99", "code"), (4, v, "a" * 64, "arm", None, "9", "t1", "f", None, "code"),
        (5, v, "a" * 64, "arm", None, "9", "t2", "g", None, "  "), (6, v, "a" * 64, "arm", None, "9", "x", None, "0x77", "code"), (7, "old", "a" * 64, "arm", None, "9", "t1", "f", None, "code"), (8, v, "a" * 64, "arm", "o.so", "9", "t1", "f", None, "code"),
    ]
    df = spark.createDataFrame(rows, "ord int, schema_version string, library_sha256 string, abi string, library_name string, tool_version string, task_id string, symbol string, address string, pseudocode string")
    got = {r["ord"]: (r["error"], r["verification"]) for r in linking.validate_import(df, tasks, libs).collect()}
    assert got[1] == (None, "binary_hash_verified_manifest_task_metadata_matched") and got[3] == (None, "binary_hash_verified_manual_internal_address")
    assert [got[k][0] for k in (2, 4, 5, 6, 7, 8)] == [
        "symbol and address identify different tasks", "duplicate result for the function", "pseudocode is empty", "task_id does not match the discovery task", "unsupported schema_version", "library_name does not match the library",
    ]


def test_status_algebra(spark):
    flags = lambda *states: runs.run_flags(runs.phase_table(spark, [runs.Phase(f"p{i}", s) for i, s in enumerate(states)]))
    assert flags("success", "skipped") == {"all_success": True, "has_partial": False, "has_failed": False}
    assert flags("partial", "success", "failed") == {"all_success": False, "has_partial": True, "has_failed": True}
    with pytest.raises(ValueError):
        flags("done")
    df = spark.createDataFrame([("success",), ("skipped",)], "s string")
    assert df.agg(quality.all_success(F.col("s")).alias("v")).first()["v"]


def test_settings_are_checked():
    Config().validate()
    for bad in ({"max_targets": 0}, {"target_capabilities": ("nothing",)}, {"first_party_hashes": ("xyz",)}, {"first_party_prefixes": ("a.b",), "third_party_prefixes": ("a.b.",)}):
        with pytest.raises(ValueError):
            Config(**bad).validate()
    args = cli._parser().parse_args(["run", "--preset", "handoff", "--input", "i", "--workspace", "w", "--max-targets", "7", "--target-capabilities", "ocr, local_ml", "--no-resource-scan"])
    c = cli.config_of(args)
    assert c.max_targets == 7 and c.max_libraries == 16 and c.target_capabilities == ("ocr", "local_ml") and not c.resource_scan


def test_cache_and_identity(tmp_path):
    out, manifest = tmp_path / "o.json", tmp_path / "m.json"
    made = []

    def compute():
        made.append(1)
        docs.write_document(out, {"n": len(made)})
        return runs.Phase("p", "success", [str(out)])

    key = runs.cache_key("p", "1", "in", {"a": 1})
    assert "cached" not in runs.cached_phase(manifest, key, [out], compute).numbers
    assert runs.cached_phase(manifest, key, [out], compute).numbers["cached"] and len(made) == 1
    docs.write_document(out, {"n": "changed"})
    runs.cached_phase(manifest, key, [out], compute)
    runs.cached_phase(manifest, runs.cache_key("p", "1", "in", {"a": 2}), [out], compute)
    assert len(made) == 3
    a, b = runs.run_context("f", Config(workspace="x")), runs.run_context("f", Config(workspace="y", force=True))
    assert a["analysis_id"] == b["analysis_id"] and a["run_id"] != b["run_id"]
    docs.write_document(tmp_path / "run.json", {"input": "f"})
    runs.guard(tmp_path, "f")
    with pytest.raises(runs.WorkspaceMismatch):
        runs.guard(tmp_path, "g")


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\nbroken\n\n{"a": 2}\n')
    assert sorted((r["a"], r["b"]) for r in docs.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string").collect()) == [(1, "x"), (2, None)]
    folder = tmp_path / "r"
    folder.mkdir()
    for name, body in {"one": '{"a": 1}', "list": '[{"a": 2}, {"a": 3}]', "wrapped": '{"results": [{"a": 4}]}', "bad": "{nope"}.items():
        (folder / f"{name}.json").write_text(body)
    assert sorted(r["a"] for r in docs.read_json_lists(spark, str(folder), "a int").collect()) == [1, 2, 3, 4]
    df = spark.createDataFrame([(2, ["x", "y"])], "b int, a array<string>")
    docs.write_jsonl(df, str(tmp_path / "out"))
    docs.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":["x","y"],"b":2}'
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["a"] == "x,y"


def test_streamed_units(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"phase": "code", "kind": "k"}\n{"phase": "code", "kind": "k"}\nnot json\n')
    q = progress_counts(stream_units(spark, str(tmp_path), "phase string, kind string")).writeStream.outputMode("complete").format("memory").queryName("units_seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select units from units_seen where phase = 'code'").first()["units"] == 2


def test_whole_run(spark, tmp_path):
    apks, code = tmp_path / "in", tmp_path / "src"
    apks.mkdir()
    (apks / "base.apk").write_bytes(zipped({"AndroidManifest.xml": b"<x/>", "assets/ocr_model.json": b"ocr text", "assets/n.tflite": b"1234TFL3"}))
    for name, body in FILES[:4]:
        f = code / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    config = Config(input=str(apks), workspace=str(tmp_path / "ws"), app_package="com.acme.app")
    out = Run(spark, config, str(code), libraries(spark)).execute()
    assert out["all_success"], out
    again = Run(spark, config, str(code), libraries(spark)).execute()
    assert all(p["numbers"].get("cached") for p in again["phases"])
    ws = tmp_path / "ws"
    assert spark.read.parquet(str(ws / "edges")).where("type = 'loads_native_library'").count() == 1
    assert "# Evidence" in (ws / "report.md").read_text()
    (apks / "base.apk").write_bytes(zipped({"classes.dex": b"d"}))
    bad = Run(spark, Config(input=str(apks), workspace=str(tmp_path / "ws2"))).execute()
    assert [p["status"] for p in bad["phases"]] == ["failed", *["skipped"] * 4]
