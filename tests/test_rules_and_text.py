"""Scalar functions: expected values."""

import hashlib

from pyspark.sql import functions as F

from veinstone.functions import hashing, rules, text
from veinstone.operators import scoring, taxonomy


def one(spark, column, **values):
    row = [tuple(values.values())] if values else [(0,)]
    df = spark.createDataFrame(row, [*values] or ["x"])
    return df.select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


def names(spark, value):
    return one(spark, taxonomy.names(taxonomy.classify(lit(value))))


def test_generic_words_have_no_capability(spark):
    assert names(spark, "capital allocation hashmap page form asset api object") == []


def test_strong_signals(spark):
    assert {"document_pdf", "ocr", "local_ml"} <= set(names(spark, "PdfRenderer performs OCR with a TFLite Interpreter"))
    assert names(spark, "assets/ocr_scan_model_tensor.json") == ["ocr", "scan_image", "local_ml"]


def test_match_modes_and_scores(spark):
    hits = one(spark, taxonomy.classify(lit("myocr render document")))
    by = {h["name"]: h for h in hits}
    assert by["ocr"]["match_modes"] == {"ocr": "symbol_affix"} and by["ocr"]["score"] == 3
    assert by["document_pdf"]["hits"] == ["document", "render"] and by["document_pdf"]["strong_hits"] == []


def test_camel_split_keeps_the_acronym_rule(spark):
    assert one(spark, text.tokens(lit("TFLite PDFRenderer x1Y2 getHTTP"))) == ["tf", "lite", "pdf", "renderer", "x", "1", "y", "2", "get", "http"]


def test_split_types(spark):
    for name, kind in {
        "base.apk": "base", "split_config.en.apk": "config_language", "split_config.arm64_v8a.apk": "config_abi", "config.xxhdpi.apk": "config_density", "split_config.b+sr+latn.apk": "config_language",
        "split_feature.apk": "dynamic_feature", "feature_x.apk": "dynamic_feature", "en.apk": "config_language", "pt-rBR.apk": "config_language", "store.apk": "single_or_unknown", "config.zzzzzzzzzzzz.apk": "config_other",
    }.items():
        assert one(spark, rules.split_type(lit(name))) == kind, name


def test_code_ownership_precedence(spark):
    own = lambda p, path="a.java", **k: tuple(one(spark, rules.code_ownership(lit(p), lit(path), **k))[:2])
    assert own("com.acme.app.ui", app_package="com.acme.app") == ("first_party", 0.98)
    assert own("com.acme.lib", app_package="com.acme.app") == ("unknown", 0.45)
    assert own("com.google.x", first=("com.google",)) == ("first_party", 1.0)
    assert own("android.view", third=("android.view",)) == ("platform", 0.98)
    assert own("com.android.billingclient.api") == ("platform", 0.98)
    assert own("okio") == ("third_party", 0.92)
    assert own(None, "x/vendor/a.java") == ("third_party", 0.75)
    assert own("a.b") == ("unknown", 0.25)


def test_native_ownership(spark):
    none = F.array().cast("array<string>")
    own = lambda name, sha=None, jni=none, **k: one(spark, rules.native_ownership(lit(name), lit(sha).cast("string"), jni, **k))["category"]
    h = "a" * 64
    assert own("libx.so", h, first=(h.upper(),)) == "first_party" and own("libx.so", h, third=(h,)) == "third_party"
    assert own("libx.so", None, F.array(lit("Java_com_acme_app_A_f")), app_package="com.acme.app") == "first_party"
    assert own("/a/liblog.so") == "platform" and own("libopencv_core.so") == "third_party" and own("libq.so") == "unknown"


def test_addresses(spark):
    for given, want in {"0x1F": "0x1f", "10": "0xa", "1f": "0x1f", "0X0010": "0x10", "": None, "-4": None, "zz": None, "0": "0x0", "ffffffffffffffff": "0xffffffffffffffff"}.items():
        assert one(spark, rules.address(lit(given))) == want, given


def test_member_safety(spark):
    for name, safe in {"../escape": False, "..\\escape": False, "/absolute/path": False, "C:/absolute/path": False, "splits/base.apk": True, "": False, "a/../b": False}.items():
        assert one(spark, rules.safe_member(lit(name))) == safe, name


def test_stems_and_jni_names(spark):
    assert one(spark, rules.library_stem(lit("/x/libFoo.so"))) == "foo" and one(spark, rules.library_stem(lit("libfoo"))) == "libfoo" and one(spark, rules.library_stem(lit("Bar.so"), lower=False)) == "Bar"
    assert one(spark, rules.jni_prefix(lit("com.a"), lit("B$C"), lit("run"))) == "Java_com_a_B_C_run"


def test_semantic_roles(spark):
    code = "\n".join(f"out[{i}] = (in[{i}] << 2) + k[{i}]; x += 1; for (;;) {{}}" for i in range(24))
    assert one(spark, rules.semantic_role(lit("detect_edges"), lit(code)))["role"] == "algorithm"
    calls = "\n".join(f"step{i}();" for i in range(20))
    assert one(spark, rules.semantic_role(lit("process_page"), lit(calls)))["role"] == "orchestration"
    assert one(spark, rules.semantic_role(lit("getName")))["role"] == "wrapper"
    assert one(spark, rules.semantic_role(lit("jni_bridge")))["confidence"] == "medium"
    assert one(spark, rules.semantic_role(lit("tflite_run")))["role"] == "model_runtime"
    assert one(spark, rules.semantic_role(lit("detect_edges")))["reasons"][0] == "algorithm_name_signal_without_substantive_body"


def test_sketch_ignores_literals(spark):
    a, b = (one(spark, hashing.shingle_sketch(F.col("t")), t=f"int a = {n}; call(0x{n}); return a + {n};") for n in (1, 77))
    assert a["hashes"] == b["hashes"] and a["retained_hash_count"] > 0
    toks = [f"t{c}" for c in "abcdefghij"]
    want = sorted(hashlib.blake2b("\x1f".join(toks[i : i + 5]).encode(), digest_size=8).hexdigest() for i in range(6))
    got = one(spark, hashing.shingle_sketch(F.col("t")), t=" ".join(toks))
    assert got["token_count"] == 10 and got["shingle_count"] == 6 and got["hashes"] == want


def test_extractors(spark):
    java = 'package com.acme.app;\nimport java.util.List;\npublic class Main {\n  static { System.loadLibrary("scan"); }\n  public native int run(int x);\n  String u = "https://a.example/x";\n}\n'
    assert one(spark, text.first_match(lit(java), text.PACKAGE)) == "com.acme.app"
    assert one(spark, text.extract_all(lit(java), text.IMPORT)) == ["java.util.List"]
    assert one(spark, text.extract_all(lit(java), text.CLASS)) == ["Main"]
    assert one(spark, text.extract_all(lit(java), text.NATIVE_METHOD)) == ["run"]
    assert one(spark, text.extract_all(lit(java), text.LOAD_LIBRARY)) == ["scan"]
    assert one(spark, text.extract_all(lit(java), text.URL, 0)) == ["https://a.example/x"]


def test_chunks_overlap(spark):
    s = "".join(chr(97 + i % 26) for i in range(95))
    got = one(spark, text.chunks(lit(s), 30, 5))
    assert got == [s[0:30], s[25:60], s[55:90], s[85:95]]


def test_bytes(spark):
    data = bytes(range(256)) * 4
    df = spark.createDataFrame([(data, b"aaTFL3bbTFL3", b"\x00\x01abcd\x02efg\x03hijkl")], "a binary, b binary, c binary")
    r = df.select(hashing.byte_entropy(F.col("a")).alias("e"), text.magic_offsets(F.col("b"), "TFL3").alias("m"), text.printable_strings(F.col("c")).alias("s")).first()
    assert r["e"] == 8.0 and r["m"] == [2, 8] and r["s"] == ["abcd", "hijkl"]


def test_confidence(spark):
    assert one(spark, rules.confidence(lit(0), lit(3))) == 0.2 and abs(one(spark, rules.confidence(lit(2), lit(20))) - 0.75) < 1e-12


def test_seed_scores(spark):
    p = scoring.ProbeProfile("p", ("libScan.so",), ("libskia",), ("warp",), ("operator",), ("ocr",))
    s = one(spark, scoring.seed_score(lit(5), lit("libscan.so"), lit("deWarp"), lit("jni_symbol"), F.array(lit("ocr")), p))
    assert s["score"] == 5 + 80 + 22 + 13 + 12 and s["admitted"]
    assert not one(spark, scoring.seed_score(lit(500), lit("libskia.so"), lit("deWarp"), lit("jni_symbol"), F.array(lit("ocr")), p))["admitted"]
