"""Every corpus operator on nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

from pathlib import Path

import numpy as np
import pytest

from veinstone.llm import decision_lists, decontamination, deleted_interpolation, importance, jaccard_join, language_id, line_dedup, packing, url_filters, warc_zip
from veinstone.llm.queries import tokenizer_path
from veinstone.storage import shared_dir

KIND = "doc_id long, text string, lang string, w long, rid string, print string, `a.b` string"
LONG = "word " * 30_000 + "\n" + "eins zwei drei vier\n" * 300


def rows():
    base = [
        (1, "Der Hund und die Katze sind nicht hier.\nA\nB\nC", "de"), (2, None, "de"), (3, "", "en"), (4, "   \n\t\n \x0b", "en"), (5, "12 34 !!", None),
        (6, "The cat and the dog are not here and that is that, said the man of the house.", "en"), (6, "The cat and the dog are not here and that is that, said the man of the house.", "en"),
        (None, "The bird of the tree was in the garden with the man for the day.", "en"), (None, None, None), (7, LONG, "en"), (8, "one", "en"), (9, "été où l'élève était à côté", "fr"),
        (9, "same id, other text\nA\nB\nC", "en"),
    ]
    return [(i, t, lang, 5, "r", "p", "x") for i, t, lang in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, None, 1), (None, 1, 0), (6, 1, 0), (7, 0, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the dog are not here and that is that said the man of the house"), (2, None), (3, ""), (4, "one"), (10, "ONE")], "item_id long, text string")


def ids(out, c="doc_id"):
    return sorted((r[c] is None, r[c] or 0) for r in out.collect())


WANT = sorted((i is None, i or 0) for i, *_ in rows())


def test_language_id(spark, docs, none):
    out = language_id.identify(docs)
    assert ids(out) == WANT
    got = {r["doc_id"]: r for r in out.collect()}
    for k in (2, 3, 4, 5):
        assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert not got[None]["held_out"]
    assert language_id.identify(none).count() == 0
    model = language_id.train(language_id.np.zeros((0, language_id.TABLE_SIZE)), [])
    assert model.predict(b"text")[0] == "und"


def test_importance(spark, docs, none, labels):
    out = importance.resample(docs, labels)
    assert ids(out) == WANT
    # equal rows share a key: both or neither are in
    assert sum(r["selected"] for r in out.collect()) in (10, 11)
    assert importance.resample(none, labels).count() == 0
    assert {r["log_weight"] for r in importance.resample(docs, labels.limit(0)).collect()} == {0.0}


def test_interpolation(spark, docs, none):
    out = deleted_interpolation.score(docs)
    assert ids(out) == WANT
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == got[4]["n_tokens"] == 1
    assert all(r["score"] < 0 for r in out.collect())
    assert deleted_interpolation.score(none).count() == 0


def test_decision_lists(spark, docs, none, labels):
    out = decision_lists.judge_quality(docs, labels)
    assert ids(out) == WANT
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert got[7]["n_words"] == 31_200 and got[7]["n_repeat_words"] == 31_200 and got[7]["base_failed"]
    assert decision_lists.judge_quality(none, labels).count() == 0
    assert decision_lists.judge_quality(docs, labels.limit(0)).count() == len(WANT)


def test_packing(spark, docs, none):
    out = packing.pack(docs, tokenizer_path()).collect()
    assert {(r["doc_id"] is None, r["doc_id"] or 0) for r in out} == set(WANT)
    assert sum(r["doc_id"] == 6 for r in out) == 2
    assert [r["length"] for r in out if r["doc_id"] == 2] == [1]
    assert packing.pack(none, tokenizer_path()).count() == 0
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_packing_writes_few_files_and_keeps_no_long_word(spark, docs):
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    folder = Path(shared_dir(spark).removeprefix("file:")) / "veinstone"
    before = set(folder.glob("lengths-*"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = packing.pack(docs.union(docs.selectExpr("doc_id", "repeat(concat(text, ' w '), 1 + doc_id) text", *docs.columns[2:4], "rid", "print", "`a.b`")), tokenizer_path())
        (lengths,) = set(folder.glob("lengths-*")) - before
        assert len(list(lengths.glob("*.parquet"))) <= spark.sparkContext.defaultParallelism
        ends = sorted((r["sequence_id"], r["offset"], r["offset"] + r["length"]) for r in got.collect())
        assert all(a[2] == b[1] if a[0] == b[0] else b[1] == 0 for a, b in zip(ends, ends[1:], strict=False)) and len(ends) >= 2 * docs.count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    tokens = packing.WordTokens(tokenizer_path())
    texts = ["ab " + "x1-" * 1000 + " cd", "y" * 3000 + ".", "été" * 500]
    assert [list(np.frombuffer(tokens.encode(t.encode()), "<u4")) for t in texts] == [tokens.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(map(len, tokens)) <= packing.CACHE_BYTES


def test_jaccard(spark, docs, none):
    out = jaccard_join.jaccard_components(docs)
    assert ids(out) == WANT
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in out.collect()}
    assert got[(2, 0)] == 2 and got[(3, 0)] == 3 and got[(4, 0)] == 4 and got[(None, 0)] is None
    assert {c for (d, n), c in got.items() if d == 6} == {6}
    assert jaccard_join.jaccard_components(none).count() == 0


def test_decontamination(spark, docs, none, benchmark):
    out = decontamination.judge(docs, benchmark)
    assert ids(out) == WANT
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["n_words"] == 0 and not got[2]["contaminated"]
    assert got[6]["contaminated"] and got[6]["n_hit"] == 15 and got[6]["n_items"] == 1
    assert got[8]["contaminated"] and got[8]["n_items"] == 2
    assert decontamination.judge(none, benchmark).count() == 0
    assert not any(r["n_hit"] for r in decontamination.judge(docs, benchmark.limit(0)).collect())
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and 6 not in {r["doc_id"] for r in kept.collect()}


def test_line_dedup(spark, docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "__vs_cut"]
    assert ids(out) == WANT
    got = {(r["doc_id"], r["lang"]): r for r in out.collect()}
    assert got[(1, "de")]["__vs_cut"] == 0 and got[(9, "en")]["text"] == "same id, other text"
    assert got[(2, "de")]["text"] is None and got[(3, "en")]["text"] == ""
    assert got[(7, "en")]["__vs_cut"] == 299
    assert line_dedup.dedup_report(none).count() == 0


PAGE = "page_id long, url string, html string, host string, k string"


def test_url_filters(spark):
    link = '<link href="{}" rel=canonical>'
    data = [
        (1, "http://A.net/fr/x", None), (2, "http://b.com/1", link.format("http://a.net/fr/x")), (3, "http://c.org/q/z#f", link.format("//b.com/1")), (4, None, ""), (5, "no host", link.format("x")),
        (None, "http://www.example.com/en/", ""), (7, "http://x.example.com/en/p?q", ""), (8, "http://d.io", '<meta http-equiv="refresh" content="0; url=http://c.org/q/z">'), (8, "http://d.io", "x" * 200_000),
    ]
    pages = spark.createDataFrame([(*x, "h", "k") for x in data], PAGE)
    got = {(r["page_id"], r["via"]): (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages).collect()}
    assert got[(1, "rule")] == ("a.net", "/fr/x", "net/fr/", "block")
    assert got[(2, "rule")] == ("b.com", "/1", "com/", "allow")
    assert got[(3, "alias")] == ("c.org", "/q/z", None, "block")
    assert got[(4, "default")] == got[(5, "default")] == ("", "", None, "allow")
    assert got[(None, "rule")][2:] == ("www.example.com/en/", "allow")
    assert got[(7, "rule")][2:] == ("example.com/en/", "block")
    assert got[(8, "alias")] == ("d.io", "", None, "block")
    assert url_filters.filter_urls(pages.limit(0)).count() == 0
    more = spark.createDataFrame([("http://a.net/fr/x", "http://new.org/"), (None, "http://new.org/")], "src string, dst string")
    new = spark.createDataFrame([(1, "http://new.org/", "", "", "")], PAGE)
    assert url_filters.filter_urls(new, redirects=more).first()["verdict"] == "block"


def test_warc(spark):
    big = "ü" * 600
    data = [(1, "http://a", big), (2, "b\r\nc", big), (3, None, big), (4, "d", None), (5, "e", ""), (6, "f", "x" * 999), (7, "g", "x" * 999), (None, "h", big), (3, "i", big), (9, "j", "y" * 2_000_000)]
    pages = spark.createDataFrame([(*x, "h", "k") for x in data], PAGE)
    got = warc_zip.round_trip(spark, pages).collect()
    assert len(got) == len(data)
    kinds = {}
    for r in got:
        kinds.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"], r["payload_bytes"]))
    assert kinds[1] == kinds[2] == [("revisit", 3, 1200)] and kinds[3] == [("response", None, 1200)] * 2
    assert kinds[4] == kinds[5] == [("response", None, 0)] and kinds[6] == kinds[7] == [("response", None, 999)]
    assert kinds[None] == [("response", None, 1200)] and kinds[9][0][2] == 2_000_000
    assert warc_zip.round_trip(spark, pages.limit(0)).count() == 0
