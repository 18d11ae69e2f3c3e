"""Cases in which an operator once did less than its whole job."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_brute import components, shingles
from veinstone.llm import decontamination, jaccard_join, language_id, line_dedup, url_filters, warc_zip


def test_jaccard_keeps_members_that_no_hub_was_compared_with(spark):
    """x hangs on the hub h through m alone, and its size rules out a comparison with h; y is similar to x alone."""
    h = [f"h{i}" for i in range(100)]
    m = [*h[1:], *(f"m{i}" for i in range(7))]
    x = [*m[2:], *(f"x{i}" for i in range(8))]
    y = [w for w in x if w not in {"m0", *h[3:11]}]
    # the words in which they differ are frequent, so lists hold those that all share; m0 links m with x
    usual = [w for w in {*h, *m, *x, *y} if w != "m0" and not all(w in s for s in (h, m, x, y))]
    docs = [h, m, x, y, *([*usual, *(f"o{k}.{i}" for i in range(300))] for k in range(6))]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    want = components({i: frozenset(d) for i, d in enumerate(docs)})
    assert want[3] == 0
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_pipeline_drops_five_word_near_copies(spark):
    """One to six scattered edits in 100 words, against a brute force over five words and four fifths."""
    rng = random.Random(3)
    docs = []
    for f in range(6):
        text = [f"t{f}.{i}" for i in range(100)]
        docs.append(text)
        for edits in range(1, 7):
            at = set(rng.sample(range(5, 95, 8), edits))
            docs.append([f"e{f}.{edits}.{i}" if i in at else w for i, w in enumerate(text)])
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    want = components({i: shingles(t, 5) for i, t in rows}, 80)
    assert want != components({i: shingles(t) for i, t in rows})
    got = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in got.collect()} == {i for i, c in want.items() if c == i}


def test_short_item_at_a_documents_end(spark):
    """A short item's window is no hit of a longer window that the text's end cuts short."""
    item, long = [f"s{i}" for i in range(8)], [f"l{i}" for i in range(20)]
    docs = [[*(f"a{i}" for i in range(192)), *item], item, [*item, *(f"b{i}" for i in range(32))], [*(f"c{i}" for i in range(30)), *long[3:18]]]
    kind = "long, text string"
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long))], f"item_id {kind}")
    out = decontamination.judge(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], f"doc_id {kind}"), benchmark)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in out.collect()}
    assert got == {0: (200, 8, 1, False), 1: (8, 8, 1, True), 2: (40, 8, 1, True), 3: (45, 15, 1, True)}


def test_rows_of_one_id_are_judged_one_by_one(spark):
    """Null and repeated ids: only the contaminated rows go, and of equal copies one row stays."""
    bad, clean, copy = (" ".join(f"{k}{i}" for i in range(30)) for k in "bcd")
    rows = [(None, bad), (None, clean), (1, bad), (1, clean), (2, copy), (2, copy), (None, copy), (3, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, `a.b` int")
    benchmark = spark.createDataFrame([(1, bad)], "item_id long, text string")
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    order = lambda x: sorted(x, key=str)
    assert order((r[0], r[1]) for r in kept.collect()) == order(r for r in rows if r[1] != bad)
    single = cp.drop_near_duplicates(spark, docs, "")
    assert single.columns == docs.columns
    assert order((r[0], r[1]) for r in single.collect()) == order([(1, bad), (1, clean), (2, copy), (3, "")])
    alone = docs.where("doc_id is null").unionByName(docs.where("doc_id is null"))
    assert order((r[0], r[1]) for r in cp.drop_near_duplicates(spark, alone, "").collect()) == order((None, x) for x in (bad, clean, copy))


def test_every_language_is_learned(spark):
    rows = [(i, f"w{i % 70}x y{i % 70}z", f"l{i % 70:02}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit(docs).labels == [f"l{i:02}" for i in range(70)]
    assert language_id.per_lang(4) == 500 and language_id.per_lang(70) == 114 and language_id.per_lang(10**6) == 1


def test_spans_are_cut_row_by_row(spark, monkeypatch):
    """Null and repeated ids, a table of windows too large to broadcast, and rows that came through a shuffle."""
    bad, clean = (" ".join(f"{k}{i}" for i in range(30)) for k in "bc")
    rows = [(None, bad), (None, clean), (5, bad), (5, f"{clean} {bad} tail"), (6, None), (6, ""), (7, "b0 b1 b2 " + clean)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int")
    benchmark = spark.createDataFrame([(1, bad), (None, " ".join(f"z{i}" for i in range(9))), (2, ""), (3, None)], "item_id long, text string")
    order = lambda x: sorted(x, key=str)
    want = order([(None, ""), (None, clean), (5, ""), (5, f"{clean} tail"), (6, ""), (6, ""), (7, "b0 b1 b2 " + clean)])
    verdicts = order([(None, 30, 30, True), (None, 30, 0, False), (5, 30, 30, True), (5, 61, 30, True), (6, 0, 0, False), (6, 0, 0, False), (7, 33, 0, False)])
    for limit in (20_000, 3):
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", limit)
        for table in (docs, docs.repartition(5, "n")):
            assert order(tuple(r) for r in decontamination.cut_spans(table, benchmark).collect()) == want
            got = decontamination.judge(table, benchmark).collect()
            assert order((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in got) == verdicts


def test_crowded_hash_set_changes_nothing(spark, monkeypatch):
    """With a set so small that most bits are taken, whole windows still decide."""
    monkeypatch.setattr(decontamination, "WORDS_LOG2", 2)
    rng = random.Random(2)
    item = lambda k: " ".join(f"v{rng.randrange(40)}" for _ in range(k))
    items = [item(rng.randint(1, 30)) for _ in range(60)]
    docs = [" ".join([item(40), rng.choice(items), item(20)]) for _ in range(50)]
    got = decontamination.judge(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    wins = {tuple(w[k : k + 13]) for w in map(str.split, items) for k in range(max(1, len(w) - 12))}
    for r in got:
        w, hit = docs[r["doc_id"]].split(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
        assert (r["n_words"], r["n_hit"]) == (len(w), len(hit))


def naive_grams(text):
    data = (b" " + text + b" ").translate(language_id._TABLE)
    out = Counter()
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            h = data[i]
            for b in data[i + 1 : i + n]:
                h = (h * 257 + b) & 0xFFFFFFFF
            out[((h * 2654435761 + n * 40503) & 0xFFFFFFFF) >> 20] += 1
    return out


def test_gram_counts(monkeypatch):
    rng = random.Random(6)
    texts = [b"", b"a", b"Hello, W\xc3\xb6rld 123!", bytes(rng.randrange(256) for _ in range(700))]
    for segment in (1 << 20, 7, 64):
        monkeypatch.setattr(language_id, "_SEGMENT", segment)
        for t in texts:
            got = language_id.gram_counts(t)
            assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == naive_grams(t)


def test_training_steps_and_calibration():
    """One epoch against gradients taken row by row, then the temperature and the bound by their definitions."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (40, language_id.TABLE_SIZE)).astype(np.float32)
    langs = [["aa", "bb", "cc"][k % 3] for k in range(40)]
    for k in range(40):
        x[k, (k % 3) * 50 : (k % 3) * 50 + 50] += 40
    model = language_id.train(x.copy(), langs, epochs=1, rate=0.1, batch=8, seed=3)
    g = np.random.default_rng(3)
    order = g.permutation(40)
    held, fit = order[::5], order[np.arange(40) % 5 > 0]
    unit = x / x.sum(1, keepdims=True)
    emb = g.normal(0, 1, (language_id.TABLE_SIZE, language_id.WIDTH)).astype(np.float32).astype(float)
    out, bias = np.zeros((language_id.WIDTH, 3)), np.zeros(3)
    g.shuffle(fit)
    y = [k % 3 for k in range(40)]

    def soft(z):
        p = np.exp(z - z.max())
        return p / p.sum()

    for at in range(0, len(fit), 8):
        rows = fit[at : at + 8]
        d_out, d_bias, d_emb = np.zeros_like(out), np.zeros_like(bias), np.zeros_like(emb)
        for r in rows:
            mean = unit[r] @ emb
            err = soft(mean @ out + bias) - np.eye(3)[y[r]]
            d_out += np.outer(mean, err) / len(rows)
            d_bias += err / len(rows)
            d_emb += np.outer(unit[r], out @ err) / len(rows)
        out, bias, emb = out - 0.1 * d_out, bias - 0.1 * d_bias, emb - 0.1 * 50 * d_emb
    assert np.allclose(model.weights, emb @ out, atol=1e-4) and np.allclose(model.bias, bias, atol=1e-5)
    z = unit[held] @ model.weights + model.bias
    loss = lambda t: -np.mean([np.log(soft(z[k] / t)[y[r]]) for k, r in enumerate(held)])
    grid = [0.05 * 1.25**k for k in range(30)]
    assert np.isclose(loss(model.temperature), min(map(loss, grid)))
    right = [soft(z[k] / model.temperature).max() for k, r in enumerate(held) if z[k].argmax() == y[r]]
    assert np.isclose(model.reject, min(language_id.REJECT_CEILING, np.quantile(right, language_id.REJECT_QUANTILE)), atol=1e-5)


def test_language_query_is_the_model_on_its_sample(spark, monkeypatch):
    """The sample by its definition, and every row as the model trained on it predicts."""
    rng = random.Random(8)
    voc = {"aa": "das und der nicht", "bb": "the and of not", "cc": "le et la pas", None: "lorem ipsum"}
    rows = []
    for i in range(900):
        lang = rng.choice(["aa", "aa", "aa", "bb", "cc", None])
        rows.append((i if i % 50 else None, None if i % 97 == 0 else " ".join(rng.choice(voc[lang].split()) for _ in range(rng.randint(0, 20))), lang))
    rows += rows[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "SAMPLE_PER_LANG", 30)
    hashes = {r["doc_id"]: (r["h"], r["m"]) for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).alias("m")).collect()}
    pool = defaultdict(set)
    for i, t, lang in rows:
        if i is not None and t is not None and lang is not None and hashes[i][1]:
            pool[lang].add((hashes[i][0], i))
    want = {(i, lang) for lang, ids in pool.items() for _, i in sorted(ids)[:30]}
    assert {tuple(r) for r in language_id.sample_ids(docs).collect()} == want
    model = language_id.fit(docs)
    for r, (i, t, _) in zip(sorted(language_id.identify(docs, model).collect(), key=str), sorted(rows, key=lambda r: (str(r[0]), str(r[1]))), strict=False):
        assert r["held_out"] == (r["doc_id"] is not None and hashes[r["doc_id"]][1] == 0)
    texts = Counter((i, *model.predict(t.encode() if t is not None else None)) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in language_id.identify(docs, model).collect()) == texts


def test_aliases_at_size(spark):
    """Chains, a hub of a third of all links, and allowed URLs in blocked classes, over 100,000 pages."""
    n = 100_000
    host = F.when(F.col("id") % 9 == 4, "www.example.com").when(F.col("id") % 11 == 5, "a.example.com").otherwise(F.concat(F.lit("h"), F.col("id") % 50, F.lit(".org")))
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), host, F.lit("/en/"), F.col("id")).alias("url"), F.lit(None).cast("string").alias("html"))
    url = {r["page_id"]: r["url"] for r in pages.collect()}
    link = [(k, k + 1) for k in range(1, n // 3) if k % 7] + [(k, 0) for k in range(n // 3, 2 * n // 3)]
    links = spark.createDataFrame([(url[a], url[b]) for a, b in link], "src string, dst string")
    par = list(range(n))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in link:
        par[find(a)] = find(b)

    def own(u):
        return "allow" if "//www.example.com/" in u else "block" if "example.com/" in u else None

    bad = {find(k) for k in range(n) if own(url[k]) == "block"}
    got = {r["page_id"]: (r["verdict"], r["via"]) for r in url_filters.filter_urls(pages, redirects=links).collect()}
    for k in range(n):
        want = (own(url[k]), "rule") if own(url[k]) else ("block", "alias") if find(k) in bad else ("allow", "default")
        assert got[k] == want, url[k]


def test_long_runs_of_repeated_lines(spark):
    """Overlapping, touching and lone windows in one text, and a text that repeats itself thousands of times."""
    rng = random.Random(1)
    lines = [f"l{i}" for i in range(12)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["a\nb\n" * 4000]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        x, cut = t.split("\n"), set()
        for p in range(len(x) - 2):
            key = tuple(x[p : p + 3])
            if "".join(key):
                if key in seen:
                    cut.update((p, p + 1, p + 2))
                seen.add(key)
        want[i] = (len(x), len(cut), "\n".join(v for p, v in enumerate(x) if p not in cut))
    got = line_dedup.dedup_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in got} == want


def test_long_rule_lists_are_joined(spark, monkeypatch):
    """As a table, rules give what they give as one expression; ties go alike."""
    rng = random.Random(5)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net"], ["/", "/en/", "/en/a", "/f", ""]
    rules = tuple(url_filters.Rule(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(40))
    urls = [f"http://{rng.choice(['', 'w.'])}{rng.choice([*hosts, 'q.org', 'ya.com'])}{rng.choice([*paths, '/en/ab?x', '/g'])}" for _ in range(150)] + [None, "none", "http://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    links = spark.createDataFrame([(rng.choice(urls[:150]), rng.choice(urls[:150])) for _ in range(40)], "src string, dst string")
    judge = lambda: sorted(map(tuple, url_filters.filter_urls(pages, rules, links, html=None).collect()))
    want = judge()
    monkeypatch.setattr(url_filters, "MAX_RULES", 3)
    assert judge() == want and len({r[5] for r in want}) == 3


def test_archives_of_few_bytes(spark, monkeypatch):
    """Many packages, and ranges that hold one record or several."""
    rows = [(i, f"http://h/{i}", "x" * (i % 5 * 400) + ("same" * 300 if i % 4 == 0 else str(i))) for i in range(120)] + [(200, None, None), (201, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    read = lambda: sorted(map(str, warc_zip.round_trip(spark, pages).drop("url").collect()))
    want = read()
    for package, part in ((3_000, 200), (6_000, 1_500), (2_000, 1 << 20)):
        monkeypatch.setattr(warc_zip, "PACKAGE_BYTES", package)
        monkeypatch.setattr(warc_zip, "READ_BYTES", part)
        assert read() == want and len(want) == len(rows)
