"""Corpus queries against brute force, exact round trips and held-out accuracy on small tables."""

import hashlib
import io
import math
import random
import zipfile
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from veinstone.llm import decision_lists, importance, jaccard_join, packing, queries, warc_zip
from veinstone.llm.blobs import pack, unpack

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in queries.table(spark, SF, "documents").collect()}


def words(text):
    return text.encode().lower().split()


def test_interpolation_counts(spark, texts):
    got = queries.op4_deleted_interpolation(spark, SF).collect()
    train = {i: words(t) + [None] for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(w for ws in train.values() for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for r in got:
        ws = words(texts[r["doc_id"]]) + [None]
        assert r["held_out"] == (r["doc_id"] not in train)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def components(sets, percent=90):
    par = {i: i for i in sets}

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                par[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text, n=3):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def test_jaccard_components(spark, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    want = components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_jaccard_join(spark, SF).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_families(spark):
    """Families of near copies around the threshold, chains, shared passages and a common template."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    docs = []
    for size in (12, 40, 90, 200):
        for _ in range(3):
            text = [rng.choice(vocab) for _ in range(size)]
            for _ in range(12):
                docs.append(list(text))
                for _ in range(rng.randint(0, max(1, size // 40))):
                    text[rng.randrange(size)] = rng.choice(vocab)
    passage = [rng.choice(vocab) for _ in range(18)]
    docs += [[*passage, *(rng.choice(vocab) for _ in range(k))] for k in (0, 1, 2, 3) for _ in range(8)]
    docs += [docs[0], docs[0], [], ["a"], ["a"], ["a", "b"]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = defaultdict(dict)
    bins = defaultdict(list)
    for r in queries.op6_best_fit_packing(spark, SF).collect():
        got[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(got) == set(texts)
    lengths = []
    for i, text in texts.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert len(got[i]) == -(-len(ids) // 2048)
        for k, r in got[i].items():
            part = ids[2048 * k : 2048 * k + 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * k, len(part), zlib.crc32(part.tobytes()))
            lengths.append(len(part))
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) == best_fit(lengths)


def best_fit(lengths, top=2048):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(top - n)
    return len(room)


def test_packing_plan():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 400))]
        runs = packing.plan_counts(Counter(lengths), 100)
        used, seen = defaultdict(list), Counter()
        for length, rank, count, each, first, offset in runs:
            assert seen[length] == rank
            seen[length] += count
            for k in range(count):
                used[first + k // each].append((offset + k % each * length, length))
        assert seen == Counter(lengths) and len(used) == best_fit(lengths, 100)
        for spans in used.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at <= 100


def test_tokens_of_odd_words():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, fast = Tokenizer.from_file(path), packing.WordTokens(path)
    odd = "It's don't. WE'LL!! a.b,c 12,3! é. É! é. ﬁx İstanbul Σίσυφος ΑΣ. 日本。 x y  z <|endoftext|> 🙂! ... ,, 1.5% naïve? Å. 'S 't. ab's! ﻿q K."
    for text in (odd, odd.upper(), odd.replace(" ", ""), " \n", ""):
        assert np.frombuffer(fast.encode(text.encode()), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_tokens_of_random_strings():
    """10,000 strings of added tokens, Unicode spaces, marks, capitals and joiners, as the tokenizer encodes them."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, fast = Tokenizer.from_file(path), packing.WordTokens(path)
    assert fast.by_chunk
    spaces = [" ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u200b", "\u3000", "\ufeff"]
    marks = ["\u0300", "\u0301", "\u0307", "\u0308", "\u030a", "\u030c", "\u0331", "\u0345", "\u200d", "\ufe0f"]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "don't", "WE'LL", "'s", "H", "T", "W", "Y", "J", "I", "\u0130", "\u03a3", "\u212a", "\ufb01", "\u65e5\u672c", "\U0001f642", "12", "3.4", ".", ",", "!", "?", "...", "word", "Haus", "\x00", *spaces, *marks]
    rng = random.Random(9)
    for _ in range(10_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert np.frombuffer(fast.encode(text.encode()), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, ascii(text)


def test_other_tokenizers_go_through_encode():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, own = Tokenizer.from_file(path), packing.WordTokens(path)
    text = " Two  words<|endoftext|>\nand more "
    assert not own.by_chunk and np.frombuffer(own.encode(text.encode()), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_statistics(spark, texts):
    rows = decision_lists.statistics(queries.table(spark, SF, "documents")).collect()
    for r in rows:
        t = texts[r["doc_id"]]
        w = [x.decode() for x in t.encode().split()]
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {k for k, n in Counter(win).items() if n > 1}
        hit = {i + k for i, x in enumerate(win) if x in twice for k in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_rules_learn_a_planted_threshold(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        f = {k: rng.random() * 10 for k in decision_lists.FEATURES}
        rows.append((int(f["symbol_rate"] > 7 and f["n_words"] <= 5), *f.values()))
    df = spark.createDataFrame(rows, "bad int, " + ", ".join(f"{k} double" for k in decision_lists.FEATURES))
    rules = decision_lists.learn(df)
    assert {t.feature for t in rules[0].tests} == {"symbol_rate", "n_words"} and rules[0].precision > 0.9
    out = df.withColumn("r", decision_lists.verdict(rules)).collect()
    assert sum((r["r"] is not None) == bool(r["bad"]) for r in out) > 0.97 * len(out)


def test_quality_keeps_good_text(spark):
    out = {r["doc_id"]: r for r in queries.op5_decision_lists(spark, "/root/testdata/sf0.01").collect()}
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels").collect()
    good = [out[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1]
    bad = [out[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.5


def test_resampling(spark, texts):
    got = {r["doc_id"]: r for r in queries.op3_importance_resampling(spark, SF).collect()}
    k = round(len(texts) * importance.FRACTION)
    order = sorted(got.values(), key=lambda r: -round(r["gumbel_key"] * 1e6))
    assert sum(r["selected"] for r in order) == k and all(r["selected"] for r in order[:k])
    labels = queries.table(spark, SF, "labels").collect()
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    counts = np.zeros((2, importance.SLOTS), np.int64)
    slots = {i: importance.slots_of(t.encode()).astype(np.int64) for i, t in texts.items()}
    for i, s in slots.items():
        np.add.at(counts[0], s, 1)
        if i in good:
            np.add.at(counts[1], s, 1)
    ratio = importance.log_ratio(counts)
    for i, s in slots.items():
        assert got[i]["n_features"] == len(s) == max(0, 2 * len(words(texts[i])) - 1)
        assert math.isclose(got[i]["log_weight"], ratio[s].sum(), rel_tol=1e-6, abs_tol=1e-6)


def test_kth_largest(spark):
    values = [random.Random(2).randint(-(1 << 62), 1 << 62) for _ in range(500)] + [5] * 40 + [-1, 0, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    order = sorted(values, reverse=True)
    for k in (1, 100, 270, len(values)):
        edge, room = importance.kth_largest(df, k)
        assert edge == order[k - 1] and room == k - sum(v > edge for v in values)


def test_language_accuracy(spark):
    d = "/root/testdata/sf0.1"
    out = {r["doc_id"]: r for r in queries.op9_language_id(spark, d).collect()}
    rows = queries.table(spark, d, "documents").select("doc_id", "lang").collect()
    held = [(r["lang"], out[r["doc_id"]]) for r in rows if out[r["doc_id"]]["held_out"]]
    assert all(o["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, o in out.items())
    assert sum(a == o["lang_pred"] for a, o in held) / len(held) > 0.98
    assert sum(o["rejected"] for _, o in held) / len(held) < 0.01


def test_package_is_a_zip64(tmp_path):
    """Python's own ZIP reader agrees with the writer, and the reader with Python's writer."""
    path = tmp_path / "x.wacz"
    with path.open("wb") as f:
        w = warc_zip.PackageWriter(f)
        for i in range(3):
            w.record(i, {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>"}, b"payload %d" % i)
        w.close()
    with zipfile.ZipFile(path) as z:
        assert z.namelist() == [warc_zip.DATA, warc_zip.INDEX] and z.testzip() is None
        data = z.read(warc_zip.DATA)
    with path.open("rb") as f:
        members = warc_zip.zip_members(f, path.stat().st_size)
        m = members[0]
        f.seek(m.data_at)
        assert f.read(m.size) == data and m.method == 0
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.comment = b"PK\x05\x06 not the end" * 3
        z.writestr("a/b.txt", b"x" * 100)
        z.writestr("deflated", b"y" * 1000, zipfile.ZIP_DEFLATED)
        with z.open("big", "w", force_zip64=True) as g:
            g.write(b"z" * 10)
    got = {m.name: m for m in warc_zip.zip_members(plain, len(plain.getvalue()))}
    assert [got[n].method for n in ("a/b.txt", "deflated", "big")] == [0, 8, 0]
    for name, want in (("a/b.txt", b"x" * 100), ("big", b"z" * 10)):
        assert plain.getvalue()[got[name].data_at : got[name].data_at + got[name].size] == want
    with pytest.raises(ValueError):
        warc_zip.zip_members(io.BytesIO(b"nothing here"), 12)


def test_digests(spark):
    pages = queries.table(spark, SF, "pages").collect()
    got = {r["page_id"]: r["payload_digest"] for r in queries.op2_warc_zip(spark, SF).collect()}
    assert got == {r["page_id"]: hashlib.sha1((r["html"] or "").encode()).hexdigest() for r in pages}


def test_blobs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        a = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert (unpack(pack(a, True), "u8", True) == a).all()
        b = rng.integers(0, 1 << 31, n).astype(np.uint32)
        assert (unpack(pack(b), "u4") == b).all()
