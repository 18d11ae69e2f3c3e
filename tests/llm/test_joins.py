"""The Jaccard join and the exchange at sizes that force every path, against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from tests.llm.test_brute import components, shingles, words
from veinstone.llm import deleted_interpolation, exchange, jaccard_join, queries
from veinstone.llm.graph import connected_components

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")

#: Two of these (7 and 10) share 22 of 23 elements but hang together through others only.
DRIFT = {
    7: [7, 13, 14, 17, 19, 22, 36, 47, 50, 51, 53, 58, 59, 61, 69, 70, 71, 75, 78, 80, 81, 83, 99],
    8: [7, 13, 14, 17, 19, 22, 36, 42, 47, 50, 58, 59, 61, 69, 71, 75, 78, 81, 83, 99],
    10: [7, 13, 14, 17, 19, 22, 36, 47, 50, 51, 53, 58, 59, 61, 69, 70, 71, 78, 80, 81, 83, 99],
    13: [7, 13, 14, 17, 19, 22, 36, 47, 50, 51, 58, 59, 61, 69, 70, 71, 75, 78, 81, 83, 99],
    14: [5, 6, 11, 16, 21, 22, 25, 37, 38, 39, 41, 48, 51, 53, 60, 61, 75, 76, 80, 83, 88, 89, 97],
    16: [9, 10, 11, 28, 30, 33, 42, 44, 49, 51, 60, 63, 64, 67, 69, 72, 75, 77, 78, 79, 83, 87, 88, 97, 98],
    17: [7, 13, 14, 17, 19, 22, 36, 47, 50, 58, 59, 61, 69, 71, 75, 78, 81, 83, 99],
    18: [9, 16, 28, 29, 30, 33, 42, 44, 49, 51, 63, 64, 67, 69, 72, 75, 77, 78, 79, 83, 87, 88, 97],
    20: [5, 6, 11, 16, 21, 22, 25, 37, 38, 39, 41, 48, 51, 53, 60, 61, 70, 76, 80, 83, 88, 89, 97],
    21: [28, 29, 30, 33, 34, 42, 44, 49, 51, 63, 64, 67, 72, 75, 77, 78, 79, 83, 87, 97],
    22: [5, 6, 11, 16, 21, 22, 25, 29, 37, 38, 39, 41, 48, 51, 53, 59, 60, 61, 70, 76, 80, 83, 87, 88, 89, 97],
    23: [9, 10, 11, 28, 30, 33, 42, 44, 49, 51, 60, 63, 64, 69, 72, 75, 77, 78, 79, 83, 87, 88, 97, 98, 99],
}


def family(rng, percent):
    """Sets of sizes that drift along chains, with a few elements changed at each step."""
    vocab, out = range(100), []
    for _ in range(rng.randint(1, 3)):
        s = set(rng.sample(vocab, rng.randint(12, 40)))
        for _ in range(rng.randint(2, 6)):
            out.append(frozenset(s))
            s = set(rng.choice(out[-2:]))
            for _ in range(rng.randint(0, max(1, len(s) * (100 - percent) // 100))):
                x = rng.choice(vocab)
                s = s ^ {x} if len(s) > 8 else s | {x}
    return {i: s for i, s in enumerate(dict.fromkeys(out))}


def class_ids(spark, families, percent):
    """Components of each family by class_links, all families in one table."""
    sets, lists = [], []
    for f, members in families.items():
        count = Counter(x for s in members.values() for x in s)
        for i, s in members.items():
            order = sorted(s, key=lambda x: (count[x], x))
            own = sum(count[x] == 1 for x in s)
            keys = np.sort(np.array([f * 1000 + x for x in order[own:]], "u8")).tobytes()
            name = f"{f:06}.{i:03}"
            sets.append((name, len(s), bytearray(keys)))
            for pos in range(own, jaccard_join.prefix_length(len(s), percent)):
                lists.append((f * 1000 + order[pos], name, len(s), len(s) - own, pos))
    sets = spark.createDataFrame(sets, "print string, n long, keys binary")
    lists = spark.createDataFrame(lists, "token long, print string, n long, k long, pos long")
    links = jaccard_join.class_links(sets, lists, percent)
    got = {r["node"]: r["component"] for r in connected_components(links, "x", "y").collect()}
    return {f: {i: int(got.get(name := f"{f:06}.{i:03}", name).split(".")[1]) for i in members} for f, members in families.items()}


@pytest.mark.parametrize("percent", [80, 90])
def test_random_families(spark, percent):
    rng = random.Random(percent)
    families = {0: {i: frozenset(s) for i, s in DRIFT.items()}} | {f: family(rng, percent) for f in range(1, 5_001)}
    got = class_ids(spark, families, percent)
    bad = [f for f, members in families.items() if got[f] != components(members, percent)]
    assert not bad


def test_answers_are_derived(spark, monkeypatch):
    """Bounds, differences from the hub and whole comparisons all take part, and agree with the sets."""
    rng = random.Random(4)
    sets, names = {}, []
    for f in range(40):
        base = [f * 1000 + x for x in range(60)]
        for _ in range(8):
            s = frozenset(base) - set(rng.sample(base, rng.randint(0, 10))) | {f * 1000 + 100 + rng.randrange(12) for _ in range(rng.randint(0, 8))}
            names.append((name := f"{f:03}.{len(names):05}"))
            sets[name] = s
    seen = {}
    own = jaccard_join.block_pairs
    monkeypatch.setattr(jaccard_join, "block_pairs", lambda *a: seen.setdefault("pairs", own(*a)))
    frame = spark.createDataFrame([(n, len(s), bytearray(np.sort(np.array(list(s), "u8")).tobytes())) for n, s in sets.items()], "print string, n long, keys binary")
    rows = [(x, n, len(s), len(s), i) for n, s in sets.items() for i, x in enumerate(sorted(s)) if i < jaccard_join.prefix_length(len(s), 80)]
    links = jaccard_join.class_links(frame, spark.createDataFrame(rows, "token long, print string, n long, k long, pos long"), 80)
    comp = components({i: sets[n] for i, n in enumerate(sorted(sets))}, 80)
    got = {r["node"]: r["component"] for r in connected_components(links, "x", "y").collect()}
    order = sorted(sets)
    assert [order.index(got.get(n, n)) for n in order] == [comp[i] for i in range(len(order))]
    pairs = seen["pairs"].collect()
    assert any(r["sure"] for r in pairs) or any(r["via"] for r in pairs)
    for r in pairs:
        x, y = sets[r["x"]], sets[r["y"]]
        if r["sure"]:
            assert 100 * len(x & y) >= 80 * len(x | y)
    derived = jaccard_join.derived_overlaps(seen["pairs"].where("via is not null"), frame).collect()
    assert derived and all(r["common"] == len(sets[r["x"]] & sets[r["y"]]) for r in derived)


@pytest.fixture
def tiny(monkeypatch):
    """Chunks, buckets and the fan so small that groups hold several ranges and several blocks."""
    monkeypatch.setattr(exchange, "FAN", 3)
    for module, n in ((deleted_interpolation, 4000), (jaccard_join, 3000)):
        monkeypatch.setattr(module, "CHUNK", n)
        monkeypatch.setattr(module, "CHUNK_DOCS", 9)
        monkeypatch.setattr(module, "BUCKET", 2000)


@tables
def test_join_in_many_chunks_and_ranges(spark, tiny):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, SF, "documents").collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    want = components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_jaccard_join(spark, SF).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def interpolated(texts, rounds=deleted_interpolation.ROUNDS):
    """Deleted interpolation in plain Python, on exact estimates instead of histogram cells."""
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in texts}
    seq = {i: [None, *words(t), 0] for i, t in texts.items()}  # None: start, 0: end
    uni, pair = Counter(), Counter()
    gone_uni, gone_pair = Counter(), Counter()
    for i, s in seq.items():
        if fold[i] != 2:
            uni.update(s)
            pair.update(zip(s, s[1:], strict=False))
        if fold[i] == 3:
            gone_uni.update(s)
            gone_pair.update(zip(s, s[1:], strict=False))
    n, v = sum(uni.values()) - uni[None], len(uni) - 1
    left = n - sum(gone_uni.values()) + gone_uni[None]
    bucket = lambda c: 1 + int(math.log2(c)) if c else 0
    rows = defaultdict(list)
    for (a, b), k in gone_pair.items():
        c = uni[a] - gone_uni[a]
        rows[bucket(c)].append(((pair[a, b] - k) / max(1, c), (uni[b] - gone_uni[b]) / left, 1 / (v + 1), k))

    def solve(rs, unseen=False):
        f = np.array([r[:3] for r in rs])
        w = np.array([r[3] for r in rs], float)
        lam = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = f * lam
            share /= share.sum(1, keepdims=True)
            lam = np.maximum((share * w[:, None]).sum(0) / w.sum(), 1e-6)
            lam /= lam.sum()
        return lam

    whole = solve([r for rs in rows.values() for r in rs])
    lam = {b: solve(rs) for b, rs in rows.items()}

    def weights(b):
        x = lam.get(b, whole).copy()
        if b == 0:
            x[0] = 0
        return x / x.sum()

    out = {}
    for i, s in seq.items():
        total = 0.0
        for a, b in zip(s, s[1:], strict=False):
            c = uni[a]
            x = weights(bucket(c))
            total += math.log10(x[0] * pair[a, b] / max(1, c) + x[1] * uni[b] / n + x[2] / (v + 1))
        out[i] = total
    return out


@tables
def test_interpolated_scores(spark, tiny):
    """Estimates are kept by quarter octaves for EM, which moves a score by less than a half per cent."""
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, SF, "documents").collect()}
    want = interpolated(texts)
    got = {r["doc_id"]: r for r in queries.op4_deleted_interpolation(spark, SF).collect()}
    assert set(got) == set(want)
    assert all(math.isclose(got[i]["score"], x, rel_tol=5e-3, abs_tol=1e-3) for i, x in want.items())
    assert math.isclose(sum(r["score"] for r in got.values()), sum(want.values()), rel_tol=1e-3)
    train = {i: words(t) + [None] for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(w for ws in train.values() for w in ws)
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        ws = words(texts[i]) + [None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
