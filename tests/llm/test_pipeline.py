"""The pipeline's stages against a brute-force version, each on its own input."""

import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_brute import best_fit, components, shingles
from veinstone.llm import language_id
from veinstone.llm.common import written
from veinstone.llm.queries import table, tokenizer_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def line_dedup(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        cut = set()
        for p in range(len(lines) - 2):
            key = tuple(x.strip(" ") for x in lines[p : p + 3])
            if "".join(key):
                if key in seen:
                    cut.update((p, p + 1, p + 2))
                seen.add(key)
        out[i] = ("\n".join(x for p, x in enumerate(lines) if p not in cut), len(cut))
    return out


def contaminated(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    wins = {tuple(w[k : k + 13]) for w in map(words, items) if w for k in range(max(1, len(w) - 12))}
    bad = set()
    for i, t in texts.items():
        w, hit = words(t), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            bad.add(i)
    return bad


def test_stages(spark):
    docs = table(spark, SF, "documents").withColumn("extra", F.lit("kept"))
    before = rows(docs)

    spoken = written(cp.identify_language(spark, docs, SF), "t")
    assert spoken.columns == docs.columns
    model = language_id.fit(docs)
    assert set(rows(spoken)) == {i for i, r in before.items() if not model.predict((r["text"] or "").encode())[2]}
    assert len(rows(spoken)) > 0.97 * len(before)

    lined = written(cp.dedup_lines(spark, spoken, SF), "t")
    assert lined.columns == docs.columns
    want = line_dedup({i: r["text"] for i, r in rows(spoken).items()})
    got = {i: r["text"] for i, r in rows(lined).items()}
    assert got == {i: t for i, (t, n) in want.items() if not n or t.strip(" ")}
    assert all(r["n_chars"] == len(r["text"]) for i, r in rows(lined).items() if want[i][1])

    single = written(cp.drop_near_duplicates(spark, lined, SF), "t")
    assert single.columns == docs.columns
    comp = components({i: shingles(t, 5) for i, t in got.items()}, 80)
    assert set(rows(single)) == {i for i, c in comp.items() if c == i}

    clean = written(cp.decontaminate(spark, single, SF), "t")
    assert clean.columns == docs.columns
    bad = contaminated({i: r["text"] for i, r in rows(single).items()}, [r["text"] for r in table(spark, SF, "benchmark").collect()])
    assert set(rows(clean)) == set(rows(single)) - bad

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    bins, lengths, crc = defaultdict(int), [], {}
    for r in cp.pack_sequences(spark, clean, SF).collect():
        bins[r["sequence_id"]] += r["length"]
        lengths.append(r["length"])
        crc[r["doc_id"], r["piece"]] = r["ids_crc32"]
    assert max(bins.values()) <= 2048 and len(bins) == best_fit(lengths)
    for i, r in rows(clean).items():
        ids = np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        assert all(crc.pop((i, k)) == zlib.crc32(ids[2048 * k : 2048 * k + 2048].tobytes()) for k in range(-(-len(ids) // 2048)))
    assert not crc


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]
    out = cp.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
