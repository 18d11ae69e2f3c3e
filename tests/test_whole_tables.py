"""Registered queries over whole tables: no subset of ids stands in for the rest."""

from collections import Counter

import pytest

from veinstone import queries


@pytest.fixture
def lineitem(spark, tmp_path):
    """Line items of orders in every residue class; the same table as plain rows."""
    rows = [(k, k * 7 % 13, k * i % 29, float(k * i % 50), i) for k in range(1, 12) for i in range(1, 4)]
    kind = "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double, l_linenumber int"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path), rows


def test_degree(spark, lineitem):
    d, rows = lineitem
    calls = {(f"lib{s % 10}", f"f{k}", f"call sym.p{p % 500}") for k, s, p, *_ in rows}
    want = Counter((lib, f) for lib, f, _ in calls) + Counter((lib, c) for lib, _, c in calls)
    got = queries.q_degree(spark, d).collect()
    assert {(r["library"], r["name"]): r["degree"] for r in got} == want and len(got) == len(want)


def test_callee_expand(spark, lineitem):
    d, rows = lineitem
    score, best = {}, {}
    for k, s, _, q, _ in rows:
        score[s % 10, k] = max(score.get((s % 10, k), 0), int(q))
    for k, s, p, *_ in rows:
        lib, call = f"lib{s % 10}", f"sym.p{p % 500}"
        mine = (-score[s % 10, k], k, f"f{k}")
        best[lib, call] = min(best.get((lib, call), mine), mine)
    assert len(best) <= 200
    got = {(r["library"], r["name"]): (r["score"], r["caller"]) for r in queries.q_callee_expand(spark, d).collect()}
    assert got == {at: (6 - neg, f) for at, (neg, _, f) in best.items()}


def test_link_fallback(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(1, 60)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, f"Supplier#{k:09}") for k in range(1, 4)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    want = {(k, k, "load_library") for k in range(1, 4)} | {(k, s, "fallback") for k in range(4, 60) if k % 4 for s in range(1, 4)}
    got = [tuple(r) for r in queries.q_link_fallback(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
