"""Entries of long lists meet only those that they can reach the threshold with."""

import math
import random

import pytest

from harrow.llm import vertical_join
from harrow.llm.vertical_join import across, jaccard_components

SCHEMA = "mark long, x struct<node:long,n:long,place:long,label:long>"


def brute(rows, parts, whole):
    out = set()
    for m, (p, n, i, lp) in rows:
        for o, (q, k, j, lq) in rows:
            need = math.ceil((n + k) * parts / (whole + parts))
            if m == o and p < q and lp != lq and n - i >= need and k - j >= need:
                out.add((p, q, n, k))
    return out


@pytest.mark.parametrize("list_rows,parts", [(4096, 90), (20, 80), (7, 50)])
def test_across_equals_all_pairs(spark, monkeypatch, list_rows, parts):
    monkeypatch.setattr(vertical_join, "LIST_ROWS", list_rows)
    r = random.Random(parts)
    sizes = {node: (r.randint(1, 60), r.choice([0, node])) for node in range(120)}
    rows = [(m, (node, sizes[node][0], r.randint(0, sizes[node][0] // 4), sizes[node][1])) for m in range(4) for node in r.sample(range(120), 60)]
    got = {tuple(x) for x in across(spark.createDataFrame(rows, SCHEMA).repartition(3), parts, 100).collect()}
    assert got == brute(rows, parts, 100)


def test_boilerplate_forms_no_pairs(spark):
    """Equal words with one own word at each end share nearly all grams, and none can link."""
    rows = [(1, (node, 28, 2, node)) for node in range(20_000)]
    assert across(spark.createDataFrame(rows, SCHEMA), 90, 100).isEmpty()
    words = " ".join(f"w{i}" for i in range(28))
    docs = spark.createDataFrame([(i, f"a{i} {words} b{i}") for i in range(500)], "doc_id long, text string")
    assert all(r.doc_id == r.component_id for r in jaccard_components(docs).collect())


@pytest.mark.parametrize("hot_nodes", [100_000, 50])
def test_frequencies_make_no_row_for_each_gram(spark, monkeypatch, hot_nodes):
    """Near copies of one text have all its grams; their frequencies are counted without a row for each of them."""
    monkeypatch.setattr(vertical_join, "DEAL_GRAMS", 500)
    monkeypatch.setattr(vertical_join, "HOT_NODES", hot_nodes)
    r = random.Random(5)
    sets = {node: sorted({*r.sample(range(200), 190), *range(1000 * node, 1000 * node + 10)}) for node in range(1, 60)} | {60: [-1], 61: [-1, 7]}
    plans = []
    monkeypatch.setattr(vertical_join, "stage", lambda df, label: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or df)
    live = spark.createDataFrame([(node, len(s), s) for node, s in sets.items()], "node long, n long, keys array<long>").repartition(3)
    ranked, _ = vertical_join._lists(live, 80, 100)
    df = {}
    for s in sets.values():
        for g in s:
            df[g] = df.get(g, 0) + 1
    if hot_nodes < len(sets):  # all nodes are the sample
        hot = {g for g in df if df[g] >= vertical_join.HOT_SAMPLE // 50}
        assert len(hot) == 200
        df |= dict.fromkeys(hot, 2**31 - 1)
    want = {}
    for node, s in sets.items():
        grams = sorted((g for g in s if df[g] > 1), key=lambda g: (df[g], g))
        first = len(s) + (-80 * len(s)) // 100 + 1 - (len(s) - len(grams))
        if grams and first > 0:
            want[node] = (len(s), len(s) - len(grams), first, grams)
    assert {x.node: (x.n, x.private, x.first, x.grams) for x in ranked.collect()} == want
    (plan,) = [p for label, p in plans if label == "ranked"]
    assert "Generate" not in plan and "Join" not in plan


def _arrow_rows(plan):
    """Rows that the Python steps of an executed plan have made."""
    name, children = plan.nodeName(), plan.children()
    if name == "AdaptiveSparkPlan":
        return _arrow_rows(plan.executedPlan())
    if "QueryStage" in name:
        return _arrow_rows(plan.plan())
    own = plan.metrics().get("pythonNumRowsReceived").get().value() if "InArrow" in name else 0
    return own + sum(_arrow_rows(children.apply(i)) for i in range(children.size()))


def test_counting_grams_makes_no_row_for_each_node_and_deal(spark, monkeypatch):
    """Five times the nodes need five times the deals; rows that carry grams to deals and back grow no faster than the nodes."""
    monkeypatch.setattr(vertical_join, "DEAL_GRAMS", 500)
    r = random.Random(7)
    made = []

    def counted(df, label):
        if label == "ranked":
            df.collect()
            made.append(_arrow_rows(df._jdf.queryExecution().executedPlan()))
        return df

    monkeypatch.setattr(vertical_join, "stage", counted)
    for nodes in (20, 100):
        rows = [(node, 2000, sorted(r.sample(range(50 * nodes, 10_000 + 50 * nodes), 2000))) for node in range(nodes)]
        vertical_join._lists(spark.createDataFrame(rows, "node long, n long, keys array<long>").coalesce(1), 90, 100)
    assert 20 <= made[0] and made[1] <= 5 * made[0], made
