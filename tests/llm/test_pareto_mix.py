import random
from collections import defaultdict

import pytest

from harrow.llm.pareto_mix import mix, mix_report, plan_mix

SCHEMA = "doc_id long, text string, source string, size string, target int, u double"


def rows(n, sources):
    return [(i, None if i % 17 == 3 else " ".join(["wort\x0b"] * (i * 7919 % 50)), sources[i * 31 % len(sources)], "x", 1, 0.0) for i in range(n)]


def level_targets(sizes):
    """Shares by weight, raised round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: float(k % 3 + 1) for k, s in enumerate(names)}
    cap, total, fixed = {s: 3.0 * sizes[s] for s in names}, float(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return cap
        rest = total - sum(cap[s] for s in fixed)
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > cap[s]}
        if not over:
            return share | {s: cap[s] for s in fixed}
        fixed |= over


@pytest.mark.parametrize("sources", [["a"], ["a", "b", "ü", "Z", None], ["hot"] * 9 + ["x", "y", "", None], [f"s{i}" for i in range(40)]])
def test_targets_and_takes(spark, sources):
    docs = rows(800, sources)
    got = mix_report(spark.createDataFrame(docs, SCHEMA)).collect()
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, text, source, *_ in docs:
        n = len((text or "").encode().split())
        sizes[source] += n
        longest[source] = max(longest[source], n)
    want, taken = level_targets(sizes), defaultdict(int)
    by_id = {d[0]: d for d in docs}
    assert len(got) == len(docs)
    for r in got:
        source = by_id[r.doc_id][2]
        assert r["size"] == len((by_id[r.doc_id][1] or "").encode().split()) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6
    again = mix_report(spark.createDataFrame(docs, SCHEMA).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    copies = defaultdict(int)
    for r in mix(spark.createDataFrame(docs, SCHEMA)).collect():
        assert tuple(r) == by_id[r.doc_id]
        copies[r.doc_id] += 1
    assert all(r["size"] == 0 or copies[r.doc_id] == r.taken // r["size"] for r in got)


def test_repeats_nulls_and_nothing(spark):
    assert mix_report(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [(1, "a b", None, "", 0, 0.0), (1, "a b", None, "", 0, 0.0), (None, "a", "s", "", 0, 0.0), (2, None, None, "", 0, 0.0)]
    assert mix_report(spark.createDataFrame(odd, SCHEMA)).count() == 4
    empty = [(1, None, "a", "", 0, 0.0), (2, " ", "b", "", 0, 0.0)]
    assert {r.taken for r in mix_report(spark.createDataFrame(empty, SCHEMA)).collect()} == {0}


def test_ranks_decide_with_unequal_chances(spark):
    """Longer documents are likelier, by the rank's odds; the sample is the lowest ranks."""
    r = random.Random(4)
    docs = [(i, " ".join(["w"] * r.choice([1, 5, 20, 400 if i < 3 else 60])), "s" if i % 3 else "t", "", 0, 0.0) for i in range(3000)]
    rows, plan = plan_mix(spark.createDataFrame(docs, SCHEMA))
    plan = {p.source: p for p in plan.collect()}
    rows = rows.collect()
    taken = {x.doc_id: x.taken for x in mix_report(spark.createDataFrame(docs, SCHEMA)).collect()}
    plain = 0
    for source, p in plan.items():
        own = [x for x in rows if x.source == source]
        extra = {x.doc_id: taken[x.doc_id] // x["size"] - p.certain for x in own}
        assert set(extra.values()) <= {0, 1} and p.rest > 0
        chance = {x.doc_id: min(1.0, p.rate * x["size"]) for x in own}
        assert sum(chance[x.doc_id] * x["size"] for x in own) == pytest.approx(p.rest)
        sure = [x for x in own if x["size"] > p.longest]
        assert all(extra[x.doc_id] == 1 for x in sure)
        odds = lambda q: q / (1 - q) if q < 1 else float("inf")
        ranks = sorted((odds(x.u) / odds(chance[x.doc_id]), x.doc_id) for x in own if x["size"] <= p.longest)
        chosen = [extra[i] for _, i in ranks]
        assert chosen == sorted(chosen, reverse=True)
        by_u = [extra[i] for _, i in sorted((x.u, x.doc_id) for x in own if x["size"] <= p.longest)]
        plain += by_u != sorted(by_u, reverse=True)
        shares = {n: [extra[x.doc_id] for x in own if x["size"] == n] for n in (5, 60)}
        assert sum(shares[60]) / len(shares[60]) > 2 * sum(shares[5]) / len(shares[5])
    assert plain == len(plan)
