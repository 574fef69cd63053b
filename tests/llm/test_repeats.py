import hashlib
import random

import pytest

from harrow.llm.interval_tree import drop_repeated_bytes, maximal_repeats
from harrow.llm.phrase_automata import drop_repeated_phrases

SCHEMA = "doc_id long, text string, n_words long, spans string, anchor int"


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(12)]
    passage = [r.choice(words) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a " * 300), (4, "x")]
    for i in range(5, 30):
        body = [r.choice(words) for _ in range(r.randint(0, 80))]
        if i % 2:
            s = r.randint(0, 20)
            at = r.randint(0, len(body))
            body[at:at] = passage[s : s + r.randint(20, 40)]
        rows.append((i, r.choice([" ", "\n", "  ", "\t"]).join(body)))
    rows += [rows[7], (40, rows[7][1]), (41, rows[8][1] + " tail")]
    rows += [(None, rows[9][1])]
    return rows


def brute(docs, cut, length, joiner):
    """Windows counted one by one."""
    units = [cut(t) for _, t in docs]
    seen = {}
    for u in units:
        for i in range(len(u) - length + 1):
            seen[tuple(u[i : i + length])] = seen.get(tuple(u[i : i + length]), 0) + 1
    out = []
    for (doc_id, _), u in zip(docs, units, strict=True):
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if seen[tuple(u[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(u), sum(gone), runs, hashlib.sha256(joiner([x for x, g in zip(u, gone, strict=True) if not g])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,most", [(1, 50_000), (2, 1)])
def test_phrases_match_brute_force(spark, seed, most):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA).repartition(3)
    got = [tuple(r) for r in drop_repeated_phrases(df, words=9, max_variants=most).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    want = brute(docs, lambda t: (t or "").encode().split(), 9, b" ".join)
    assert sorted(got, key=str) == [(a, b, c, e) for a, b, c, _, e in want]
    assert any(g[2] for g in got)


@pytest.mark.parametrize("seed,most", [(1, 50_000), (2, 1)])
def test_bytes_match_brute_force(spark, seed, most):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA).repartition(3)
    got = [tuple(r) for r in drop_repeated_bytes(df, size=40, max_variants=most).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(docs, lambda t: (t or "").encode(), 40, bytes)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert drop_repeated_phrases(df).count() == drop_repeated_bytes(df).count() == 0


def test_all_occurrences_of_a_repeat():
    heads, tails = [b"qab", b"zab", b"xab", b"n"], [b"cdeX", b"cdeY", b"cdeZ", b"cdq"]
    groups = [(d, sorted(m.tolist()), left.tolist()) for d, m, left in maximal_repeats(heads, tails, 4)]
    assert groups[0][:2] == (3, [0, 1, 2]) and set(groups[0][2]) == {2}
