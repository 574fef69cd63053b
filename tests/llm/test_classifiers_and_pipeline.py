import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from harrow.llm import rff_quality, toxicity
from harrow.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, score string, y int"
SF = "/root/testdata/sf0.001"


def labelled_corpus(n=900):
    r = random.Random(4)
    plain = [f"wort{i}" for i in range(60)] + ["grumpkin", "hats"]
    bad = ["grumpk", "blorfle", "snazzor"]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain[:60]) for _ in range(r.randint(20, 120))]
        toxic = i % 5 == 1
        for _ in range(max(2, len(words) // 25) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["grumpkard", "grumpkish", "blorfle", "snazzor"])
        if not toxic and i % 4 == 0:
            words[3] = "grumpkin"  # a harmless word with a harmful beginning
        rows.append((i, " ".join(words), "x", 0))
        labels.append((i, int(i % 3 > 0), int(toxic)))
    assert bad
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = labelled_corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, known, toxicity.learn(docs, known)


def test_folding():
    assert toxicity.fold("Іd1оt, $TUP1D! ｍｏｒｏｎ tr​ash") == ["idiot", "stupid", "moron", "trash"]
    assert toxicity.fold("") == [] and toxicity.fold("réeux\nÄ") == ["réeux", "ä"]


def test_lexicon_scores(spark, learned):
    docs, known, lexicon = learned
    stems = dict(lexicon.entries)
    assert any("blorfle".startswith(s) for s in stems) and any("grumpkard".startswith(s) for s in stems)
    got = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    right = [got[r.doc_id].predicted == r.toxic for r in known.collect() if got[r.doc_id].held_out]
    assert len(right) > 100 and np.mean(right) > 0.97
    odd = [(1, None, "", 0), (2, "", "", 0), (3, "blorfle " * 40, "", 0), (4, "BL0RFLE " * 40, "", 0), (5, "wort1 " * 200_000, "", 0), (None, "hats", "", 0), (3, "blorfle " * 40, "", 0)]
    rows = toxicity.score(spark.createDataFrame(odd, SCHEMA), lexicon).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.predicted for r in rows} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0, None: 0}
    kept = toxicity.drop_toxic(spark.createDataFrame(odd, SCHEMA), lexicon)
    assert kept.columns == ["doc_id", "text", "score", "y"] and kept.count() == 4


def test_exception_phrase():
    lexicon = toxicity.Lexicon((("trash", 5.0),), (("trashcan", 5.0), ("trash bin", 5.0)))
    a = lexicon.automaton()
    assert toxicity.weigh(["trash"], a) == 5 and toxicity.weigh(["trashcan"], a) == 0 and toxicity.weigh(["a", "trash", "bin", "trash"], a) == 5


def test_labels_of_the_held_out_fold_are_not_read(spark, learned):
    docs, known, lexicon = learned
    from pyspark.sql import functions as F

    from harrow.llm.training import held_out

    flipped = known.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, flipped) == lexicon


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "a b", "", 0)], SCHEMA)
    assert toxicity.score(some, toxicity.learn(none, labels)).first().predicted == 0
    assert rff_quality.score(some, rff_quality.learn(none, labels)).first().score == 0.5
    assert toxicity.score(none, toxicity.Lexicon(())).count() == rff_quality.score(none, None).count() == 0


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op10_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    assert got[got.quality == 1].predicted.mean() > 0.99 and got.score.between(0, 1).all()


def test_quality_of_odd_texts(spark, learned):
    docs, known, _ = learned
    model = rff_quality.learn(docs, known)
    odd = [(1, None, "", 0), (2, "", "", 0), (3, "\n \t", "", 0), (4, "x" * 300_000, "", 0), (None, "é|#", "", 0)]
    rows = rff_quality.score(spark.createDataFrame(odd, SCHEMA), model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)


def test_isotonic_rises():
    x, y = rff_quality.isotonic(np.arange(6.0), np.array([1.0, 0, 3, 2, 4, 4]), np.full(6, 4.0))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op7_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    assert got[got.toxic == 0].predicted.mean() < 0.01 and got[got.toxic == 1].predicted.mean() > 0.85


def shingles(text, n=5):
    w = tuple(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split())
    return {w[i : i + n] for i in range(len(w) - n + 1)} if len(w) >= n else {w} if w else set()


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]
    clean = stages["toxicity"](spark, docs, SF).cache()
    toxic = {r.doc_id for r in QUERIES["op7_toxicity"](spark, SF).filter("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == set(texts) - toxic
    one = stages["exact_dedup"](spark, clean, SF).cache()
    first = {}
    for d in sorted(set(texts) - toxic):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", texts[d]), d)
    assert {r.doc_id for r in one.collect()} == set(first.values())
    apart = stages["jaccard_join"](spark, one, SF).cache()
    ids = sorted(first.values())
    sets = {d: shingles(texts[d]) for d in ids}
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in apart.collect()} == {d for d in ids if find(d) == d}
    mixed = stages["mixing"](spark, apart, SF).cache()
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3 and set(copies) <= {d for d in ids if find(d) == d}
    assert all(r.text == texts[r.doc_id] for r in mixed.collect())
    for stage in (clean, one, apart, mixed):
        assert stage.columns == columns
    packed = stages["packing"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    used = defaultdict(int)
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_sql_twin(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in ORACLES.items():
        want = con.sql(sql)
        cols = sorted(want.columns)
        got = QUERIES[name](spark, SF)
        assert sorted(got.columns) == cols
        rows = sorted(tuple(r[c] for c in cols) for r in got.collect())
        assert rows == sorted(tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall())


def test_disguised_spellings_meet_their_entry():
    lexicon = toxicity.Lexicon((("idiot", 3.0), ("loser", 2.0), ("clown", 1.5), ("oaf ", 1.0), ("réeu", 5.0)), (("clown fish", 1.5),))
    found = lexicon.automaton()
    weigh = lambda text: toxicity.weigh(toxicity.fold(text), found)
    for text, weight in {"idiot": 3, "id\u00edot": 3, "idi\u0301ot": 3, "1oser": 2, "Iosers": 2, "c1own": 1.5, "сІоwn": 1.5, "clown fish": 0, "c1own f1sh": 0, "an OAF.": 1, "0af": 1, "loaf oafs": 0, "réeux": 5, "reeux": 5}.items():
        assert weigh(text) == weight, text
    assert toxicity.stems(["oaf", "x", "fool"]) == {"oaf ", "fool"}
