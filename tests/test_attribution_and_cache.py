"""Evidence of failed tasks, run reports, the embedding cache and files of any size."""

import json
import time

import pytest

from harrow.operators import index
from harrow.plans.api import Workspace, batch_eval
from harrow.sources import records

TASKS = "id string, class string, query string, expect_paths array<string>, must_not_paths array<string>, expect_symbols array<string>"


@pytest.fixture
def root(tmp_path):
    files = {"src/pool.py": "def make_pool(size):\n    return Pool(size)\n", "src/other.py": "def draw(shape):\n    return shape\n", "src/split.py": "def first_part():\n    return 1\n\n\ndef second_part():\n    return 2\n", "ignored/gone.py": "GONE = 1\n", "notes.md": "text", ".gitignore": "ignored/\n"}
    files |= {f"many/m{i}.py": f"def shared_{i}():\n    return draw(common)\n" for i in range(7)} | {"zlast.py": "def zlast():\n    pad = [" + "1, " * 40 + "]\n    return common\n"}
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path


def test_failed_tasks_are_attributed(spark, root):
    w = Workspace(spark, str(root))
    rows = [
        ("hit", "exact", "make_pool", ["src/pool.py"], [], []),
        ("forbidden", "exact", "make_pool", ["src/pool.py"], ["src/pool.py"], []),
        ("low", "exact", "common", ["zlast.py"], [], []),
        ("symbol", "exact", "make_pool", ["src/pool.py"], [], ["no_such"]),
        ("absent", "natural", "GONE", ["no/such.py"], [], []),
        ("noncode", "natural", "zzz", ["notes.md"], [], []),
        ("unindexed", "natural", "GONE", ["ignored/gone.py"], [], []),
        ("nowords", "natural", "??", ["src/pool.py"], [], []),
        ("foreign", "natural", "zebra quagga", ["src/pool.py"], [], []),
        ("partly", "natural", "shape zebra", ["src/pool.py", "src/other.py"], [], []),
        ("cut", "natural", "first_part second_part", ["src/split.py"], [], []),
    ]
    tasks = spark.createDataFrame(rows, TASKS)
    w.index()
    run = batch_eval(w._table("chunks"), w._table("postings"), w._table("lengths"), tasks, k=5).cache()
    got = {r.id: r for r in w.attribute(run, tasks).collect()}
    assert "hit" not in got
    want = {"forbidden": "A4", "low": "A4", "symbol": "A4", "absent": "A7", "noncode": "A7", "unindexed": "A2", "nowords": "A1", "foreign": "A5"}
    assert {i: got[i].code for i in want} == want
    assert got["low"].probe_rank == 8 and got["unindexed"].unindexed_paths == ["ignored/gone.py"] and got["noncode"].non_code_paths == ["notes.md"]
    assert got["foreign"].tokens_missing == ["quagga", "zebra"] and got["foreign"].tokens_present == [] and got["foreign"].indexed_paths == ["src/pool.py"]
    # results that do not find their file, of tasks whose words are partly or all in it
    lost = run.selectExpr("id", "class", "CAST(NULL AS INT) AS rank", "symbol_hit", "must_not_hit", "array('x') AS returned_paths")
    none = {r.id: r for r in w.attribute(lost, tasks.filter("id IN ('partly', 'cut')"), probe_k=1).collect()}
    assert set(none) == {"partly", "cut"}  # results without a task are passed over
    assert none["partly"].tokens_present == ["shape"] and none["partly"].tokens_missing == ["zebra"]
    assert none["cut"].tokens_missing == []
    (root / ".harrow/_READY.json").unlink()
    assert {r.code for r in w.attribute(run, tasks.filter("id IN ('foreign', 'low')")).collect()} == {"A6"}


def test_run_report(spark, tmp_path):
    path = tmp_path / "r.json"
    good = {"schema": records.REPORT_SCHEMA, "k": 5, "results": [{"id": "L-001", "class": "exact", "query": "q", "status": "ready", "hit": True, "matched_path": "a", "rank": 1, "returned_paths": ["a"], "must_not_hit": [], "symbol_hit": None, "token_estimate": 8, "error": None}, {"id": "L-002"}]}
    path.write_text(json.dumps(good))
    rows = records.load_report(spark, str(path)).collect()
    assert [(r.id, r.hit, r["rank"], r.returned_paths) for r in rows] == [("L-001", True, 1, ["a"]), ("L-002", None, None, None)]
    for bad in ([], {}, good | {"schema": "other"}, good | {"results": {}}, good | {"results": [1]}, good | {"results": [{"id": 3}]}, good | {"results": [{"id": "x", "rank": "first"}]}):
        path.write_text(json.dumps(bad))
        with pytest.raises(records.RecordError):
            records.load_report(spark, str(path))


def test_interrupted_embedding_goes_on(spark, root, monkeypatch):
    monkeypatch.setattr(index, "CACHE_TEXTS", 1)
    log = root.parent / f"{root.name}-asked"

    def embedder(stop):
        def run(texts):
            if stop and any("make_pool" in t for t in texts):
                time.sleep(6)
                raise RuntimeError("killed")
            with open(log, "a") as f:
                f.writelines("x\n" for _ in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return run

    w = Workspace(spark, str(root), embedder=embedder(True))
    chunks = w.index()["chunks"]
    with pytest.raises(Exception, match="killed"):
        w.vectorize()
    done = index.cache_records(spark, f"{w.store}/vectors/cache")
    assert 0 < done < chunks and w.status()["cached"] == done and w.vectors() is None
    log.unlink()
    w = Workspace(spark, str(root), embedder=embedder(False))
    assert w.vectorize() == chunks
    assert len(log.read_text().split()) == chunks - done
    assert w.status()["pending"] == 0 and index.load_cache(spark, f"{w.store}/vectors/cache").count() == chunks


def test_max_bytes_reaches_the_scan(spark, root):
    (root / "big.py").write_text("BIG_MARK = 1\n" + "#" * (1 << 20))
    w = Workspace(spark, str(root))
    assert w.index(max_bytes=2 << 20)["skipped"] == {"gitignored": 1} and w.search("BIG_MARK").hits
