import json
import time

import pytest

from harrow.plans.api import Tasks, Workspace, batch_eval
from harrow.operators import index


def _embedder():
    # a closure, so that workers get its code and need not import this module
    return lambda texts: [[float(t.count(c)) for c in "abcdefghijklmnop"] for t in texts]


embed = _embedder()


@pytest.fixture
def root(tmp_path):
    files = {
        "src/auth/token.py": "def issue_token(user):\n    return sign(user)\n",
        "src/auth/_private.py": "def hidden_helper():\n    return issue_token(None)\n",
        "src/.dotted.py": "DOTTED_MARK = 1\n",
        "tests/test_token.py": "def test_issue_token():\n    assert issue_token\n",
        "src/leak.py": 'KEY = "' + "AK" + "IA" + "B" * 16 + '"\n',
        "id_rsa": "x", "ignored/skip.py": "SKIPPED = 1\n", "big.py": "#" * (1 << 20) + "x", ".gitignore": "ignored/\n", "notes.md": "text",
    }
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path


def test_index_search_and_change(spark, root):
    w = Workspace(spark, str(root), embedder=embed)
    assert w.search("token").code == "INDEX_NOT_FOUND" and w.status() == {"ready": False}
    facts = w.index()
    assert facts["skipped"] == {"gitignored": 1, "too_large": 1} and facts["redacted"] == 1 and facts["files"] == 4
    found = w.search("issue_token")
    assert found.status == "ok" and found.ranking[0][0] == "src/auth/token.py" and found.ranking[-1][0] == "tests/test_token.py"
    assert [h.path for h in found.hits] == sorted(h.path for h in found.hits)
    assert "def issue_token" in found.render() and "// file:" not in found.render()
    assert w.search("DOTTED_MARK").hits and w.search("hidden_helper").hits
    assert w.search("AKIABBBB").status == "empty" and w.search("SKIPPED").status == "empty"
    assert w.search("!!!").hint.startswith("the query has no") and w.search("x", path="../up").code == "SEARCH_INVALID_QUERY"
    assert {h.path for h in w.search("issue_token", path="src/auth").hits} == {"src/auth/token.py", "src/auth/_private.py"}
    # a budget cuts in the order of the source, the first hit stays
    small = w.search("issue_token", max_tokens=1)
    assert len(small.hits) == 1 and small.omitted == 2
    assert w.search("issue_token", semantic=True).notice
    assert w.vectorize() == 4
    both = w.search("issue_token", semantic=True)
    assert both.notice is None and len(both.hits) == 4
    assert w.status()["pending"] == 0
    (root / "src/auth/token.py").write_text("def revoke_token(user):\n    return None\n")
    (root / "src/.dotted.py").unlink()
    assert w.index()["files"] == 3
    assert w.search("DOTTED_MARK").status == "empty" and w.search("revoke_token").hits
    assert w.status()["pending"] >= 1
    assert w.index()["chunks"] == 3


def test_outline_and_tasks(spark, root):
    w = Workspace(spark, str(root))
    assert w.outline("src/auth/token.py") == [("src/auth/token.py", 0, None, 1, "function", "issue_token", 1, 2)]
    tasks = Tasks(w)
    task = tasks.start()
    for _ in range(600):
        if tasks.state[task] not in ("pending", "running"):
            break
        time.sleep(0.2)
    assert tasks.state[task] == "ready" and not tasks.cancel(task)


def test_batch_evaluation(spark, root):
    w = Workspace(spark, str(root))
    w.index()
    tasks = spark.createDataFrame([("L-001", "exact", "issue_token", ["src/auth/token.py"], ["tests/test_token.py"], ["issue_token"]), ("L-002", "natural", "nowhere", ["x"], [], [])], "id string, class string, query string, expect_paths array<string>, must_not_paths array<string>, expect_symbols array<string>")
    got = {r.id: r for r in batch_eval(w._table("chunks"), w._table("postings"), w._table("lengths"), tasks).collect()}
    assert got["L-001"]["rank"] == 1 and got["L-001"].must_not_hit == ["tests/test_token.py"] and not got["L-001"].hit and got["L-001"].symbol_hit
    assert got["L-002"]["rank"] is None and got["L-002"].symbol_hit is None and got["L-002"].token_estimate == 0


def test_too_many_files(spark, root):
    w = Workspace(spark, str(root))
    with pytest.raises(ValueError, match="allowed"):
        w.index(max_files=1)
    assert index.read_marker(spark, w.store) is None


def test_embedding_reuses_texts_and_cache(spark):
    pending = spark.createDataFrame([(1, "h", "same"), (2, "i", "same"), (3, "j", "other")], "chunk_id long, content_hash string, text string")
    got = index.embed(pending, embed, "m").collect()
    assert len(got) == 3
    import hashlib

    cache = spark.createDataFrame([("m", hashlib.sha256(b"same").hexdigest(), [9.0])], "model string, sha string, embedding array<float>")
    assert {r.chunk_id: r.embedding[0] for r in index.embed(pending, embed, "m", cache).collect()}[2] == 9.0


def test_marker_is_json(spark, tmp_path):
    index.write_marker(spark, str(tmp_path), {"a": "é"})
    assert index.read_marker(spark, str(tmp_path)) == {"a": "é"} and json.loads((tmp_path / index.MARKER).read_text())
    index.clear_marker(spark, str(tmp_path))
    assert index.read_marker(spark, str(tmp_path)) is None
