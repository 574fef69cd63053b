"""The distributed walk, the embedding driver, verified stores, feeds and deadlines."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from harrow.operators import embedding, index, stores
from harrow.operators.embedding import Deadline, Incomplete, Refused, attempt, embedded, in_batches, next_batch
from harrow.plans.api import Workspace
from harrow.plans.progress import Event, Progress, StreamFeed, wait_for
from harrow.sources import workspace


def _embedder():
    return lambda texts: [[float(len(t)), float(t.count("a")), 1.0] for t in texts]


embed = _embedder()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name in ["a/b/c/d.py", "a/.hidden/x.py", "a/_under.py", ".harrow/own.bin", "a/.harrow/kept.py", "empty/", "big.bin", "ünïcode/数据.py"]:
        p = root / name
        if name.endswith("/"):
            p.mkdir(parents=True)
            continue
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x" * (100 if name == "big.bin" else 3))
    (root / "many").mkdir()
    for i in range(3000):
        (root / f"many/{i}.py").touch()
    (root / "linked").symlink_to(root / "a")
    (root / "link.py").symlink_to(root / "a/_under.py")
    (root / "broken.py").symlink_to(root / "nowhere")
    with open(os.path.join(os.fsencode(root), b"bad\xff.py"), "w") as f:
        f.write("bytes")
    return root


def by_walk(root):
    out = {}
    for folder, names, files in os.walk(root):
        if folder == str(root):
            names[:] = [n for n in names if n != ".harrow"]
        for f in files:
            p = os.path.join(folder, f)
            if os.path.isfile(p):
                out[os.fsencode(os.path.relpath(p, root))] = os.path.getsize(p)
    return out


def test_walk_by_levels(spark, tree, monkeypatch):
    want = by_walk(tree)
    monkeypatch.setattr(workspace, "_ROWS", 100)
    monkeypatch.setattr(os, "walk", None)  # nothing walks on the driver
    got = workspace.walk(spark, str(tree)).collect()
    assert {bytes(r.name): r.size for r in got} == want and len(got) == len(want) > 3000
    files = workspace.read_files(workspace.walk(spark, str(tree)), str(tree), 50)
    assert files.rdd.getNumPartitions() >= 5  # a folder with most files is read by several tasks
    found = {r.path: r for r in files.collect()}
    assert found["big.bin"].content is None and bytes(found["a/_under.py"].content) == b"xxx" and "bad�.py" in found and "ünïcode/数据.py" in found
    with pytest.raises(FileNotFoundError):
        workspace.walk(spark, str(tree / "nowhere"))


def test_batches_follow_the_clock():
    assert [next_batch(32, s) for s in (0.1, 1.0, 3.0)] == [64, 32, 16] and next_batch(512, 0.0) == 512 and next_batch(1, 9.0) == 1
    ticks = iter([0, 0.1, 1, 4, 5, 5.1, 6, 6.1])
    sizes = []
    out = list(in_batches(lambda t: sizes.append(len(t)) or [[1.0]] * len(t), list("abcdefghijklmnop"), 4, lambda: next(ticks)))
    assert sizes == [4, 8, 4] and [at for at, _ in out] == [0, 4, 12]


def test_retries_are_bounded_and_answers_checked():
    calls = []

    def failing(kind, times):
        def run(texts):
            calls.append(kind)
            if len(calls) <= times:
                raise kind("no")
            return [[1.0, 2.0]] * len(texts)

        return run

    assert attempt(failing(OSError, 2), ["a"]) == [[1.0, 2.0]] and len(calls) == 3
    calls.clear()
    with pytest.raises(RuntimeError, match="3 attempts"):
        attempt(failing(OSError, 9), ["a"])
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(Refused):
        attempt(failing(Refused, 9), ["a"])
    assert len(calls) == 1
    for bad in ([[1.0]], [[1.0], [1.0, 2.0]], [[float("nan")], [1.0]], [[], []]):
        with pytest.raises(Incomplete):
            embedding.checked(bad, 2)


def test_order_and_count_survive_a_failing_batch(spark, tmp_path):
    mark = str(tmp_path / "failed")

    def once_failing(texts):
        if "text 40" in texts and not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("for once")
        return [[float(t.split()[1]), 1.0] for t in texts]

    texts = spark.range(200).select(F.col("id").cast("string").alias("sha"), F.concat(F.lit("text "), F.col("id")).alias("text")).repartition(3)
    got = embedded(texts, once_failing).collect()
    assert len(got) == 200 and all(r.embedding == [float(r.sha), 1.0] for r in got) and os.path.exists(mark)
    mixed = embedded(texts.repartition(2), lambda t: [[1.0] * (1 + ("text 7" in t))] * len(t))
    with pytest.raises(Exception, match="components"):
        embedding.one_length(mixed)


@pytest.fixture
def indexed(spark, tmp_path):
    for i in range(12):
        p = tmp_path / f"src/f{i}.py"
        p.parent.mkdir(exist_ok=True)
        p.write_text(f"def banana_{i}():\n    return {'a' * i!r}\n")
    w = Workspace(spark, str(tmp_path), embedder=embed, query_seconds=5.0)
    w.index()
    return w


def test_stores_name_what_is_wrong(spark, indexed):
    w, at = indexed, f"{indexed.store}/vectors"
    with pytest.raises(stores.StoreError) as e:
        stores.open_vectors(spark, at, "default")
    assert e.value.code == stores.MISSING and w.vectors() is None
    events = []
    assert w.vectorize(events.append) == 12 and w.vectors(verify=True).count() == 12
    assert events[0] == Event("start", 0, 12) and events[-1] == Event("done", 12, 12)
    for model, dim in (("other", None), ("default", 4)):
        with pytest.raises(stores.StoreError) as e:
            stores.open_vectors(spark, at, model, dim)
        assert e.value.code == stores.MISMATCH
    facts = index.read_marker(spark, at)
    folder = facts["path"].removeprefix("file:") + "/rows"
    part = next(n for n in sorted(os.listdir(folder)) if n.startswith("part-"))
    with open(f"{folder}/{part}", "r+b") as f:
        f.seek(20)
        byte = f.read(1)
        f.seek(20)
        f.write(bytes([byte[0] ^ 1]))
    os.remove(f"{folder}/.{part}.crc")  # Hadoop's own sum would stop the read before ours
    with pytest.raises(stores.StoreError, match=f"{part} is corrupt") as e:
        w.vectors(verify=True)
    assert e.value.code == stores.CORRUPT
    os.remove(f"{folder}/{part}")
    assert [(r.part, r.problem) for r in stores.problems(spark, facts).collect()] == [(part, "missing")]
    index.write_marker(spark, at, {"path": facts["path"]})
    assert w.status()["vectors"] == stores.CORRUPT and w.search("banana_3", semantic=True).notice
    assert w.remove_vectors() and w.vectors() is None and not w.remove_vectors()


def test_guards(spark, tmp_path, indexed):
    with pytest.raises(ValueError, match="12 chunks to embed, 5 allowed"):
        indexed.vectorize(most=5)
    (tmp_path / "none").mkdir()
    empty = Workspace(spark, str(tmp_path / "none"), embedder=embed)
    empty.index()
    with pytest.raises(ValueError, match="no chunks"):
        empty.vectorize()


def test_any_failure_of_the_vector_leg_degrades(spark, indexed):
    indexed.vectorize()
    assert indexed.search("banana_3", semantic=True).notice is None
    plain = indexed.search("banana_3")
    for problem in (OSError("down"), RuntimeError("odd"), Refused("no key")):
        def broken(_, problem=problem):
            raise problem

        indexed.asker = Deadline(broken, 5.0)
        got = indexed.search("banana_3", semantic=True)
        assert got.status == "ok" and got.ranking == plain.ranking and "off" in got.notice
    folder = index.read_marker(spark, f"{indexed.store}/vectors")["path"].removeprefix("file:") + "/rows"
    for n in os.listdir(folder):
        if n.startswith("part-"):
            with open(f"{folder}/{n}", "wb") as f:
                f.write(b"not parquet")  # a failure inside Spark's tasks
    indexed.asker = Deadline(embed, 5.0)
    got = indexed.search("banana_3", semantic=True)
    assert got.status == "ok" and got.ranking == plain.ranking and "off" in got.notice


def test_a_hit_without_a_chunk_is_an_error(spark, indexed):
    found = indexed._table("chunks")
    hits = found.select("chunk_id").limit(2).withColumn("rank", F.lit(1)).unionByName(spark.createDataFrame([(-1, 2)], "chunk_id long, rank int"))
    with pytest.raises(LookupError, match="-1"):
        indexed._strict(hits, found)


def test_deadline_and_warm_up(indexed):
    gate, calls = threading.Event(), []

    def slow(texts):
        calls.append(texts)
        gate.wait(20)
        return embed(texts)

    indexed.vectorize()
    indexed.asker = Deadline(slow, 0.3)
    indexed.warm_up()
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        indexed.asker.vector("banana")
    assert time.monotonic() - began < 2 and calls == [["warm-up"]]  # no second attempt beside the first
    got = indexed.search("banana_3", semantic=True)
    assert got.status == "ok" and "0.3 s" in got.notice
    gate.set()
    assert wait_for(indexed.asker.running.done)
    assert indexed.search("banana_3", semantic=True).notice is None


def test_a_cancelled_run_ends_its_feed(spark):
    events, started = [], threading.Event()
    progress = Progress(spark, events.append, 40)

    def action(count):
        def work(frames):
            for frame in frames:
                for _ in range(len(frame)):
                    time.sleep(0.05)
                    count.add(1)
                yield frame

        started.set()
        for lo in range(0, 40, 4):
            spark.range(lo, lo + 4, 1, 2).mapInPandas(work, "id long").count()
        return 40

    thread = threading.Thread(target=lambda: progress.run(action))
    thread.start()
    assert wait_for(lambda: any(e.kind == "progress" for e in events))
    progress.cancel()
    told = len(events)
    thread.join()
    assert [e.kind for e in events[:1]] == ["start"] and events[-1].kind == "cancelled" and len(events) == told
    done = [e.done for e in events]
    assert done == sorted(done)
    again = []
    assert Progress(spark, again.append, 40).run(action) == 40
    assert again[-1] == Event("done", 40, 40) and sum(e.kind in ("done", "error", "cancelled") for e in again) == 1
    with pytest.raises(ZeroDivisionError):
        Progress(spark, again.append).run(lambda _: 1 // 0)
    assert again[-1].kind == "error" and "ZeroDivisionError" in again[-1].message


def test_a_stream_feeds_its_rows(spark, tmp_path):
    events, listener = [], None
    listener = StreamFeed({"counted": events.append})
    spark.streams.addListener(listener)
    try:
        spark.range(25).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        stream.writeStream.queryName("counted").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        assert wait_for(lambda: events and events[-1].kind == "done")
    finally:
        spark.streams.removeListener(listener)
    assert [e.kind for e in events] == ["start", "progress", "done"] and events[-1].done == 25
