"""The façade: index a workspace, search it, outline a file, ask for its state."""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.operators import evaluation, index, lexical, ranking, segments, stores
from harrow.operators.chunking import outline_text
from harrow.operators.embedding import Deadline, Incomplete, one_length
from harrow.operators.paths import IgnoreRules, in_scope, resolve_scope, test_tier
from harrow.operators.traces import TRANSITIONS
from harrow.plans.progress import Feed, Progress
from harrow.plans.scratch import stage
from harrow.sources.workspace import OWN_FOLDER, READ_BYTES, scan

MOST_HITS = 50
DEFAULT_BUDGET = 4000
#: Chunks that one run embeds at most; more are an error.
MOST_VECTORS = 100_000
#: Seconds that a search waits for its query's vector.
QUERY_SECONDS = 10.0


@dataclass
class Result:
    """A search's outcome; an empty one says why.  Status: ok, empty, indexing or error."""

    status: str
    query: str
    hits: list = field(default_factory=list)
    ranking: list = field(default_factory=list)
    omitted: int = 0
    code: str | None = None
    hint: str | None = None
    notice: str | None = None

    def render(self) -> str:
        head = f"[{self.status}] {self.query}" + (f"  ({self.code})" if self.code else "")
        body = []
        for h in self.hits:
            symbol = " ".join(x for x in (h.symbol_kind, h.symbol_name) if x)
            text = h.text.split("\n", 1)[1] if h.text.startswith("// file: ") and "\n" in h.text else h.text
            body.append(f"── {h.path}:{h.start_line}-{h.end_line}" + (f"  [{symbol}]" if symbol else "") + f"  (chunk {h.seq})\n{text}")
        tail = [f"{self.omitted} more hits did not fit"] * bool(self.omitted) + [self.hint] * bool(self.hint) + [self.notice] * bool(self.notice)
        return "\n\n".join([head, *body, *tail])


class Workspace:
    def __init__(self, spark: SparkSession, root: str, store: str | None = None, embedder: Callable[[list[str]], list[list[float]]] | None = None, model: str = "default", query_seconds: float = QUERY_SECONDS):
        self.spark, self.root = spark, os.path.realpath(root)
        self.store = store or os.path.join(self.root, OWN_FOLDER)
        self.embedder, self.model = embedder, model
        self.asker = Deadline(embedder, query_seconds) if embedder is not None else None
        self.progress: Progress | None = None

    def _rules(self) -> IgnoreRules:
        text = []
        for name in (".gitignore", f"{OWN_FOLDER}ignore"):
            path = os.path.join(self.root, name)
            if os.path.isfile(path):
                with open(path, encoding="utf-8", errors="replace") as f:
                    text.append(f.read())
        return IgnoreRules("\n".join(text))

    def index(self, force: bool = False, vectors: bool = False, **options) -> dict:
        facts = segments.build(self.spark, scan(self.spark, self.root, options.get("max_bytes", READ_BYTES)), self.store, self._rules(), force=force, **options)
        if vectors:
            self.vectorize()
        return facts

    def _table(self, name: str) -> DataFrame:
        """files, chunks, lengths or postings of what is indexed now."""
        return getattr(segments.SegmentIndex(self.spark, self.store), name)()

    def vectorize(self, feed: Feed | None = None, most: int = MOST_VECTORS) -> int:
        """Embed what has no vector yet; vectors of unchanged chunks are taken over.

        Texts go through a cache on disk, so an interrupted run goes on where it was.
        Nothing is written unless every chunk has a vector, all of one length; an index
        without chunks, or with over ``most``, is an error.  ``feed`` hears of the texts
        as they are embedded.
        """
        if self.embedder is None:
            raise ValueError("no embedder")
        found, target = self._table("chunks").select("chunk_id", "content_hash", "text"), f"{self.store}/vectors"
        chunks = found.count()
        if not chunks:
            raise ValueError("no chunks to embed; index the workspace first")
        if chunks > most:
            raise ValueError(f"{chunks} chunks to embed, {most} allowed")
        try:
            old = stores.open_vectors(self.spark, target, self.model)[0]
        except stores.StoreError:
            old = None
        reused, pending = index.reuse_vectors(found, old) if old is not None else (None, found)
        cache = f"{target}/cache"
        todo = pending.select(F.sha2("text", 256).alias("sha")).distinct().count()
        self.progress = Progress(self.spark, feed or (lambda _: None), todo)
        self.progress.run(lambda count: index.fill_cache(self.spark, pending, self.embedder, self.model, cache, count))
        made = index.embed(pending, self.embedder, self.model, index.load_cache(self.spark, cache))
        out = stage(made if reused is None else made.unionByName(reused), "vectors")
        dim, n = one_length(out), out.count()
        if n != chunks:
            raise Incomplete(f"{n} vectors for {chunks} chunks")
        facts = stores.write(out, f"{target}/{uuid.uuid4().hex}", {"model": self.model, "dim": dim, "rows": n, "updated_at": int(time.time())})
        index.write_marker(self.spark, target, facts)
        return n

    def vectors(self, verify: bool = False) -> DataFrame | None:
        """The stored vectors, or None if there are none of this model; ``verify`` reads every byte of them."""
        try:
            found, facts = stores.open_vectors(self.spark, f"{self.store}/vectors", self.model)
        except stores.StoreError as e:
            if verify or e.code == stores.CORRUPT:
                raise
            return None
        if verify:
            stores.verify(self.spark, facts)
        return found

    def remove_vectors(self) -> bool:
        """Forget the vectors, and the cache of embedded texts; whether there were any."""
        fs, p = index._path(self.spark, f"{self.store}/vectors")
        return fs.delete(p, True)

    def warm_up(self) -> None:
        """Let the embedder load in the background, before a first semantic search."""
        if self.asker is not None:
            self.asker.warm_up()

    def search(self, query: str, k: int = 10, max_tokens: float = DEFAULT_BUDGET, path: str | None = None, semantic: bool = False, scope_vectors: bool = True) -> Result:
        """The best ``k`` chunks within the token budget, in the order a reader meets them.

        With ``semantic``, the lexical and the vector ranking are fused; if vectors are
        not to be had the lexical result comes with a notice.
        """
        if k < 1:
            return Result("error", query, code="SEARCH_INVALID_QUERY", hint="k must be at least 1")
        k = min(k, MOST_HITS)
        try:
            scope = resolve_scope(path)
        except ValueError as e:
            return Result("error", query, code="SEARCH_INVALID_QUERY", hint=str(e))
        facts = segments.SegmentIndex(self.spark, self.store).manifest()
        if facts is None:
            return Result("indexing", query, code="INDEX_NOT_FOUND", hint="index the workspace first")
        found = self._table("chunks").select("chunk_id", "path", "seq", "start_line", "end_line", "symbol_kind", "symbol_name", "text")
        hits = segments.SegmentIndex(self.spark, self.store).search({"q": query}, k, scope)[0] if lexical.rungs(query) else None
        ranked = found.limit(0).withColumn("rank", F.lit(0)) if hits is None else self._strict(hits, found)
        lexical_rows = ranked
        notice, trim, every = None, ["path", "start_line"], None
        if semantic:
            try:
                vector = self._vector_leg(query, k, scope if scope_vectors else None, found)
                fused = ranking.fused_topk(ranking.rrf(ranked, vector), k)
                ranked, trim = fused.select(*found.columns, "rank"), ["rank"]
                every = ranked.count()
            except (ValueError, LookupError, OSError, RuntimeError, PySparkException, Py4JError) as e:
                # whatever fails in this leg, the lexical result stands
                ranked, trim = lexical_rows, ["path", "start_line"]
                notice = f"semantic ranking is off: {str(e).splitlines()[0]}"
        every = ranked.count() if every is None else every
        fit = ranking.budget_prefix(ranked, max_tokens, trim)
        rows = ranking.source_order(fit).collect()  # at most MOST_HITS rows
        if not rows:
            literal = "the query has no searchable characters" if lexical.is_punctuation_only(query) else "no chunk matches; try other words"
            return Result("empty", query, hint=literal, notice=notice)
        order = [(r.path, r.seq) for r in sorted(rows, key=lambda r: r["rank"])]
        return Result("ok", query, rows, order, every - len(rows), notice=notice)

    @staticmethod
    def _strict(hits: DataFrame, found: DataFrame) -> DataFrame:
        """The chunks of hits, ``MOST_HITS`` at most, with their ranks; a hit without a chunk is an error."""
        ranks = {r["chunk_id"]: r["rank"] for r in hits.select("chunk_id", "rank").collect()}
        rows = found.filter(F.col("chunk_id").isin(list(ranks)))
        lost = ranks.keys() - {r["chunk_id"] for r in rows.select("chunk_id").collect()}
        if lost:
            raise LookupError(f"hits without a chunk: {sorted(lost)}")
        places = found.sparkSession.createDataFrame(list(ranks.items()), "chunk_id long, rank int")
        return rows.join(F.broadcast(places), "chunk_id")

    def _vector_leg(self, query: str, k: int, scope: str | None, found: DataFrame) -> DataFrame:
        stored = self.vectors()
        if self.embedder is None or stored is None:
            raise ValueError("no vectors for this model")
        q = self.asker.vector(query)
        stores.open_vectors(self.spark, f"{self.store}/vectors", self.model, len(q))
        rows = stored.join(found.select("chunk_id", "path"), "chunk_id", "left").filter(in_scope(F.col("path"), scope))
        rows = rows.withColumn("path", F.coalesce("path", F.raise_error(F.lit("a vector has no chunk")).cast("string")))
        best = ranking.cosine_topk(rows.select("chunk_id", "embedding", "path"), q, k, test_tier(F.col("path")))
        return self._strict(best, found)

    def outline(self, path: str, depth: int = 2) -> list[tuple]:
        scope = resolve_scope(path)
        with open(os.path.join(self.root, scope or ""), encoding="utf-8", errors="replace") as f:
            return outline_text(scope or "", f.read(), depth)

    def status(self) -> dict:
        facts = segments.SegmentIndex(self.spark, self.store).manifest()
        if facts is None:
            return {"ready": False}
        out = {"ready": True, **{k: facts[k] for k in ("schema", "files", "chunks", "redacted", "skipped", "updated_at")}}
        try:
            stored = self.vectors()
        except stores.StoreError as e:
            stored, out["vectors"] = None, e.code
        if stored is not None:
            out |= index.vector_status(self._table("chunks"), stored).first().asDict()
        return out | {"cached": index.cache_records(self.spark, f"{self.store}/vectors/cache")}

    def attribute(self, results: DataFrame, tasks: DataFrame, k: int = 5, probe_k: int = evaluation.PROBE_K, extra: tuple[str, ...] = ()) -> DataFrame:
        """Why the results of a run (see ``batch_eval``) that are no hits at ``k`` failed, with the evidence."""
        on_disk = scan(self.spark, self.root, 0).select("path")
        if segments.SegmentIndex(self.spark, self.store).manifest() is None:
            files = on_disk.limit(0)
            lengths = self.spark.createDataFrame([], "chunk_id long, path string, symbol string, start_line int, dl int")
            postings = self.spark.createDataFrame([], "chunk_id long, col string, pos int, term string")
        else:
            files, postings, lengths = (self._table(n) for n in ("files", "postings", "lengths"))
        return evaluation.attribute_run(results, tasks, on_disk, files, postings, lengths, k, probe_k, extra)


class Tasks:
    """Background index runs with guarded transitions; a cancelled run's Spark jobs stop."""

    def __init__(self, workspace: Workspace):
        self.workspace, self.state, self.message, self.lock = workspace, {}, {}, threading.Lock()

    def _to(self, task: str, state: str) -> bool:
        with self.lock:
            allowed = state in TRANSITIONS[self.state[task]]
            if allowed:
                self.state[task] = state
            return allowed

    def start(self, **options) -> str:
        task = f"idx-{time.strftime('%Y%m%d')}-{uuid.uuid4().hex[:4]}"
        self.state[task] = "pending"
        spark = self.workspace.spark

        def run() -> None:
            if not self._to(task, "running"):
                return
            spark.addTag(task)
            try:
                self.message[task] = self.workspace.index(**options)
                self._to(task, "ready")
            except Exception as e:  # noqa: BLE001  the task's state carries it
                self.message[task] = str(e)
                self._to(task, "failed")

        self.thread = threading.Thread(target=run, daemon=True)
        self.thread.start()
        return task

    def cancel(self, task: str) -> bool:
        done = self._to(task, "cancelled")
        if done:
            self.workspace.spark.interruptTag(task)
        return done


def batch_eval(chunks: DataFrame, postings: DataFrame, lengths: DataFrame, tasks: DataFrame, k: int = 5, max_tokens: float = DEFAULT_BUDGET) -> DataFrame:
    """Run a task set in one plan: one result row for each task.

    Ranks are of relevance among the hits that fit the budget; returned_paths are in
    the order a reader meets them.
    """
    asked = {r["id"]: r["query"] for r in tasks.select("id", "query").collect()}  # a golden set
    hits = lexical.search(postings, lengths, asked, k).withColumnRenamed("query_id", "id")
    full = chunks.select("chunk_id", "text", "seq", "symbol_name").join(F.broadcast(hits), "chunk_id")
    fit = ranking.budget_prefix(full, max_tokens, ["path", "start_line"], ["id"])
    fit = fit.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("rank")))
    joined = fit.join(F.broadcast(tasks.select("id", "expect_paths", "expect_symbols")), "id")
    expected = F.array_contains("expect_paths", F.col("path"))
    named = F.exists("expect_symbols", lambda s: F.regexp_like("text", F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), s, F.lit(r"\E(?![A-Za-z0-9_])"))))
    per = joined.groupBy("id").agg(
        F.min(F.when(expected, F.col("rank"))).alias("rank"),
        F.min_by("path", F.when(expected, F.col("rank"))).alias("matched_path"),
        F.transform(F.array_sort(F.collect_list(F.struct("path", "start_line"))), lambda x: x["path"]).alias("returned_paths"),
        F.max(named).alias("_named"),
        F.floor(F.sum(F.length("text")) / 3.5).alias("token_estimate"),
    )
    out = tasks.join(per, "id", "left").withColumn("returned_paths", F.coalesce("returned_paths", F.array().cast("array<string>")))
    return out.select("id", "class", "query", "rank", "matched_path", "returned_paths", F.array_intersect(F.array_distinct("returned_paths"), "must_not_paths").alias("must_not_hit"), F.when(F.size("expect_symbols") > 0, F.coalesce("_named", F.lit(False))).alias("symbol_hit"), F.coalesce("token_estimate", F.lit(0)).alias("token_estimate")).withColumn("hit", F.col("rank").isNotNull() & F.coalesce("symbol_hit", F.lit(True)) & (F.size("must_not_hit") == 0))
