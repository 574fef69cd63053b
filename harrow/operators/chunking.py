"""Files to chunks: declarations, module header and what lies between, or paragraphs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.text import LANGUAGES
from harrow.operators.lexers import Declaration, declarations

MAX_LINES = 200
HEADER_LINES = 40
PARSED = frozenset(LANGUAGES.values())

CHUNKS = "path string, seq int, start_line int, end_line int, symbol_kind string, symbol_name string, text string, lang string, low_confidence boolean"
OUTLINE = "path string, node_id int, parent_id int, depth int, kind string, name string, start_line int, end_line int"

Span = tuple[int, int, str | None, str | None, bool]


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    stem, dot, last = name.rpartition(".")
    return LANGUAGES.get(f".{last.lower()}") if dot and stem else None


def pieces(d: Declaration, most: int) -> list[tuple[int, int, str | None]]:
    """A declaration whole, or in parts that end before a statement where one is near enough."""
    if d.end - d.start < most:
        return [(d.start, d.end, d.name)]
    cuts, at = [d.start], d.start
    while d.end - at >= most:
        near = [b for b in d.breaks if at < b <= at + most]
        at = max(near, default=at + most)
        cuts.append(at)
    ends = [c - 1 for c in cuts[1:]] + [d.end]
    return [(s, e, d.name and f"{d.name}#part/{i}") for i, (s, e) in enumerate(zip(cuts, ends, strict=True), 1)]


def paragraphs(lines: list[str], most: int = MAX_LINES) -> list[tuple[int, int]]:
    """Runs of lines that are not blank, in windows of at most ``most`` lines."""
    out = []
    for blank, run in groupby(enumerate(lines, 1), key=lambda x: not x[1].strip()):
        if not blank:
            rows = [i for i, _ in run]
            out += [(s, min(s + most - 1, rows[-1])) for s in range(rows[0], rows[-1] + 1, most)]
    return out


def spans(lines: list[str], language: str | None, most: int = MAX_LINES) -> list[Span]:
    """What each line belongs to.  A line that two declarations share is the first one's."""
    if language not in PARSED:
        return [(s, e, None, None, True) for s, e in paragraphs(lines, most)]
    owner: list[object] = [None] * (len(lines) + 1)
    out: list[Span] = []
    found = sorted(declarations("\n".join(lines), language), key=lambda d: d.start)
    for d in found:
        while d.start <= d.end and owner[d.start] is not None:
            d.start += 1
        out += [(s, e, d.kind, n, False) for s, e, n in pieces(d, most)] if d.start <= d.end else []
        owner[d.start : d.end + 1] = [d] * (d.end + 1 - d.start)
    top = min(HEADER_LINES, (found[0].start if found else len(lines) + 1) - 1)
    header = max((i for i in range(1, top + 1) if lines[i - 1].strip()), default=0)
    if header:
        out.append((1, header, "module", None, False))
        owner[1 : header + 1] = ["module"] * header
    free = lambda i: owner[i] is None and bool(lines[i - 1].strip())
    for is_free, run in groupby(range(1, len(lines) + 1), key=free):
        if is_free:
            rows = list(run)
            out.append((rows[0], rows[-1], None, None, False))
    return sorted(out, key=lambda s: s[:2])


def chunk_text(path: str, text: str, most: int = MAX_LINES) -> Iterator[tuple]:
    lines, language = text.splitlines(), language_of(path)
    for seq, (s, e, kind, name, low) in enumerate(spans(lines, language, most)):
        symbol = " ".join(x for x in (kind, name) if x)
        head = "// " + "  |  ".join([f"file: {path}", *([f"symbol: {symbol}"] if symbol else []), f"lines {s}-{e}"])
        yield path, seq, s, e, kind, name, "\n".join([head, *lines[s - 1 : e]]), language, low


def chunks(files: DataFrame, most: int = MAX_LINES) -> DataFrame:
    """Chunks of files (path, text)."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        for batch in batches:
            yield pd.DataFrame([row for p, t in zip(batch["path"], batch["text"], strict=True) for row in chunk_text(p, t or "", most)], columns=names)

    return files.select("path", "text").mapInPandas(explode, CHUNKS)


def outline_text(path: str, text: str, depth: int = 2) -> list[tuple]:
    """Nested symbols as rows; a function inside a type is a method."""
    language, rows = language_of(path), []
    if language not in PARSED:
        return rows

    def add(items: list[Declaration], parent: int | None, level: int, inside: str | None) -> None:
        for d in items:
            kind = "method" if d.kind == "function" and inside in ("class", "struct", "union", "interface") else d.kind
            node = len(rows)
            rows.append((path, node, parent, level, kind, d.name, d.start, d.end))
            if level < depth:
                add(d.inner, node, level + 1, d.kind)

    add(declarations("\n".join(text.splitlines()), language, depth), None, 1, None)
    return rows


def outline(files: DataFrame, depth: int = 2) -> DataFrame:
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OUTLINE.split(", ")]
        for batch in batches:
            out = pd.DataFrame([r for p, t in zip(batch["path"], batch["text"], strict=True) for r in outline_text(p, t or "", depth)], columns=names)
            yield out.astype({"node_id": "Int32", "parent_id": "Int32", "depth": "Int32", "start_line": "Int32", "end_line": "Int32"})

    return files.select("path", "text").mapInPandas(explode, OUTLINE)


def render_outline(rows: list) -> str:
    return "\n".join(f"{'  ' * (r.depth - 1)}{r.kind} {r.name or '(anonymous)'}  {r.start_line}-{r.end_line}" for r in sorted(rows, key=lambda r: r.node_id))


def text_lines(files: DataFrame) -> DataFrame:
    """(path, line, content) of each line, numbered from 1; a last empty one is none."""
    parts = F.split(F.col("text"), "\\R|[\\x1c-\\x1e]")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select("path", F.posexplode(parts).alias("p", "content")).select("path", (F.col("p") + 1).alias("line"), "content")


def paragraph_windows(lines: DataFrame, most: int = MAX_LINES) -> DataFrame:
    """The paragraphs of lines (path, line, content), by built-in columns alone."""
    w = Window.partitionBy("path").orderBy("line")
    blank = F.trim(F.regexp_replace("content", r"\s", "")) == ""
    x = lines.withColumn("run", F.sum(F.when(blank, 1).otherwise(0)).over(w)).filter(~blank)
    inside = Window.partitionBy("path", "run").orderBy("line")
    x = x.withColumn("part", F.floor((F.row_number().over(inside) - 1) / most))
    return x.groupBy("path", "run", "part").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).select("path", "start_line", "end_line")
