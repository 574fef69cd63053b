import random

import pytest
from pyspark.sql import functions as F

from harrow.operators.chunking import chunk_text, chunks, outline, outline_text, paragraph_windows, paragraphs, render_outline, spans, text_lines

PY = '"""Ledger helpers."""\nfrom decimal import Decimal\n\nRATE = Decimal("0.2")\n\n\nclass Ledger:\n    total = 0\n\n    def post(self, amount):\n        self.total += amount\n\n    async def close(self):\n        return self.total\n\n\nasync def settle(book):\n    await book.close()\n\n\n@cached\n@traced(level=2)\ndef tax(amount):\n    def half(x):\n        return x / 2\n    return half(amount) * RATE\n'
C = '/* queue of ints */\n#define CAP 16\nenum mode { FIFO, LIFO };\n\nunion cell {\n  long word;\n  char bytes[8]; // {\n};\n\nstatic const char *label(enum mode m)\n{\n  return m == FIFO ? "{" : "}";\n}\nint ready;\n'
CPP = '#pragma once\n\nnamespace store {\nclass Shelf final {\n public:\n  bool full() const { return used == 9; }\n private:\n  int used = 0;\n};\n}\n\ntemplate <class K, class V>\nstruct Entry {\n  K key;\n  V value;\n};\n\nvoid store::sweep(Shelf& s) {\n  // }\n}\n'
TS = "type Id = string;\n\ninterface Row {\n  id: Id;\n}\n\nexport default class Table {\n  rows: Row[] = [];\n  insert(row: Row): void {\n    this.rows.push({ ...row });\n  }\n}\n\nasync function load(url: string) {\n  const text = `{${url}`;\n  return text;\n}\n\nenum Mode { Read, Write }\n"


def named(path, text):
    return [(k, n, s, e) for _, _, s, e, k, n, *_ in chunk_text(path, text)]


def test_python_boundaries():
    assert named("a.py", PY) == [("module", None, 1, 4), ("class", "Ledger", 7, 14), ("function", "settle", 17, 18), ("function", "tax", 21, 26)]


def test_c_boundaries():
    assert named("a.c", C) == [("module", None, 1, 2), ("enum", "mode", 3, 3), ("union", "cell", 5, 8), ("function", "label", 10, 13), (None, None, 14, 14)]


def test_cpp_boundaries():
    assert named("a.cpp", CPP) == [("module", None, 1, 1), ("namespace", "store", 3, 10), ("struct", "Entry", 12, 16), ("function", "store::sweep", 18, 20)]


def test_ts_boundaries():
    assert named("a.ts", TS) == [("module", None, 1, 1), ("interface", "Row", 3, 5), ("class", "Table", 7, 12), ("function", "load", 14, 17), (None, None, 19, 19)]


def test_broken_python_still_has_declarations():
    assert ("function", "f", 3, 5) in named("a.py", "x = (\n\ndef f():\n    a = 1\n    return a\n")


def test_oversized_declaration_is_cut_before_statements():
    body = "".join(f"    x{i} = [\n        {i},\n    ]\n" for i in range(330))
    got = [(s, e, n) for _, _, s, e, _, n, *_ in chunk_text("big.py", "def big():\n" + body)]
    assert [n for *_, n in got] == [f"big#part/{i}" for i in range(1, len(got) + 1)] and len(got) >= 5
    assert all(e - s < 200 for s, e, _ in got) and all((e - 1) % 3 == 0 for _, e, _ in got)
    assert got[0][0] == 1 and got[-1][1] == 991 and all(a[1] + 1 == b[0] for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("name", ["a.py", "a.c", "a.cpp", "a.ts", "a.js", "a.txt"])
def test_no_line_is_lost_or_doubled(name):
    r = random.Random(name)
    parts = ["def f():", "class A:", "  x = 1", "", "int g(int a) {", "}", "  return 1;", "struct S { int a; };", "function h() {", "# c", "/* open", "*/", "'q", "@d", "\tif (x) {", "export class K {", "\x0c", "`t"]
    for _ in range(150):
        lines = [r.choice(parts) for _ in range(r.randint(0, 40))]
        text = "\n".join(lines)
        rows = text.splitlines()
        seen = [i for s, e, *_ in spans(rows, {"a.py": "python", "a.c": "c", "a.cpp": "cpp", "a.ts": "typescript", "a.js": "javascript"}.get(name)) for i in range(s, e + 1)]
        assert len(seen) == len(set(seen))
        assert {i for i, x in enumerate(rows, 1) if x.strip()} <= set(seen)


def test_spark_forms(spark):
    files = spark.createDataFrame([("a.py", PY), ("notes.txt", "a\nb\n\nc\n" + "z\n" * 250), ("empty.py", "")], "path string, text string")
    got = chunks(files)
    assert got.filter("path = 'a.py'").count() == 4 and got.filter("path = 'empty.py'").count() == 0
    low = got.filter("path = 'notes.txt'").orderBy("seq").select("start_line", "end_line", "low_confidence").collect()
    assert [tuple(r) for r in low] == [(1, 2, True), (4, 203, True), (204, 254, True)]
    windows = paragraph_windows(text_lines(files.filter("path = 'notes.txt'"))).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in windows] == [(1, 2), (4, 203), (204, 254)] == paragraphs(("a\nb\n\nc\n" + "z\n" * 250).splitlines())
    assert got.filter(F.col("text").startswith("// file: a.py  |  symbol: function settle  |  lines 17-18\nasync def settle")).count() == 1
    rows = outline(files).filter("path = 'a.py'").collect()
    assert "  method close  13-14" in render_outline(rows) and len(rows) == 6


def test_outline_depth():
    assert [r[4:6] for r in outline_text("a.cpp", CPP, 1)] == [("namespace", "store"), ("struct", "Entry"), ("function", "store::sweep")]
    assert ("class", "Shelf") in [r[4:6] for r in outline_text("a.cpp", CPP)] and ("method", "insert") in [r[4:6] for r in outline_text("a.ts", TS)]
    assert [r[2:6] for r in outline_text("a.py", PY)][-1] == (4, 2, "function", "half")
