"""Text columns: search tokens, CJK bigrams, hashes, prefixes, labels."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5


def _latin() -> tuple[str, str]:
    """Latin letters that are an ASCII letter and one mark, and that letter."""
    folded = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and int(parts[0], 16) < 128:
            folded[chr(code)] = chr(int(parts[0], 16))
    return "".join(folded), "".join(folded.values())


LATIN, ASCII = _latin()
MARKS = "[\\u0300-\\u036f]"
TOKEN = r"([\p{L}\p{N}\p{Co}]+)"
CJK = "一-鿿"


def folded(text: Column) -> Column:
    """Lower case, single Latin diacritics removed; other scripts keep theirs."""
    return F.lower(F.translate(F.regexp_replace(text, MARKS, ""), LATIN, ASCII))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and private-use characters of the folded text."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


#: Where a run of ideographs touches something else, and where a pair has another after it.
_TOUCHING = rf"(?U)(?<=[^\s\x1c-\x1f{CJK}])(?=[{CJK}])|(?<=[{CJK}])(?=[^\s\x1c-\x1f{CJK}])"
_PAIRED = f"([{CJK}])(?=([{CJK}])[{CJK}])"


def bigrams(text: Column) -> Column:
    """Every run of CJK ideographs becomes its overlapping pairs.

    A blank is put between pairs and where a run touches its surroundings; blanks that
    are there stay.
    """
    return F.when(text.rlike(f"[{CJK}]"), F.regexp_replace(F.regexp_replace(text, _TOUCHING, " "), _PAIRED, "$1$2 ")).otherwise(text)


def py_bigrams(text: str) -> str:
    """The same for a query on the driver."""
    apart = re.sub(rf"(?<=[^\s{CJK}])(?=[{CJK}])|(?<=[{CJK}])(?=[^\s{CJK}])", " ", text)
    return re.sub(_PAIRED, r"\1\2 ", apart)


def py_tokens(text: str) -> list[str]:
    """The tokens of a query on the driver."""
    text = re.sub("[̀-ͯ]", "", text).translate(str.maketrans(LATIN, ASCII)).lower()
    out, word = [], []
    for c in text:
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return [*out, "".join(word)] if word else out


def token_estimate(text: Column) -> Column:
    return F.length(text) / CHARS_PER_TOKEN


def context_prefix(path: Column, start: Column, end: Column, kind: Column, name: Column) -> Column:
    symbol = F.concat_ws(" ", kind, name)
    parts = F.array(F.concat(F.lit("file: "), path), F.when(symbol != "", F.concat(F.lit("symbol: "), symbol)), F.concat(F.lit("lines "), start.cast("string"), F.lit("-"), end.cast("string")))
    return F.concat(F.lit("// "), F.concat_ws("  |  ", parts))


def strip_prefix(text: Column) -> Column:
    """The text without its context line, if its first line is one."""
    first = F.substring_index(text, "\n", 1)
    known = first.startswith("// file: ") & first.contains("  |  ")
    return F.when(known & text.contains("\n"), F.substring(text, F.length(first) + 2, F.length(text))).otherwise(F.when(known, F.lit("")).otherwise(text))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def location_label(path: Column, start: Column, end: Column, kind: Column, name: Column, seq: Column) -> Column:
    symbol = F.concat_ws(" ", kind, name)
    where = F.concat(F.lit("── "), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.concat(where, F.when(symbol != "", F.concat(F.lit("  ["), symbol, F.lit("]"))).otherwise(F.lit("")), F.lit("  (chunk "), seq.cast("string"), F.lit(")"))


def skip_report(reasons: Column) -> Column:
    """A map of counts as 'reason=n, ...', reasons sorted."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(reasons)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")


def tool_name(name: Column) -> Column:
    """A tool's name without the prefix of the server that offers it."""
    return F.regexp_replace(name, r"^mcp__.*?__", "")


def mentions(text: Column, word: Column, ignore_case: bool = True) -> Column:
    """Does ``word`` stand in ``text`` with no identifier character beside it?"""
    quoted = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit("(?i)" if ignore_case else ""), F.lit(r"(?<![A-Za-z0-9_])"), quoted, F.lit(r"(?![A-Za-z0-9_])"))
    return F.coalesce((word != "") & F.regexp_like(text, pattern), F.lit(False))


def edge_tokens(query: Column) -> Column:
    """Distinct blank-separated tokens of a query, punctuation at their edges removed."""
    edge = f"^[^0-9A-Za-z_{CJK}]+|[^0-9A-Za-z_{CJK}]+$"
    cleaned = F.transform(F.split(bigrams(query), r"\s+"), lambda t: F.regexp_replace(t, edge, ""))
    return F.array_distinct(F.filter(cleaned, lambda t: t != ""))


# The file extensions that are parsed.
LANGUAGES = {".py": "python", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".ts": "typescript", ".js": "javascript"}


def suffix(path: Column) -> Column:
    """The last suffix of a path's name, lower case; a leading dot makes none."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(table, suffix(path))
