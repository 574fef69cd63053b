"""Predicates on paths and on what may be indexed."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import LANGUAGES, suffix

# File names and path fragments that hold secrets, and shapes of secrets.
SECRET_NAMES = (".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa*", "id_ed25519*", ".npmrc", ".pypirc", ".netrc", ".git-credentials", "credentials*", "*_rsa", "*_ed25519")
SECRET_FRAGMENTS = ("/.ssh/", "/.aws/", "/.gnupg/", "/.kube/", "/.docker/config.json")
SECRET_SHAPES = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "openai_key": r"sk-[A-Za-z0-9]{20,}",
    "github_token": r"ghp_[A-Za-z0-9]{36}",
    "slack_token": r"xox[baprs]-[A-Za-z0-9-]+",
}
# Where tests live, as patterns that ignore ASCII case and as a regular expression that does not.
TEST_LIKE = ("tests/%", "%/tests/%", "__tests__/%", "%/__tests__/%", "%.spec.%", "%.test.%")
TEST_REGEX = r"(^|/)tests/|(^|/)__tests__/|\.spec\.|\.test\."
MAX_FILE_BYTES = 1 << 20


def test_tier(path: Column) -> Column:
    """1 for paths of tests, which rank after all others; '_' matches any character."""
    hit = F.lit(False)
    for pattern in TEST_LIKE:
        hit = hit | path.ilike(pattern)
    return F.when(hit, 1).otherwise(0)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_REGEX)


def in_scope(path: Column, scope: str | None) -> Column:
    """``path`` is ``scope`` or lies below it; pushable to the scan."""
    if not scope:
        return F.lit(True)
    scope = scope.rstrip("/")
    return (path == scope) | path.startswith(scope + "/")


def resolve_scope(scope: str | None) -> str | None:
    """A relative POSIX scope; one that leaves the workspace is an error."""
    if scope in (None, "", "."):
        return None
    parts: list[str] = []
    if scope.startswith("/"):
        raise ValueError(f"scope {scope!r} is not inside the workspace")
    for part in scope.split("/"):
        if part == "..":
            if not parts:
                raise ValueError(f"scope {scope!r} is not inside the workspace")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts) or None


def is_secret_path(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    hit = F.lit(False)
    for glob in SECRET_NAMES:
        # the pattern's own end mark is Python's; Java spells it in lower case
        hit = hit | name.rlike("^" + fnmatch.translate(glob).replace(r"\Z", r"\z"))
    for fragment in SECRET_FRAGMENTS:
        hit = hit | F.concat(F.lit("/"), path).contains(fragment)
    return hit


def secret_shape(text: Column) -> Column:
    """The name of the first secret shape in a text, or null."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(SECRET_SHAPES.items()):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def extensions(extra: tuple[str, ...] = ()) -> list[str]:
    """Indexable suffixes: the built-in ones and valid extras ('.x', 'x', any case)."""
    more = set()
    for e in extra:
        e = e.strip().lower()
        if e:
            e = e if e.startswith(".") else "." + e
            if not re.fullmatch(r"\.[a-z0-9_+-]+", e):
                raise ValueError(f"not a file extension: {e!r}")
            more.add(e)
    return sorted(set(LANGUAGES) | more)


class IgnoreRules:
    """Ignore-file rules: the last rule that matches decides; '!' takes back."""

    def __init__(self, text: str):
        self.rules: list[tuple[str, bool]] = []
        for line in text.splitlines():
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line
            line = line[1:] if line.startswith("\\") and line[1:2] in "#!" else line
            self.rules.append((self._regex(line), negated))

    @staticmethod
    def _regex(rule: str) -> str:
        only_dir = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        rule = rule.removeprefix("/")
        out, i = "", 0
        while i < len(rule):
            c = rule[i]
            if rule.startswith("**/", i) and (i == 0 or rule[i - 1] == "/"):
                out, i = out + "(?:.*/)?", i + 3
                continue
            if rule[i:] == "**" and i and rule[i - 1] == "/":
                out, i = out + ".+", i + 2
                continue
            if c == "*":
                out += "[^/]*"
                i += len(rule[i:]) - len(rule[i:].lstrip("*")) - 1
            elif c == "?":
                out += "[^/]"
            elif c == "[" and "]" in rule[i + 2 :]:
                end = rule.index("]", i + 2)
                inner = rule[i + 1 : end]
                out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
                i = end
            elif c == "\\" and i + 1 < len(rule):
                out += re.escape(rule[i + 1])
                i += 1
            else:
                out += re.escape(c)
            i += 1
        return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if only_dir else "(?:/.*)?$")

    def column(self, path: Column) -> Column:
        ignored = F.lit(False)
        for pattern, negated in self.rules:
            ignored = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(ignored)
        return ignored


def skip_reason(path: Column, size: Column, rules: IgnoreRules | None = None, max_bytes: int = MAX_FILE_BYTES, extra: tuple[str, ...] = ()) -> Column:
    """Why a file is left out ('extension' is not reported), or null; the first reason counts."""
    return (
        F.when(~suffix(path).isin(extensions(extra)), "extension")
        .when(is_secret_path(path), "secret_file")
        .when(rules.column(path) if rules else F.lit(False), "gitignored")
        .when(size > max_bytes, "too_large")
    )


def skip_counts(files: DataFrame) -> DataFrame:
    """(reason, n), the total under a null reason; files: with a column reason."""
    return files.filter("reason IS NOT NULL AND reason != 'extension'").rollup("reason").agg(F.count("*").alias("n"))
