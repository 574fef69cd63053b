"""Token ids of whole texts, by a public byte-level tokenizer."""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept with their ids in a worker; beyond it the memory starts afresh.
KEPT_WORDS = 500_000
#: Letters up to here have the same classes in every version of Unicode.
_SETTLED = "\u024f"


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves; the others, in order, for the
    code points from 256 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class _Words(dict):
    """ids, as bytes, of words after a blank (or, with ``blank`` empty, without one).

    The value of a word that cannot be encoded on its own is None.
    """

    def __init__(self, owner: Encoder, blank: str):
        self.owner, self.blank = owner, blank

    def __missing__(self, word: str) -> bytes | None:
        core = word.rstrip(".,")
        if core.isalpha() and (core.isascii() or max(core) <= _SETTLED):
            # letters, and what follows them, are parts of their own
            value = self.owner.ids(self.blank + core) if core == word else self[core] + self.owner.part(word[len(core) :])
        elif not word or word[0].isspace() or word[-1].isspace():
            value = None
        else:
            value = self.owner.word(self.blank + word)
        self[word] = value
        return value


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    Byte-level BPE never merges across the boundary before a single blank that
    stands between two characters that are not white space.  A text all of whose
    blanks are such is encoded word by word, each distinct word once; any other
    text goes to the tokenizer in one piece, and so does one that spells a token added
    to the vocabulary, which the tokenizer takes for that token.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # the words kept here are never asked for again
        self.tokenize = model.tokenize
        self.letters = byte_letters()
        self.parts = regex.compile(public_tokenizers.PATTERN).findall
        self.kept: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.first, self.later, self.kept = _Words(self, ""), _Words(self, " "), {}

    def ids(self, part: str) -> bytes:
        tokens = self.tokenize(part.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in tokens]).tobytes()

    def part(self, part: str) -> bytes:
        found = self.kept.get(part)
        if found is None:
            found = self.kept[part] = self.ids(part)
        return found

    def word(self, word: str) -> bytes:
        if max(word) > _SETTLED:
            return self.whole(word)
        return b"".join(map(self.part, self.parts(word)))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def encode(self, text: str) -> bytes:
        if len(self.later) + len(self.kept) > KEPT_WORDS:
            self.forget()
        if any(token in text for token in self.added):
            return self.whole(text)
        words = text.split(" ")
        first = self.first[words[0]]
        if first is not None:
            try:
                return first + b"".join(map(self.later.__getitem__, words[1:]))
            except TypeError:  # blanks that stand beside white space
                pass
        return self.whole(text)


@functools.cache
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, column: str = "text", limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with the ids of their texts; null texts are empty."""
    enc = encoder(path)
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        reach = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
        lo = 0
        while lo < len(texts):
            used = reach[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(reach, used + limit, side="right")))
            yield batch.slice(lo, hi - lo), [enc.encode(t.as_py()) for t in texts.slice(lo, hi - lo)]
            lo = hi
