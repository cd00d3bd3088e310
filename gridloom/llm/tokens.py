"""Tokenizing inside tasks: a public tokenizer's ids for whole texts, words encoded once and remembered.

The tokenizers here encode each word on its own, so a text may be cut before every space that a
non-space follows, and around a line end between two words, and the ids of the parts put together. Parts repeat, so a bounded memory of parts, kept
by the Python worker from task to task, saves most calls of the library. Texts that hold a special
string go to the library whole.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np

from .common import hand_back

MEMORY = 1_000_000  # parts remembered per worker, about 200 MB
LONGEST = 48  # characters of a part that is remembered
STEP_BYTES = 1 << 21
CALL_PARTS = 128  # the library slows down on longer texts
CLOSING = (".", ",")
SPACES = re.compile(r"\s")
CUT = re.compile(r" (?=\S)")
_ENCODERS: dict = {}


def file_digest(path: str) -> str:
    """SHA-256 of a tokenizer's file: the version under which counts are stored."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def ids_of(encoding) -> bytes:
    return np.array(encoding.ids, "<u4").tobytes()


class PartEncoder:
    """Ids (as bytes, four each) or numbers of ids of texts under one tokenizer file.

    ``spaced`` says that a word keeps the space before it (byte-level vocabularies); without it the
    tokenizer drops white space.
    """

    def __init__(self, path: str, spaced: bool, count_only: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spaced = spaced
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.count_only = count_only
        self.value = len if count_only else ids_of
        self.total = sum if count_only else b"".join
        line = self.library.encode("a\nb", add_special_tokens=False).ids
        self.line_end = line[1] if spaced and len(line) == 3 else None
        self.line_value = self.value(self.library.encode("\n", add_special_tokens=False))
        self.first: dict = {}  # parts at the start of a text
        self.later: dict = {}  # parts after a space or a line end

    def _learn_heads(self, missing: set) -> None:
        names = list(missing)  # one per text at most
        found = self.library.encode_batch(names, add_special_tokens=False)
        self.first.update(zip(names, map(self.value, found)))

    def _learn_tails(self, missing: set) -> None:
        """Many parts in one call of the library.

        A part that is a known word and one closing point or comma is put together from both: a letter
        and what is no letter never share a word of the tokenizer.
        """
        names, joined = set(), []
        for part in missing:
            if part[-1:] in CLOSING and part[-2:-1].isalpha():
                joined.append(part)
                if part[:-1] not in self.later:
                    names.add(part[:-1])
            else:
                names.add(part)
        self._learn_by_lines(names) if self.line_end else self._learn_by_offsets(list(names))
        closing = {c: self.value(self.library.encode(c, add_special_tokens=False)) for c in CLOSING}
        for part in joined:
            self.later[part] = self.later[part[:-1]] + closing[part[-1]]

    def _learn_by_lines(self, names: set) -> None:
        """One part per line: a line end between words is an id of its own, which tells the parts apart."""
        plain = [p for p in names if p and not SPACES.search(p, 1 if p[0] == "\n" else 0)]
        for begin in range(0, len(plain), CALL_PARTS):
            step = plain[begin:begin + CALL_PARTS]
            lines = "\n".join([p[1:] if p[0] == "\n" else " " + p for p in step])
            ids = np.array(self.library.encode(lines, add_special_tokens=False).ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            data = ids.tobytes()
            begins = np.concatenate([[0], ends[:-1] + 1])
            if self.count_only:
                values = (ends - begins).tolist()
            else:
                values = [data[4 * a:4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
            self.later.update(zip(step, values))
            self.later.update([(p, self.line_value + self.later[p]) for p in step if p[0] == "\n"])
        rest = list(names.difference(plain))
        found = self.library.encode_batch([p if p[:1] == "\n" else " " + p for p in rest], add_special_tokens=False)
        self.later.update(zip(rest, map(self.value, found)))

    def _learn_by_offsets(self, names: list[str]) -> None:
        for begin in range(0, len(names), CALL_PARTS):
            step = names[begin:begin + CALL_PARTS]
            found = self.library.encode(" " + " ".join(step), add_special_tokens=False)
            edges = np.searchsorted(
                np.array([o[0] for o in found.offsets], np.int64), np.cumsum([0, *(len(p) + 1 for p in step)]))
            if self.count_only:
                values = np.diff(edges).tolist()
            else:
                ids = ids_of(found)
                values = [ids[a:b] for a, b in zip((4 * edges).tolist(), (4 * edges[1:]).tolist())]
            self.later.update(zip(step, values))

    def _cut(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special):
            return None
        words = text.split()
        if text.replace("\n", " ") == " ".join(words):  # one space or line end between any two words
            return text.replace("\n", " \n").split(" ") if self.spaced else words
        return CUT.split(text) if self.spaced else text.replace("\n", " ").split(" ")

    def _forget(self) -> None:
        self.first.clear()
        for part in self.long:
            self.later.pop(part, None)
        if len(self.later) > MEMORY:
            self.later.clear()

    def encode(self, texts: list[str]) -> list:
        """The value of every text, in order."""
        cut = [self._cut(t) for t in texts]
        self._learn_heads({parts[0] for parts in cut if parts})
        missing = set()
        for parts in cut:
            if parts:
                missing.update(set(parts[1:]).difference(self.later))
        self.long = [p for p in missing if len(p) > LONGEST]
        self._learn_tails(missing)
        first, later = self.first, self.later.__getitem__
        out = [
            self.total([first[parts[0]], *map(later, parts[1:])]) if parts
            else self.value(self.library.encode(text, add_special_tokens=False))
            for text, parts in zip(texts, cut)
        ]
        self._forget()
        return out

    def encode_column(self, column):
        """Values of a string Arrow column, in steps of bounded size."""
        step, size = [], 0
        for text in column:
            step.append(text.as_py())
            size += len(step[-1])
            if size >= STEP_BYTES:
                yield from self.encode(step)
                step, size = [], 0
        yield from self.encode(step)


def release() -> None:
    """Drop what this worker remembers; operators without a tokenizer call it when a task begins."""
    _ENCODERS.clear()
    hand_back()


def encoder(path: str, spaced: bool, count_only: bool = False) -> PartEncoder:
    """The worker's encoder of a tokenizer file."""
    key = (path, spaced, count_only)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PartEncoder(path, spaced, count_only)
    return _ENCODERS[key]
