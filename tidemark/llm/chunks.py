"""Cutting text into chunks whose tokens do not depend on their neighbours.

The pre-tokenizer pattern lets a space only start a piece, unless the space lies
inside a longer run of white space. So a text without such runs can be cut before
every space, and each chunk tokenized alone and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import regex

_RUN = re.compile(r"\s (?:\s|\Z)")


def pieces_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode defines it, as the tokenizer libraries read ``\\s``."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def chunks(text: str) -> list[str] | None:
    """Independent chunks that concatenate to the text; None if a run of white space forbids the cut."""
    if _RUN.search(text):
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def segments(text: str, size: int) -> Iterator[str]:
    """Parts of a text, cut before a space once ``size`` characters are there; one part if runs of white space forbid the cut."""
    if len(text) <= size or _RUN.search(text):
        yield text
        return
    at = 0
    while at < len(text):
        stop = text.find(" ", at + size)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop]
        at = stop


class ChunkMemo:
    """Remembers what was computed for chunks of at most ``longest`` characters, in two generations.

    When the younger generation holds ``limit`` chunks it becomes the older one, and
    the older one goes; what is used again moves to the younger.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = 150_000, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, keys: list[str]) -> list:
        found = list(map(self.young.get, keys))
        if None in found:
            if len(self.young) > self.limit:
                self.young, self.old = {}, self.young
            missing = dict.fromkeys(k for k, v in zip(keys, found) if v is None)
            fresh = {k: v for k in missing if (v := self.old.get(k)) is not None}
            new = [k for k in missing if k not in fresh]
            fresh.update(zip(new, self.compute(new)))
            found = [fresh[k] if v is None else v for k, v in zip(keys, found)]
            self.young.update((k, v) for k, v in fresh.items() if len(k) <= self.longest)
        return found


def slices(batches: Iterable, rows: int = 2500) -> Iterator:
    """Record batches cut to a number of rows, so that a task's arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
