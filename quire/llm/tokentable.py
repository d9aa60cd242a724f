"""A bounded table of vectors for recurring tokens, for use inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np


class _Index(dict):
    """Numbers tokens in order of first sight; ``fresh`` has those not yet computed."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, token: str) -> int:
        self.fresh.append(token)
        n = self[token] = len(self)
        return n


class TokenTable:
    """Vectors of tokens, each computed once while there is room.

    ``compute`` gives the rows for a list of tokens. Beyond ``most`` tokens the table starts
    anew, so memory stays bounded whatever the corpus; results don't depend on it.
    """

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, most: int = 300_000):
        self.compute, self.width, self.most = compute, width, most
        self._clear()

    def _clear(self) -> None:
        self.index, self.table = _Index(), np.zeros((1024, self.width))

    def look_up(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the tokens, and the table they point into."""
        if len(self.index) > self.most:
            self._clear()
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        if self.index.fresh:
            if len(self.index) > len(self.table):
                grown = np.zeros((max(2 * len(self.table), len(self.index)), self.width))
                grown[:known] = self.table[:known]
                self.table = grown
            self.table[known : len(self.index)] = self.compute(self.index.fresh)
            self.index.fresh = []
        return at, self.table


def slabs(texts: list[str | None], most_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about most_chars characters each; a longer text is one alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > most_chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def sums_by_text(values: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sums of consecutive rows, counts[i] of them for the i-th text."""
    out = np.zeros((len(counts), values.shape[1]))
    counts = np.asarray(counts)
    some = counts > 0
    if some.any():
        starts = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
        out[some] = np.add.reduceat(values, starts, axis=0)
    return out
