"""Token ids of whole texts by the tokenizers library, with recurring pieces of text encoded once.

Both tokenizers split a text before their merges and never merge across such a split, so a
text's ids are those of its pieces between spaces and line ends, as long as no two white space characters
meet and none is at an end. A text for which that fails is encoded as a whole.

Texts are cut and their distinct pieces found by Arrow; only distinct pieces are looked up one by one. What a worker has
encoded it remembers over its tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_LEVEL, WORD_LEVEL = "byte", "word"

#: Pieces that split into a word and punctuation whatever the tokenizer: most of those not seen before.
_SIMPLE = r"^(?P<end>\n?)(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Table:
    """Ids by name, in one array. A length of -1 marks a name without ids of its own."""

    def __init__(self, dtype):
        self.index: dict[str, int] = {}
        self.fresh: list[str] = []
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.start, self.length, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def places(self, names: list[str]) -> np.ndarray:
        """Places of different names; those not known before are in fresh and want add()."""
        self.fresh = [x for x in names if x not in self.index]
        self.index.update(zip(self.fresh, range(len(self.index), len(self.index) + len(self.fresh))))
        return np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Ids of the fresh names, one after another."""
        known, n = len(self.index) - len(self.fresh), len(self.index)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat) // 2), self.flat.dtype)])
        if n > len(self.start):
            more = np.zeros(max(n - len(self.start), len(self.start) // 2), np.int64)
            self.start, self.length, self.uses = (np.concatenate([x, more]) for x in (self.start, self.length, self.uses))
        real = np.maximum(lengths, 0)
        self.length[known:n] = lengths
        self.start[known:n] = self.used + np.cumsum(real) - real
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.fresh = []

    def gather(self, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        small = np.int32 if max(self.used, n := int(lengths.sum())) < 1 << 31 else np.int64
        offset = (start - (np.cumsum(lengths) - lengths)).astype(small)
        return self.flat[np.repeat(offset, lengths) + np.arange(n, dtype=small)]

    def most_used(self, n: int) -> _Table:
        """A table of the ``n`` names that were used most."""
        names, out = list(self.index), _Table(self.flat.dtype)
        keep = np.sort(np.argsort(-self.uses[: len(names)], kind="stable")[:n])
        out.places([names[k] for k in keep.tolist()])
        out.add(self.gather(self.start[keep], np.maximum(self.length[keep], 0)), self.length[keep])
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One for each Python worker."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def slabs(texts: pa.Array, most_bytes: int = 8_000_000) -> Iterator[pa.Array]:
    """Runs of ``texts`` of about most_bytes each; a longer text is one alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


class Encoder:
    """Encodes arrays of texts, null ones as empty. ``most`` bounds the numbers of pieces and of words remembered; the ids don't depend on it."""

    def __init__(self, path: str, kind: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind, self.most = kind, most
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.pieces, self.words = _Table(self.dtype), _Table(self.dtype)

    def keep(self, most: int) -> None:
        """Forgets all but the pieces used most: a worker that waits for its next task holds little."""
        if len(self.pieces.index) > most:
            self.pieces = self.pieces.most_used(most)
        self.words = _Table(self.dtype)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Numbers of pieces of each text, and all pieces as places in a list of distinct ones."""
        if self.kind == WORD_LEVEL:
            texts = pc.replace_substring(texts, "\n", " ")
        else:
            texts = pc.replace_substring(texts, "\n", " \n")
        pieces = pc.split_pattern(pc.if_else(pc.equal(texts, ""), None, texts), " ")
        counts = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        at, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.kind == BYTE_LEVEL and len(at):
            # The first piece of a text has no space before it: a space marks it, no other holds one.
            firsts = (np.cumsum(counts) - counts)[counts > 0]
            same: dict[int, int] = {}
            marked = [same.setdefault(i, len(distinct) + len(same)) for i in at[firsts].tolist()]
            distinct += [" " + distinct[i] for i in same]
            at = at.copy()
            at[firsts] = marked
        return counts, at, distinct

    def _source(self, piece: str) -> str | None:
        """The text that a piece stands for, None if it depends on what is next to it."""
        if self.kind == WORD_LEVEL:
            return piece
        if piece[:1] in (" ", "\n"):
            bare, source = piece[1:], piece if piece[0] == "\n" else piece[1:]
        else:
            bare, source = piece, " " + piece
        return source if bare and not bare[0].isspace() and not bare[-1].isspace() else None

    def _encode_pieces(self, sources: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of pieces that can stand side by side, in one call of the tokenizer.

        Each starts with a space or a line end, given one where it has none: a token belongs to the piece its offset lies in.
        """
        if self.kind == WORD_LEVEL:
            marked, extra = [" " + s for s in sources], np.zeros(len(sources), bool)
        else:
            extra = np.array([s[0] not in " \n" for s in sources], bool)
            marked = ["\n" + s if x else s for s, x in zip(sources, extra)]
        starts = np.cumsum([0] + [len(s) for s in marked])[:-1]
        found = self.tokenizer.encode("".join(marked), add_special_tokens=False)
        ids = np.array(found.ids, self.dtype)
        own = np.searchsorted(starts, np.array([o[0] for o in found.offsets], np.int64), side="right") - 1
        kept = np.ones(len(ids), bool)
        kept[np.searchsorted(own, np.flatnonzero(extra))] = False  # the line ends put in
        return ids[kept], np.bincount(own[kept], minlength=len(sources))

    def _word_places(self, words: list[str]) -> np.ndarray:
        """Places in self.words of words and runs of punctuation, which merges never leave."""
        places = self.words.places(words)
        ids, lengths = [], []
        for word in self.words.fresh:
            letters = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            found = self.model.tokenize(letters)
            ids += [t.id for t in found]
            lengths.append(len(found))
        self.words.add(np.array(ids, self.dtype), np.array(lengths, np.int64))
        return places

    def _learn_simple(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces are simple, and all these pieces' ids and numbers of ids."""
        parts = pc.extract_regex(pc.utf8_lower(fresh) if self.kind == WORD_LEVEL else fresh, _SIMPLE)
        simple = parts.is_valid().to_numpy(zero_copy_only=False)
        end, word, marks = (pc.struct_field(parts, [c]).filter(parts.is_valid()) for c in ("end", "word", "marks"))
        has_end = pc.not_equal(end, "").to_numpy(zero_copy_only=False)
        if self.kind == BYTE_LEVEL:
            word = pc.if_else(pc.equal(end, ""), pc.binary_join_element_wise(" ", word, ""), word)
        else:
            has_end[:] = False
        has_marks = pc.not_equal(marks, "").to_numpy(zero_copy_only=False)
        coded = pa.concat_arrays([word, marks]).dictionary_encode()
        places = self._word_places(["\n", *coded.dictionary.to_pylist()])
        at, n = places[1:][coded.indices.to_numpy()], len(word)
        # of each piece the line end, the word and the punctuation, those it has
        own = np.stack([np.full(n, places[0]), at[:n], at[n:]], axis=1)
        there = np.stack([has_end, np.ones(n, bool), has_marks], axis=1)
        lengths = np.where(there, self.words.length[own], 0)
        return simple, self.words.gather(self.words.start[own].ravel(), lengths.ravel()), lengths.sum(axis=1)

    def _learn(self) -> None:
        """Ids of the pieces not known before."""
        names = self.pieces.fresh
        if not names:
            return
        if len(self.words.index) > self.most:
            self.words = _Table(self.dtype)
        simple, flat, lengths = self._learn_simple(pa.array(names, pa.string()))
        ends = np.cumsum(lengths)
        other = np.flatnonzero(~simple).tolist()
        if not other:
            return self.pieces.add(flat, lengths)
        sources = {i: self._source(names[i]) for i in other}
        all_lengths = np.zeros(len(names), np.int64)
        all_lengths[simple] = lengths
        rows: dict[int, np.ndarray] = {}
        usable = [i for i in other if sources[i]]
        for a in range(0, len(usable), 5000):
            some = usable[a : a + 5000]
            ids, counts = self._encode_pieces([sources[i] for i in some])
            rows.update(zip(some, np.split(ids, np.cumsum(counts)[:-1])))
        # Simple pieces' ids stay in order, the others are put between them.
        before = np.concatenate(([0], ends))[np.cumsum(simple)]
        parts, used = [], 0
        for i in other:
            own = rows.get(i, flat[:0])
            parts += [flat[used : before[i]], own]
            used, all_lengths[i] = before[i], -1 if sources[i] is None else len(own)
        self.pieces.add(np.concatenate([*parts, flat[used:]]), all_lengths)

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of each text's ids."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if len(self.pieces.index) > self.most:
            self.pieces = self.pieces.most_used(self.most // 2)
        counts, at, distinct = self._cut(texts)
        own = self.pieces.places(distinct)
        self._learn()
        self.pieces.uses[own] += np.bincount(at, minlength=len(own))
        length, start = self.pieces.length[own], self.pieces.start[own]
        lengths = length[at]
        bounds = np.concatenate(([0], np.cumsum(counts)))
        if (length < 0).any():
            return self._with_whole_texts(texts, start, length, at, bounds)
        return self.pieces.gather(start[at], lengths), _sums(lengths, bounds)

    def _with_whole_texts(self, texts, start, length, at, bounds) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts of which some have a piece that can't stand alone: these are encoded as a whole."""
        lengths = length[at]
        alone = _sums((lengths < 0).astype(np.int64), bounds) == 0
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        kept = alone[doc]
        flat, counts = self.pieces.gather(start[at[kept]], lengths[kept]), _sums(np.where(kept, lengths, 0), bounds)
        begin = np.cumsum(counts) - counts
        parts, used = [], 0
        for i in np.flatnonzero(~alone).tolist():
            ids = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
            parts += [flat[used : begin[i]], np.array(ids, self.dtype)]
            used, counts[i] = begin[i], len(ids)
        return np.concatenate([*parts, flat[used:]]), counts


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the runs of values between bounds."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[bounds])
