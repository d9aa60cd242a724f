"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm; a text's is
the product over its words. Pieces never cross words, so words are scored once and
looked up after.

The probabilities are fitted by expectation maximisation on word counts of a bounded
sample (SAMPLE rows for each language); the expected piece counts of each step are summed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import then_free, written
from .tokentable import TokenTable, slabs, sums_by_text

#: Labelled rows to fit on, for each language.
SAMPLE = 2000
#: Rounds of expectation maximisation.
ROUNDS = 4
#: Longer runs of letters are summed in logarithms, which don't vanish.
LONGEST = 40
#: So are words whose sum of products is smaller, as it is where the pieces they need are all rare.
VANISHING = 1e-280
#: Numbers of a table of sums at most: words of about one length are summed together.
TABLE = 1_000_000
#: Words whose places are listed at once.
WORDS = 4_000
#: Added to each expected count: no piece becomes impossible.
SMOOTHING = 0.05
VOCABULARY = "piece_bpe_32k.model"
#: What no language is learned for.
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")
HAS_LETTER = r"\p{L}"
START = "▁"
#: Slots of the table of a vocabulary's prefixes, as a power of two, and the odd number that spreads them.
SLOTS, SPREAD = 19, np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def held_out() -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4) == 2


class Lattice:
    """All places of vocabulary pieces in words, and sums over the paths they make.

    The pieces' prefixes are numbered, 0 the empty one. A table with open addressing leads from a prefix and the kind of the next character to the longer prefix, for whole arrays of places at once.
    """

    def __init__(self, vocabulary: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        kept = (i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.pieces = sorted({p.lower() for p in map(model.id_to_piece, kept)})
        self.unknown = len(self.pieces)  # a character that no piece has
        self.longest = max(map(len, self.pieces))
        alphabet = {c: k for k, c in enumerate(sorted({c for p in self.pieces for c in p}), 1)}
        #: Kind 0: in no piece.
        self.kinds = np.zeros(0x110000, np.uint16)
        self.kinds[[ord(c) for c in alphabet]] = list(alphabet.values())
        longer: dict[tuple[int, int], int] = {}
        ends = {}
        for i, p in enumerate(self.pieces):
            at = 0
            for c in p:
                at = longer.setdefault((at, alphabet[c]), len(longer) + 1)
            ends[at] = i
        self.piece = np.full(len(longer) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.keys, self.targets = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, np.int64)
        key, target = np.array([at << 16 | c for at, c in longer], np.int64), np.array(list(longer.values()), np.int64)
        slot = self._slots(key)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.targets[slot[free]] = key[free], target[free]
            left = self.keys[slot] != key
            key, target, slot = key[left], target[left], (slot[left] + 1) % (1 << SLOTS)

    @staticmethod
    def _slots(key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * SPREAD) >> np.uint64(64 - SLOTS)).view(np.int64)

    def _longer(self, prefix: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The prefixes longer by a character of these kinds; 0 where no piece has one."""
        key = prefix << 16 | kind
        slot = self._slots(key)
        there = self.keys[slot]
        other = np.flatnonzero((there != key) & (there >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) % (1 << SLOTS)
            there = self.keys[slot[other]]
            other = other[(there != key[other]) & (there >= 0)]
        return np.where(self.keys[slot] == key, self.targets[slot], 0)

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Word, end, length and piece of each place, sorted by end then word."""
        count, lengths = len(words), np.array([len(x) for x in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        # The words stand side by side, place after place; below them are rows of no kind.
        own = np.repeat(np.arange(count), lengths) + (np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) * count
        grid = np.zeros((lengths.max() + self.longest) * count, np.int64)
        grid[own] = self.kinds[chars]
        at = np.sort(own)
        prefix, found = np.zeros(len(at), np.int64), []
        for n in range(1, self.longest + 1):
            prefix = self._longer(prefix, grid[at + (n - 1) * count])
            piece = self.piece[prefix]
            if n == 1:
                piece[piece < 0] = self.unknown
            hit = piece >= 0
            found.append((at[hit] + n * count, np.full(np.count_nonzero(hit), n), piece[hit]))
            some = prefix > 0
            at, prefix = at[some], prefix[some]
        place, n, p = map(np.concatenate, zip(*found))
        order = np.argsort(place, kind="stable")
        e, w = np.divmod(place[order], count)
        return w, e, n[order], p[order]

    def forward(self, words: list[str], table: np.ndarray, arcs=None, logs: bool = False) -> np.ndarray:
        """alpha[word, end, language]: the probability of all segmentations up to there. table: [piece, language]. Both as logarithms, if ``logs``."""
        w, e, n, p = arcs if arcs is not None else self.arcs(words)
        times, add, none, one = (np.add, np.logaddexp, -np.inf, 0) if logs else (np.multiply, np.add, 0, 1)
        longest = max(map(len, words))
        alpha = np.full((longest + 1, len(words), table.shape[1]), none, float)
        alpha[0] = one
        bounds = np.searchsorted(e, np.arange(1, longest + 2))
        for end in range(1, longest + 1):
            a, b = bounds[end - 1], bounds[end]
            if a == b:
                continue
            value = times(alpha[end - n[a:b], w[a:b]], table[p[a:b]])
            starts = np.flatnonzero(np.concatenate(([True], w[a + 1 : b] != w[a : b - 1])))
            alpha[end, w[a:b][starts]] = add.reduceat(value, starts, axis=0)
        return alpha

    def log_totals(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """[word, language]: the logarithm of the sum over all segmentations of a word."""
        out = np.zeros((len(words), table.shape[1]))
        with np.errstate(divide="ignore"):
            log_table = np.log(table)
        for some in by_length(words, table.shape[1]):
            own = [words[i] for i in some]
            lengths = np.array([len(x) for x in own])
            logs = lengths.max() > LONGEST + 1
            alpha = self.forward(own, log_table if logs else table, logs=logs)[lengths, np.arange(len(own))]
            if not logs:
                low = np.flatnonzero((alpha < VANISHING).any(axis=1))
                with np.errstate(divide="ignore"):
                    alpha = np.log(alpha)
                for few in by_length([own[i] for i in low], table.shape[1]):
                    few = low[few]
                    alpha[few] = self.forward([own[i] for i in few], log_table, logs=True)[lengths[few], np.arange(len(few))]
            out[some] = alpha
        return out

    def expected(self, words: list[str], counts: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """Expected uses of each piece when words of one language have been seen so often."""
        total = np.zeros(self.unknown + 1)
        for some in by_length(words, 1):
            total += self._expected([words[i] for i in some], counts[some], probability)
        return total

    def _expected(self, words: list[str], counts: np.ndarray, probability: np.ndarray, logs: bool = False) -> np.ndarray:
        arcs = w, e, n, p = self.arcs(words)
        lengths = np.array([len(x) for x in words])
        logs = logs or lengths.max() > LONGEST + 1
        times, add, none, one = (np.add, np.logaddexp, -np.inf, 0) if logs else (np.multiply, np.add, 0, 1)
        with np.errstate(divide="ignore"):
            table = np.log(probability) if logs else probability
        alpha = self.forward(words, table[:, None], arcs, logs)[:, :, 0]
        total = alpha[lengths, np.arange(len(words))]
        low = np.flatnonzero(total < VANISHING)
        if not logs and len(low):
            high = np.flatnonzero(total >= VANISHING)
            found = self._expected([words[i] for i in low], counts[low], probability, logs=True)
            return found + (self._expected([words[i] for i in high], counts[high], probability) if len(high) else 0)
        beta = np.full_like(alpha, none)
        beta[lengths, np.arange(len(words))] = one
        begin = e - n
        order = np.lexsort((w, begin))[::-1]
        bw, bb, be, bp = w[order], begin[order], e[order], p[order]
        bounds = np.searchsorted(-bb, -np.arange(alpha.shape[0] + 1), side="left")
        for at in range(alpha.shape[0] - 1, -1, -1):
            a, b = bounds[at], np.searchsorted(-bb, -at, side="right")
            if a == b:
                continue
            value = times(beta[be[a:b], bw[a:b]], table[bp[a:b]])
            starts = np.flatnonzero(np.concatenate(([True], bw[a + 1 : b] != bw[a : b - 1])))
            rows = bw[a:b][starts]
            beta[at, rows] = add(beta[at, rows], add.reduceat(value, starts))
        if logs:
            share = np.exp(alpha[begin, w] + table[p] + beta[e, w] - np.where(np.isfinite(total), total, 0)[w])
        else:
            share = alpha[begin, w] * probability[p] * beta[e, w] / total[w]
        return np.bincount(p, share * counts[w], self.unknown + 1)


def by_length(words: list[str], languages: int) -> Iterator[np.ndarray]:
    """Places of words in groups of about one length, short and long ones apart; a group's table has TABLE numbers at most, or one word."""
    lengths = np.array([len(x) for x in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        stop = min(len(order), start + WORDS)
        if lengths[order[start]] <= LONGEST + 1:
            stop = min(stop, int(np.searchsorted(lengths[order], LONGEST + 1, side="right")))
        sizes = (lengths[order[start:stop]] + 1) * np.arange(1, stop - start + 1) * languages
        stop = start + max(1, int(np.searchsorted(sizes, TABLE, side="right")))
        yield order[start:stop]
        start = stop


_lattices: dict[str, Lattice] = {}


def lattice(vocabulary: str) -> Lattice:
    """One for each Python worker."""
    if vocabulary not in _lattices:
        _lattices[vocabulary] = Lattice(vocabulary)
    return _lattices[vocabulary]


def parts(token: str) -> list[str]:
    """The runs of letters of a token, each with the mark of a word's start."""
    if token.isascii() and token.isalpha():
        return [START + token]
    return [START + run for run in LETTERS.findall(token)]


class Model:
    """languages: sorted names; table: [piece, language] probabilities."""

    def __init__(self, languages: list[str], table: np.ndarray, vocabulary: str):
        self.languages, self.table, self.vocabulary = languages, table, vocabulary

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        """A row for each token: log probability by language, then the number of letters."""
        out = np.zeros((len(tokens), len(self.languages) + 1))
        found = [parts(t) for t in tokens]
        flat = [p for x in found for p in x]
        scores = np.zeros((len(flat), len(self.languages) + 1))
        if flat:
            scores[:, :-1] = lattice(self.vocabulary).log_totals(flat, self.table)
            scores[:, -1] = [len(x) - 1 for x in flat]
        out[:] = sums_by_text(scores, [len(x) for x in found]) if flat else 0
        return out

    def score(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = TokenTable(self.token_scores, len(self.languages) + 1)
        for batch in batches:
            texts = batch["text"].tolist()
            lang, score = [], []
            for a, b in slabs(texts):
                tokens = [t.lower().split() if t else [] for t in texts[a:b]]
                at, table = known.look_up([w for t in tokens for w in t])
                sums = sums_by_text(table[at], [len(t) for t in tokens])
                like = sums[:, :-1]
                best = like.argmax(axis=1)
                posterior = 1 / np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1)
                none = sums[:, -1] == 0
                lang += [UNKNOWN if x else self.languages[k] for x, k in zip(none, best)]
                score += np.where(none, 0.0, posterior).tolist()
            yield pd.DataFrame({**{c: batch[c] for c in batch.columns if c != "text"}, "lang_pred": lang, "score": score})


def fit(labelled: DataFrame, vocabulary: str | None = None, sample: int = SAMPLE) -> Model | None:
    """A model of the languages in rows (doc_id, text, lang); None if no row has a language and a letter.

    About ``sample`` rows of each language are used, those with the smallest hashes of doc_id.
    """
    vocabulary = vocabulary or default_vocabulary()
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(HAS_LETTER))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return None
    share = F.lit(None).cast("double")
    for name in languages:
        share = F.when(F.col("lang") == name, min(1.0, sample / counts[name])).otherwise(share)
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0 < share).select("lang", "text")

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {}
            for name, text in zip(batch["lang"], batch["text"]):
                for token in text.lower().split():
                    for word in parts(token):
                        rows[name, word] = rows.get((name, word), 0) + 1
            yield pd.DataFrame([(n, w, c) for (n, w), c in rows.items()], columns=["lang", "word", "n"])

    seen = drawn.mapInPandas(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    seen = written(seen, "word_counts")
    size = len(lattice(vocabulary).pieces) + 1
    table = np.full((size, len(languages)), 1.0 / size)
    for _ in range(ROUNDS):
        now = table

        def expect(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(now)
            for batch in batches:
                for name, rows in batch.groupby("lang"):
                    k = languages.index(name)
                    total[:, k] += lattice(vocabulary).expected(rows["word"].tolist(), rows["n"].to_numpy(), now[:, k])
            piece, k = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "k": k, "n": total[piece, k]})

        sums = seen.mapInPandas(expect, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        table = np.full((size, len(languages)), SMOOTHING)
        table[sums["piece"], sums["k"]] += sums["n"]
        table /= table.sum(axis=0)
    return Model(languages, table, vocabulary)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, lang_pred, score), one for each row of ``docs``.

    score is the predicted language's share of the summed probabilities. A null text or one without a
    letter is UNKNOWN with score 0, and so is every text if nothing was learned. Ties go to the
    language that sorts first. An empty table gives no rows; other columns are not read.
    """
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return _scored(docs.select("doc_id", "text"), model)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with lang_pred and score in place of text. Ids travel as text: pandas has no null integers."""
    kind = rows.schema["doc_id"].dataType
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    kept = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    out = rows.mapInPandas(model.score, f"{kept}, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def learned(docs: DataFrame) -> Model | None:
    return fit(docs.where(~held_out()).select("doc_id", "text", "lang"))


def of_known_language(docs: DataFrame, model: Model | None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text has a language: one that is not UNKNOWN, with a score of at least ``least``.

    The score is a share among the learned languages: it is low for short texts that several of them share and
    high for text of none of them, so no ``least`` tells clean text from other. Where nothing was learned, every text with a letter stays.
    """
    if model is None:
        return docs.where(F.col("text").rlike(HAS_LETTER))

    @F.pandas_udf("boolean")
    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for said in then_free(model.score(pd.DataFrame({"text": t}) for t in texts)):
            yield (said["lang_pred"] != UNKNOWN) & (said["score"] >= least)

    return docs.where(known("text"))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learned(docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return _scored(rows, model)
