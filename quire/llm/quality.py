"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pairwise sum costs time linear in the features, as half of
sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). Features are the texts' word
frequencies by hash bin, statistics of structure, and the length the table states. The machine is
fitted on a bounded sample of labelled rows (SAMPLE); all texts are scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokentable import TokenTable, slabs, sums_by_text

#: Labelled rows to fit on at most, those with the smallest hashes of doc_id.
SAMPLE = 12_000
BINS = 512
RANK = 8
EPOCHS = 30
BATCH = 256
RATE = 0.01
DECAY = 1e-4
SEED = 7
#: A score from which a document counts as of label 1.
THRESHOLD = 0.7
STATISTICS = (
    "log_chars", "log_stated_chars", "log_words", "word_length", "upper", "digits", "symbols", "non_ascii",
    "log_lines", "line_words", "repeated_lines", "distinct_words", "symbol_ends", "all_upper_words", "commas", "stops", "longest_word",
)
_KINDS = re.compile(r"[^\W\d_]+|\d+")
#: By token: bin, then characters, upper case, digits, symbols, non-ASCII, ends in a symbol, all upper, commas, ends in a stop.
_TOKEN = 10


def held_out() -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4) == 2


def token_facts(tokens: list[str]) -> np.ndarray:
    out = np.zeros((len(tokens), _TOKEN))
    for row, t in zip(out, tokens):
        plain = "".join(_KINDS.findall(t))
        upper = sum(c.isupper() for c in t)
        letters = sum(c.isalpha() for c in t)
        row[:] = (
            zlib.crc32(plain.lower().encode("utf-8", "replace")) % BINS,
            len(t),
            upper,
            sum(c.isdigit() for c in t),
            len(t) - len(plain),
            sum(c > "\x7f" for c in t),
            not t[-1].isalnum() and t[-1] not in ".,;:!?\"')",
            upper == letters and letters > 1,
            t.count(","),
            t[-1] in ".!?",
        )
    return out


class Features:
    """Rows of features for texts; holds the table of tokens seen."""

    def __init__(self):
        self.known = TokenTable(token_facts, _TOKEN)

    def rows(self, texts: list[str | None], stated: np.ndarray) -> np.ndarray:
        texts = [t or "" for t in texts]
        split = [t.split() for t in texts]
        counts = [len(s) for s in split]
        at, table = self.known.look_up([w for s in split for w in s])
        facts = table[at]
        n = len(texts)
        doc = np.repeat(np.arange(n), counts)
        bins = np.bincount(doc * BINS + facts[:, 0].astype(np.int64), minlength=n * BINS).reshape(n, BINS)
        sums = sums_by_text(facts[:, 1:], counts)
        chars, upper, digits, symbols, foreign, ends, shouts, commas, stops = sums.T
        words = np.array(counts, float)
        some_words, some_chars = np.maximum(words, 1), np.maximum(chars, 1)
        lines = [t.split("\n") for t in texts]
        n_lines = np.array([len(x) for x in lines], float)
        longest = np.zeros(n)
        np.maximum.at(longest, doc, facts[:, 1])
        statistics = np.stack(
            [
                np.log1p(chars), np.log1p(np.maximum(stated, 0)), np.log1p(words), chars / some_words, upper / some_chars, digits / some_chars,
                symbols / some_chars, foreign / some_chars, np.log1p(n_lines), words / n_lines,
                1 - np.array([len(set(x)) for x in lines]) / n_lines, np.array([len(set(x)) for x in split]) / some_words,
                ends / some_words, shouts / some_words, commas / some_words, stops / some_words, np.log1p(longest),
            ],
            axis=1,
        )
        logs = np.log1p(bins)
        logs /= np.maximum(np.sqrt((logs**2).sum(axis=1, keepdims=True)), 1e-9)
        return np.hstack([statistics, logs])


def feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of (text, n_chars, ...) in slabs with their features."""
    features = Features()
    for batch in batches:
        texts = batch["text"].tolist()
        stated = batch["n_chars"].to_numpy(float, na_value=0.0) if len(batch) else np.zeros(0)
        for a, b in slabs(texts, 2_000_000):
            for c in range(a, b, 500):
                d = min(c + 500, b)
                yield batch.iloc[c:d], features.rows(texts[c:d], np.nan_to_num(stated[c:d]))


class Machine:
    """A fitted factorisation machine. mean and scale standardise the statistics."""

    def __init__(self, mean, scale, w0, w, v):
        self.mean, self.scale, self.w0, self.w, self.v = mean, scale, w0, w, v

    def standard(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        k = len(self.mean)
        x[:, :k] = np.clip((x[:, :k] - self.mean) / self.scale, -4, 4)
        return x

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.w0 + x @ self.w + 0.5 * (((x @ self.v) ** 2) - (x**2) @ (self.v**2)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.standard(x)), -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Machine:
    """Adam on the logistic loss with weight decay; the same rows in the same order give the same machine."""
    k = len(STATISTICS)
    rate = y.mean() if len(y) else 0.5
    w0 = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    rng = np.random.default_rng(SEED)
    width = k + BINS
    mean, scale = (x[:, :k].mean(axis=0), x[:, :k].std(axis=0) + 1e-6) if len(x) else (np.zeros(k), np.ones(k))
    machine = Machine(mean, scale, w0, np.zeros(width), rng.normal(0, 0.02, (width, RANK)))
    if not len(y) or y.min() == y.max():
        machine.v[:] = 0
        return machine
    x = machine.standard(x)
    params = [np.array([w0]), machine.w, machine.v]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            b, t = x[order[i : i + BATCH]], y[order[i : i + BATCH]]
            machine.w0 = float(params[0][0])
            error = (1 / (1 + np.exp(-np.clip(machine.logits(b), -30, 30))) - t) / len(t)
            grad_v = b.T @ (error[:, None] * (b @ machine.v)) - machine.v * ((b**2).T @ error)[:, None]
            grads = [np.array([error.sum()]), b.T @ error + DECAY * machine.w, grad_v + DECAY * machine.v]
            step += 1
            for p, g, m, s in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    machine.w0 = float(params[0][0])
    return machine


def _with_length(docs: DataFrame) -> Column:
    own = F.length(F.coalesce(F.col("text"), F.lit("")))
    stated = F.coalesce(F.col("n_chars"), own) if "n_chars" in docs.columns else own
    return stated.cast("double").alias("n_chars")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine for rows of ``labels`` (doc_id, quality) that aren't held out; rows without a quality or a document take no part.

    A doc_id that is labelled more than once counts with its largest quality, one that ``docs`` repeats once, with its smallest text: no more than
    ``sample`` rows are fitted on, or leave the executors.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.struct("text", _with_length(docs)).alias("d")).join(F.broadcast(drawn), "doc_id")  # SAMPLE rows at most
    rows = rows.groupBy("doc_id", "quality").agg(F.min("d").alias("d")).select("doc_id", "quality", "d.*")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, x in feature_rows(batches):
            x = [r.tobytes() for r in x.astype(np.float32)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["quality"], "x": x})

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInPandas(extract, f"doc_id {kind}, y double, x binary").toPandas().sort_values(["doc_id", "x"], kind="stable")
    x = np.array([np.frombuffer(b, np.float32) for b in got["x"]], float).reshape(len(got), len(STATISTICS) + BINS)
    return train(x, got["y"].to_numpy(float))


def rate(docs: DataFrame, machine: Machine) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``.

    Null text counts as empty, and is scored like any other. Other columns than doc_id, text and n_chars
    are not read; if n_chars is missing or null the text's length stands in. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, x in feature_rows(batches):
            s = machine.score(x)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    # Ids travel as text: pandas has no null integers.
    rows = docs.select(F.col("doc_id").cast("string"), held_out().alias("held_out"), "text", _with_length(docs))
    out = rows.mapInPandas(score, "doc_id string, held_out boolean, score double, predicted int")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rate(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
