"""Toxicity of whole texts from subword embeddings and a linear softmax.

A word is the average of the embeddings of its character n-grams and of itself; a text is the
average of its distinct words, weighted towards those that speak for the label, so that a
short insult in a long text is not averaged away. Embeddings and softmax are trained together, in numpy, on
a bounded sample of labelled rows. A misspelling that no row has shown still shares most
n-grams with the word it stands for.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Lengths of n-grams, cells that they are hashed to, and length of an embedding.
GRAMS, CELLS, DIMS = (3, 4, 5), 1 << 18, 8
#: The bound of the fit: labelled rows of each class at most, and distinct words of a text that may train.
TRAIN_ROWS, TRAIN_WORDS = {1: 1000, 0: 2000}, 20_000
#: How strongly a text's average leans to its most telling words, in a score and (so that further words learn beside one that already tells) in training.
FOCUS, TRAIN_FOCUS = 2.0, 1.0
#: Steps of Adam, texts in each, rates of the weights and of the bias, and the pull of embeddings towards zero.
STEPS, BATCH, RATE, BIAS_RATE, DECAY, EPSILON = 600, 64, 0.02, 0.003, 1.0, 1e-6
#: A cell that training met in as many texts counts half.
DOUBT = 3
#: Shares of a text's words and of a word's n-grams that a step sees: no word leans on one n-gram, no text on one word.
WORDS_SEEN, GRAMS_SEEN = 0.7, 0.6
#: Least score that predicts the label, and 1 of HELD_OUT remainders that never trains.
LIMIT, FOLDS, HELD_OUT = 0.7, 3, 1
#: Distinct words whose logits a Python worker remembers before it starts afresh.
MEMO_WORDS = 1_000_000
SEED = 5


def words_of(text: str | None) -> list[str]:
    """The distinct words of a whole text, in lower case, by first occurrence."""
    return list(dict.fromkeys(WORD.findall(text.lower()))) if text else []


def cells(word: str) -> list[int]:
    """The word and its n-grams (its ends marked) as cells; a word of any length has at least its own."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % CELLS for g in (*grams, "\0" + word)]


@dataclass
class Rows:
    """Lists of whole numbers of different lengths: ``flat[starts[i]:starts[i + 1]]`` is the i-th."""

    flat: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, lists: Sequence[Sequence[int]]) -> Rows:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((x for row in lists for x in row), np.int32, int(sizes.sum()))
        return cls(flat, np.concatenate(([0], sizes.cumsum())))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the rows ``at``, and for each value which of them it belongs to."""
        sizes = self.starts[at + 1] - self.starts[at]
        of = np.repeat(np.arange(len(at)), sizes)
        within = np.arange(len(of)) - np.repeat(sizes.cumsum() - sizes, sizes)
        return self.flat[np.repeat(self.starts[at], sizes) + within], of


def pooled(z: np.ndarray, of: np.ndarray, n: int, focus: float) -> tuple[np.ndarray, np.ndarray]:
    """The weighted average of logits ``z`` in each of ``n`` texts, and each word's weight there."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, of, z)
    w = np.exp(focus * (z - top[of]))
    w /= np.bincount(of, w, n)[of]
    return np.bincount(of, w * z, n), w


@dataclass
class Model:
    """What the trained embeddings and softmax give a cell, and the bias: all that scoring needs."""

    of_cell: np.ndarray
    bias: float

    def logits(self, words: Sequence[str]) -> np.ndarray:
        """Logit of each word: the linear softmax of its averaged embeddings, of the cells that training has met."""
        rows = Rows.of([cells(w) for w in words])
        if not len(words):
            return np.empty(0)
        value = self.of_cell[rows.flat]
        known = np.add.reduceat(value != 0, rows.starts[:-1], dtype=np.int64)
        return np.add.reduceat(value, rows.starts[:-1]) / np.maximum(known, 1) + self.bias

    def score(self, z: np.ndarray) -> float:
        """Score of a text from its words' logits; a text without words scores as the bias alone."""
        if not len(z):
            return float(1 / (1 + np.exp(-self.bias)))
        w = np.exp(FOCUS * (z - z.max()))
        return float(1 / (1 + np.exp(-(w @ z) / w.sum())))


def train(texts: Sequence[tuple[list[str], int]], seed: int = SEED) -> Model:
    """Embeddings and softmax from (distinct words, label) rows; the share of labels alone where one class is missing."""
    labels = np.array([y for _, y in texts], dtype=np.float64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2 or not all(any(words for words, y in texts if y == c) for c in (0, 1)):
        return Model(np.zeros(CELLS, np.float32), bias)
    r = np.random.default_rng(seed)
    known: dict[str, int] = {}
    docs = Rows.of([[known.setdefault(w, len(known)) for w in words] for words, _ in texts])
    grams = Rows.of([cells(w) for w in known])
    used, flat_all = np.unique(grams.flat, return_inverse=True)  # other cells stay zero: what no row has shown says nothing
    grams = Rows(flat_all.astype(np.int32), grams.starts)
    embedded = r.normal(0, 0.1, (len(used), DIMS)).astype(np.float32)
    softmax = r.normal(0, 1, (DIMS, 2)).astype(np.float32)
    offset = np.array([0.0, bias])
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (embedded, softmax, offset)]
    full = np.flatnonzero(np.diff(docs.starts))
    order = np.concatenate([r.permutation(full) for _ in range(STEPS * BATCH // len(full) + 2)])
    for step in range(1, STEPS + 1):
        batch = order[(step - 1) * BATCH : step * BATCH]
        words, of = docs.take(batch)
        seen = r.random(len(words)) < WORDS_SEEN
        words, of = words[seen], of[seen]
        distinct, back = np.unique(words, return_inverse=True)
        flat, owner = grams.take(distinct)
        seen = r.random(len(flat)) < GRAMS_SEEN
        flat, owner = flat[seen], owner[seen]
        sizes = np.maximum(np.bincount(owner, minlength=len(distinct)), 1)
        lean = softmax[:, 1] - softmax[:, 0]
        z = np.bincount(owner, np.einsum("ij,j->i", embedded, lean)[flat], len(distinct)) / sizes + offset[1] - offset[0]
        mean, weight = pooled(z[back], of, len(batch), TRAIN_FOCUS)
        error = (1 / (1 + np.exp(-mean)) - labels[batch]) / len(batch)
        # of the weighted average: each word's weight, and what leaning to it changes
        by_word = error[of] * weight * (1 + TRAIN_FOCUS * (z[back] - mean[of]))
        by_word = np.bincount(back, by_word, len(distinct)) / sizes
        by_cell = np.bincount(flat, by_word[owner], len(used)).astype(np.float32)
        of_softmax = np.einsum("i,ij->j", by_cell, embedded)
        slopes = (by_cell[:, None] * lean + DECAY / len(used) * embedded, np.stack((-of_softmax, of_softmax), axis=1), np.array([-error.sum(), error.sum()]))
        for p, slope, (m, v), rate in zip((embedded, softmax, offset), slopes, state, (RATE, RATE, BIAS_RATE), strict=True):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + EPSILON)
    of_cell = np.zeros(CELLS, np.float32)
    met = np.zeros(len(used), np.int64)
    for i in range(len(texts)):
        met[np.unique(grams.take(docs.take(np.array([i]))[0])[0])] += 1
    of_cell[used] = np.einsum("ij,j->i", embedded, softmax[:, 1] - softmax[:, 0]) * (met / (met + DOUBT))
    return Model(of_cell, float(offset[1] - offset[0]))


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [words_of(t) for t in pdf["text"]]
        yield pd.DataFrame({"label": pdf["label"], "words": ["\n".join(w) if len(w) <= TRAIN_WORDS else None for w in found]})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of ``labels``, whose held-out ids are never read.

    TRAIN_ROWS labelled ids of each class at most, those of the smallest hashes, are looked up
    in ``docs``; a text of more than TRAIN_WORDS distinct words does not train. Ids repeated in
    ``docs`` train by their smallest text, ids repeated in ``labels`` by their larger label.
    """
    known = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & (F.crc32("id") % FOLDS != HELD_OUT))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    part = lambda c: known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS[c])
    # at most sum(TRAIN_ROWS) ids and labels, so the side that is broadcast is bounded
    picked = F.broadcast(part(1).union(part(0)))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(picked, "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))
    got = rows.select("id", "label", "text").orderBy("id").mapInPandas(_listed, "label int, words string").where("words is not null")
    return train([(r["words"].split("\n") if r["words"] else [], r["label"]) for r in got.collect()])


def _scored(model: Model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    memo: dict[str, float] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            scores = []
            for text in pdf["text"]:
                words = words_of(text)
                new = [w for w in words if w not in memo]
                memo.update(zip(new, model.logits(new).tolist(), strict=True))
                scores.append(model.score(np.fromiter(map(memo.__getitem__, words), np.float64, len(words))))
            yield pd.DataFrame({"id": pdf["id"].astype(object), "score": scores})

    return run


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out boolean, score double (0 to 1), predicted int (1 from LIMIT on), one row per row of ``docs``.

    Whole texts are scored by their words alone. Null, empty and blank texts: the score of the
    bias, near the share of labels. Null ids are not held out; repeated rows are scored each.
    Empty table: empty result. Other columns are not read, whatever they are called.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(_scored(model), "id string, score double")
    held = F.coalesce(F.crc32("id") % FOLDS == HELD_OUT, F.lit(False))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), held.alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
