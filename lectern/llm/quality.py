"""Quality classifier: supervised subword embeddings.

A text is the average of learnt vectors of its words and of their character n-grams, hashed
into ``BUCKETS`` rows; a word that only repeats the one before adds the vectors of a word of its
own. A softmax layer reads the average. Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents.

As average and softmax are linear up to the last step, a trained model folds into one number
per bucket: a text scores by the mean of its features' numbers. Executors get that vector
(1 MB whatever the corpus), look up each distinct word once and read every text whole.

Defined results: null and empty texts have no features and score the share of label 1 among
the labels; without both classes to learn from every text scores that share (1.0 without any
labels); repeated rows each come back.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.columns import crc_remainder
from lectern.llm.supervision import PER_CLASS, Sample, labelled, prior_shift

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4)
EPOCHS = 4
BATCH = 16
RATE = 1.0
#: The word that stands for a repetition of the word before.
AGAIN = "\x00again"
#: From this score on a document is good.
GOOD = 0.3
#: Distinct words a task remembers before it starts anew.
REMEMBER = 400_000


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    marked = f"<{word}>"
    out = [zlib.crc32(marked.encode())]
    for n in GRAMS:
        out.extend(zlib.crc32(marked[i : i + n].encode()) for i in range(len(marked) - n + 1))
    return [h % BUCKETS for h in out]


def _bag(text: str, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    arrays, last = [], None
    for word in text.split():
        for w in (word, AGAIN) if word == last else (word,):
            if w not in known:
                known[w] = np.array(features(w), dtype=np.int64)
            arrays.append(known[w])
        last = word
    if not arrays:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    ids, counts = np.unique(np.concatenate(arrays), return_counts=True)
    return ids, (counts / counts.sum()).astype(np.float32)


def train(texts: list[str], classes: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(margin of each bucket, bias): log odds of class 1 are their mean over a text, plus the bias."""
    known: dict[str, np.ndarray] = {}
    bags = [(b, c) for b, c in ((_bag(t, known), c) for t, c in zip(texts, classes)) if len(b[0])]
    known.clear()
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    truth = np.eye(2, dtype=np.float32)[[c for _, c in bags]]
    steps, step = epochs * math.ceil(len(bags) / BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for start in range(0, len(order), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            rows = order[start : start + BATCH]
            ids = np.concatenate([bags[r][0][0] for r in rows])
            shares = np.concatenate([bags[r][0][1] for r in rows])
            lengths = np.array([len(bags[r][0][0]) for r in rows])
            hidden = np.add.reduceat(vectors[ids] * shares[:, None], np.r_[0, np.cumsum(lengths)[:-1]])
            raw = hidden @ out + bias
            odds = np.exp(raw - raw.max(axis=1, keepdims=True))
            error = (odds / odds.sum(axis=1, keepdims=True) - truth[rows]) / len(rows)
            back = error @ out.T
            out -= rate * hidden.T @ error
            bias -= rate * error.sum(axis=0)
            move = np.repeat(back, lengths, axis=0) * (shares * np.repeat(lengths, lengths))[:, None]
            sort = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(ids[sort]) > 0])
            vectors[ids[sort][first]] -= rate * np.add.reduceat(move[sort], first)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def fit(sample: Sample) -> tuple[np.ndarray, float]:
    if len(set(sample.classes)) < 2:
        seen = sample.totals
        share = (seen.get(1, 0) + (not seen)) / max(1, sum(seen.values()))
        return np.zeros(BUCKETS), math.inf if share == 1 else -math.inf
    margins, bias = train(sample.texts, sample.classes)
    return margins, bias + prior_shift(sample)


def score_texts(model: tuple[np.ndarray, float], text: Column) -> Column:
    """The probability of class 1 of each whole text."""
    margins, bias = model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[float, int]] = {}

        def learn(word: str) -> tuple[float, int]:
            ids = features(word)
            found = (float(margins[ids].sum()), len(ids))
            if len(word) < 100:
                if len(known) > REMEMBER:
                    known.clear()
                known[word] = found
            return found

        again = learn(AGAIN)

        def one(text: str | None) -> float:
            total, n, last = 0.0, 0, None
            get = known.get
            for word in (text or "").split():
                m, k = get(word) or learn(word)
                total += m
                n += k
                if word == last:
                    total += again[0]
                    n += again[1]
                last = word
            z = max(-700.0, min(700.0, (total / n if n else 0.0) + bias))
            return 1 / (1 + math.exp(-z))

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return score(text)


def grade(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` plus ``score`` and ``predicted``. ``learn`` limits the labels that are learnt from."""
    sample = labelled(docs, labels, "quality", F.lit(True) if learn is None else learn, per_class)
    scored = docs.withColumn("score", score_texts(fit(sample), F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def drop_poor(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` without the rows that score below ``GOOD``; columns as they are."""
    model = fit(labelled(docs, labels, "quality", F.lit(True), per_class))
    return docs.where(score_texts(model, docs["text"]) >= GOOD)


def held_out(doc_id: Column) -> Column:
    """Never true of a null id, which is never learnt from either."""
    return F.coalesce(crc_remainder(doc_id, 5) == 0, F.lit(False))
