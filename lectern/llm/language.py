"""Language identification as inference of a mixture.

For every learnt language the corpus gives counts of hashed character n-grams (orders
``ORDERS``, word ends included), so a word has a likelihood in each language. A document is a
mixture: expectation-maximisation finds the proportions of the languages its words come from.
The set of languages is chosen by penalised likelihood: of the sets that languages make in
order of their proportion, the one whose log likelihood less the penalty for each language is
largest, for each document by itself. The language of
the document is the one with the largest share of the chosen set, the score that share.

Counting covers every learnable document: each task sums its words, then its n-grams, and one
aggregate adds the tasks up. The table has languages x ``BINS`` numbers, whatever the corpus.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every
text if nothing can be learnt; ties go to the language first in order; repeated rows each
come back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.columns import crc_remainder

ORDERS = (1, 2, 3, 4)
BINS = 1 << 16
SMOOTH = 0.5
ROUNDS = 12
#: Log likelihood that one more language has to gain, in units of log(words).
PENALTY = 2.0
#: Words a counting task holds before it turns them into n-gram counts; words a task remembers.
HELD = 200_000
#: Documents whose proportions are found together.
TOGETHER = 500
WORD = re.compile(r"[^\W\d_]+")


def gram_bins(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(position of the word, bin) of every n-gram of every word."""
    chars = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    space = chars == 32
    of = np.cumsum(space) - 1
    where, bins = [], []
    for n in ORDERS:
        count = len(chars) - n + 1
        if count <= 0:
            continue
        h = np.full(count, np.uint64(n))
        for i in range(n):
            h = (h ^ chars[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        # grams may hold the space before and after a word, not two words
        inner = np.zeros(count, dtype=np.int64)
        for i in range(1, n - 1):
            inner += space[i : i + count]
        last_space = space[n - 1 : n - 1 + count]
        ok = (inner == 0) & (~space[:count] if n == 1 else ~(space[:count] & last_space))
        where.append(of[:count][ok])
        bins.append((h[ok] % np.uint64(BINS)).astype(np.int64))
    return np.concatenate(where), np.concatenate(bins)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, Counter] = {}
    sums: dict[str, np.ndarray] = {}

    def settle() -> None:
        for lang, words in held.items():
            if words:
                where, bins = gram_bins(list(words))
                weight = np.fromiter(words.values(), dtype=np.float64, count=len(words))[where]
                sums.setdefault(lang, np.zeros(BINS))[:] += np.bincount(bins, weights=weight, minlength=BINS)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            held.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            if sum(map(len, held.values())) > HELD:
                settle()
    settle()
    for lang, counts in sums.items():
        bins = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bin": bins, "n": counts[bins].astype(np.int64)})


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood of each bin in each) from all of ``docs`` (text, lang)."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    summed = usable.mapInPandas(_count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    rows = summed.toPandas()  # at most languages x BINS
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((BINS, len(langs)))
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        counts[own["bin"].to_numpy(), k] = own["n"].to_numpy()
    return langs, np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * BINS)) if langs else counts


def proportions(odds: np.ndarray, n: np.ndarray, of: np.ndarray, start: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: word ``i`` occurs ``n[i]`` times in document ``of[i]``."""
    total = np.add.reduceat(n, start)[:, None]
    for _ in range(rounds):
        part = odds * shares[of]
        part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        shares = np.add.reduceat(part, start) / total
    fit = np.log(np.maximum((odds * shares[of]).sum(axis=1), 1e-300)) * n
    return shares, np.add.reduceat(fit, start)


def infer(odds: np.ndarray, n: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Proportions of each document's best set of languages; every size of set is tried for every document."""
    k_langs = odds.shape[1]
    start, of = np.r_[0, np.cumsum(lengths)[:-1]], np.repeat(np.arange(len(lengths)), lengths)
    shares, _ = proportions(odds, n, of, start, np.full((len(lengths), k_langs), 1 / k_langs), ROUNDS)
    rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1, kind="stable")
    penalty = PENALTY * np.log(np.maximum(np.add.reduceat(n, start), 2))
    best, best_fit = None, None
    for k in range(1, k_langs + 1):
        allowed = np.where(rank < k, np.maximum(shares, 1e-9), 0)
        found, fit = proportions(odds, n, of, start, allowed / allowed.sum(axis=1, keepdims=True), 0 if k == 1 else ROUNDS)
        fit = fit - penalty * k
        if best is None:
            best, best_fit = found, fit
            continue
        better = fit > best_fit
        best[better], best_fit[better] = found[better], fit[better]
    return best


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``; columns of these names are replaced."""
    langs, table = model

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        odds = np.zeros((0, len(langs)))

        def chunk(texts: list[str | None]) -> list[tuple[str, float]]:
            nonlocal odds
            counted = [Counter(WORD.findall(t.lower())) if t and langs else Counter() for t in texts]
            voiced = [any(any(map(str.isalpha, w)) for w in c) for c in counted]
            if sum(map(len, counted)) + len(known) > 2 * HELD:
                known.clear()
                odds = np.zeros((0, len(langs)))
            fresh = list(dict.fromkeys(w for c in counted for w in c if w not in known))
            if fresh:
                where, bins = gram_bins(fresh)
                sums = np.stack([np.bincount(where, weights=table[bins, k], minlength=len(fresh)) for k in range(len(langs))], axis=1)
                known.update(zip(fresh, range(len(odds), len(odds) + len(fresh))))
                odds = np.concatenate([odds, np.exp(sums - sums.max(axis=1, keepdims=True))])
            some = [c for c, v in zip(counted, voiced) if v]
            if not some:
                return [("und", 0.0)] * len(texts)
            lengths = np.array([len(c) for c in some])
            at = np.fromiter((known[w] for c in some for w in c), dtype=np.int64, count=lengths.sum())
            n = np.fromiter((m for c in some for m in c.values()), dtype=np.float64, count=lengths.sum())
            shares = infer(odds[at], n, lengths)
            top = shares.argmax(axis=1)
            found = iter([(langs[k], float(min(1.0, s[k]))) for k, s in zip(top, shares)])
            return [next(found) if v else ("und", 0.0) for v in voiced]

        for batch in batches:
            rows: list[tuple[str, float]] = []
            for i in range(0, len(batch), TOGETHER):
                rows += chunk(batch.iloc[i : i + TOGETHER].tolist())
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    found = docs.withColumn("_lectern_found", predict("text"))
    return found.withColumns({"lang_pred": F.col("_lectern_found.lang_pred"), "score": F.col("_lectern_found.score")}).drop("_lectern_found")


def held_out(doc_id: Column) -> Column:
    """Never true of a null id, which is never learnt from either."""
    return F.coalesce(crc_remainder(doc_id, 5) == 0, F.lit(False))
