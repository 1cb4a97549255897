"""Fill-in-middle: a text is cut into prefix, middle and suffix at unit boundaries and rearranged.

The cuts are found with a wavelet matrix. Each character has one of eight classes, so a text is a
sequence of 3-bit symbols; the matrix keeps three bit planes with counted words and answers
"how many characters of class c are among the first i" (rank) in three steps. A unit ends
after any character of some classes, so the ranks of those classes add up to the number of
unit ends before a place, and bisection on that sum finds the place where the k-th unit ends.
One matrix holds all texts of a batch, up to ``MATRIX`` characters, and answers for all of them at
once; a longer text has a matrix of its own. Nothing is cut to a prefix.

Python returns three numbers a text. Hashes, the choice of the form, the new text and its
restoration are column expressions.

Defined results: null texts are empty; empty texts and texts that hold a sentinel stay plain; a
null doc_id hashes as an empty one; repeated rows each come back; further columns of the input
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

PLANES = 3
#: Classes of characters.
BEYOND, LETTER, DIGIT, BLANK, NEWLINE, STOP, SIGN, CONTROL = range(1 << PLANES)
#: Classes after which a unit ends.
UNITS = {"lines": (NEWLINE,), "sentences": (NEWLINE, STOP), "words": (NEWLINE, BLANK)}
#: Characters that share a matrix.
MATRIX = 4_000_000


def _classes() -> np.ndarray:
    out = np.full(129, SIGN, dtype=np.uint8)
    for i in range(128):
        c = chr(i)
        if c == "\n":
            out[i] = NEWLINE
        elif c.isspace():
            out[i] = BLANK
        elif c.isalpha():
            out[i] = LETTER
        elif c.isdigit():
            out[i] = DIGIT
        elif c in ".!?":
            out[i] = STOP
        elif i < 32 or i == 127:
            out[i] = CONTROL
    out[128] = BEYOND
    return out


CLASS = _classes()


def classes(text: str) -> np.ndarray:
    """One class for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return CLASS[np.minimum(points, 128)]


class Plane:
    """Bits with the number of ones before each word of 64."""

    def __init__(self, ones: np.ndarray) -> None:
        packed = np.packbits(ones, bitorder="little")
        self.words = np.zeros(len(ones) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = len(ones) - int(self.before[-1])

    def rank(self, ends: np.ndarray) -> np.ndarray:
        """Ones among the first ``ends`` bits."""
        word = ends >> 6
        low = self.words[word] & ((np.uint64(1) << (ends & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray) -> None:
        self.planes = []
        for bit in reversed(range(PLANES)):
            ones = (symbols >> bit) & 1
            self.planes.append(Plane(ones))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: int, ends: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``ends`` places."""
        start, end = np.zeros_like(ends), ends
        for plane, bit in zip(self.planes, reversed(range(PLANES))):
            ones = plane.rank(start), plane.rank(end)
            if symbol >> bit & 1:
                start, end = plane.zeros + ones[0], plane.zeros + ones[1]
            else:
                start, end = start - ones[0], end - ones[1]
        return end - start

    def boundaries(self, ending: tuple[int, ...], ends: np.ndarray) -> np.ndarray:
        return sum(self.rank(symbol, ends) for symbol in ending)

    def locate(self, ending: tuple[int, ...], k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place in (low, high] with ``k`` boundaries after ``low``; ``low`` for k = 0, ``high`` if there are fewer."""
        goal = self.boundaries(ending, low) + k
        high = np.where(k > 0, high, low)
        while (apart := high - low > 1).any():
            middle = (low + high) >> 1
            reached = self.boundaries(ending, middle) >= goal
            high, low = np.where(apart & reached, middle, high), np.where(apart & ~reached, middle, low)
        return high


def cut(texts: list[str], h1: np.ndarray, h2: np.ndarray, ending: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units, end of the prefix and end of the middle, in code points, of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    symbols = classes("".join(texts))
    matrix = WaveletMatrix(symbols)
    full = matrix.boundaries(ending, ends) - matrix.boundaries(ending, starts)
    last = symbols[np.maximum(ends - 1, 0)] if len(symbols) else np.zeros(len(texts), dtype=np.uint8)
    n = full + ((sizes > 0) & ~np.isin(last, ending))
    a, b = h1 % (n + 1), h2 % (n + 1)
    first = matrix.locate(ending, np.minimum(a, b), starts, ends) - starts
    second = matrix.locate(ending, np.maximum(a, b), starts, ends) - starts
    return n, first, second


def _runs(sizes: list[int]) -> Iterator[slice]:
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > MATRIX:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _cutter(unit: str):
    ending = UNITS[unit]

    @F.pandas_udf("n long, first long, second long")
    def cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, h1, h2 in batches:
            texts, one, two = text.tolist(), h1.to_numpy(dtype=np.int64), h2.to_numpy(dtype=np.int64)
            parts = [np.stack(cut(texts[s], one[s], two[s], ending)) for s in _runs([len(t) for t in texts])]
            yield pd.DataFrame(np.concatenate([np.zeros((3, 0), dtype=np.int64), *parts], axis=1).T, columns=["n", "first", "second"])

    return cuts


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _draw(doc_id: Column, seed: int, i: int) -> Column:
    """The i-th of the 32-bit numbers that a document draws."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, unit: str = "lines", seed: int = 7, rate: int = 100, spm: int = 50, marks: Sentinels = Sentinels()) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``.

    ``rate`` per cent of the texts are rearranged, ``spm`` per cent of those with the suffix first.
    """
    drawn = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        *(_draw(F.col("doc_id"), seed, i).alias(f"h{i + 1}") for i in range(4)),
    )
    text = F.col("text")
    plain = (text == "") | text.contains(marks.prefix) | text.contains(marks.suffix) | text.contains(marks.middle) | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    cutting = drawn.withColumn("c", _cutter(unit)("text", "h1", "h2")).select("doc_id", "text", "c", form.alias("form"))
    first, second = F.col("c.first").cast("int"), F.col("c.second").cast("int")
    prefix, middle = F.substr(text, F.lit(1), first), F.substr(text, first + 1, second - first)
    suffix = F.substr(text, second + 1)
    opened = {name: F.lit(getattr(marks, name)) for name in ("prefix", "suffix", "middle")}
    output = (
        F.when(F.col("form") == "psm", F.concat(opened["prefix"], prefix, opened["suffix"], suffix, opened["middle"], middle))
        .when(F.col("form") == "spm", F.concat(opened["suffix"], suffix, opened["prefix"], prefix, opened["middle"], middle))
        .otherwise(text)
    )
    moved = F.col("form") != "plain"
    return cutting.select(
        "doc_id",
        "text",
        F.col("c.n").alias("n"),
        "form",
        F.when(moved, F.col("c.first")).alias("prefix_chars"),
        F.when(moved, F.col("c.second") - F.col("c.first")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The exact text again. A plain text is its own output; in the others each sentinel stands once,
    since a text that holds one stays plain and none can arise where a part meets a sentinel."""

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        a, b = F.instr(output, two), F.instr(output, marks.middle)
        first = F.substr(output, F.lit(len(one) + 1), a - len(one) - 1)
        return first, F.substr(output, a + len(two), b - a - len(two)), F.substr(output, b + len(marks.middle))

    prefix, suffix, middle = parts(marks.prefix, marks.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(marks.suffix, marks.prefix)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
