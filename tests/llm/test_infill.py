import hashlib
import re

import numpy as np
import pytest

from lectern.llm import infill

UNIT = {"lines": r"[^\n]*\n|[^\n]+", "sentences": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "words": r"\S*\s|\S+"}


def brute(doc_id, text, unit="lines", seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(UNIT[unit], text, re.ASCII)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    x, y, z = ("".join(p) for p in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, text, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, text, len(units), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return doc_id, text, len(units), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def agree(docs, **how):
    made = infill.transform(docs, **how)
    got = made.withColumn("back", infill.restored(made["output"], made["form"])).collect()
    assert all(r.back == r.text for r in got)
    want = [brute(r.doc_id, r.text, **how) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)
    return got


def test_wavelet_matrix_counts():
    rng = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix, ends = infill.WaveletMatrix(symbols), np.arange(size + 1)
        for c in range(8):
            assert matrix.rank(c, ends).tolist() == [int((symbols[:e] == c).sum()) for e in ends]


def test_locate_is_the_first_place():
    text = "a\nbb\n\nccc"
    matrix = infill.WaveletMatrix(infill.classes(text))
    k = np.arange(6)
    at = matrix.locate((infill.NEWLINE,), k, np.zeros(6, dtype=np.int64), np.full(6, len(text)))
    assert at.tolist() == [0, 2, 5, 6, 9, 9]


@pytest.mark.parametrize("unit", list(UNIT))
def test_units(spark, unit):
    texts = ["one. two! three?\nfour", "\n\n\n", "no end", "a\r\nb\tc  d", "ünï. 漢字。\n𝔘  x", "tail\n", "x" * 70 + "\n" + "y. " * 50, "<", "a<P\nS>b<", "<\n<S\n>"]
    docs = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(200)], "doc_id long, text string")
    got = agree(docs, unit=unit)
    assert {r.form for r in got} == {"psm", "spm"}
    forms = [r.form for r in agree(docs, unit=unit, seed=11, rate=40, spm=20)]
    assert forms.count("plain") > forms.count("psm") > forms.count("spm") > 0


def test_batches_are_cut_between_texts(spark, monkeypatch):
    texts = [f"line {i}\n" * (i % 9) + "end" * (i % 2) for i in range(60)]
    h1, h2 = np.arange(60) * 7919, np.arange(60) * 104729
    whole = np.stack(infill.cut(texts, h1, h2, (infill.NEWLINE,)))
    monkeypatch.setattr(infill, "MATRIX", 100)
    parts = list(infill._runs([len(t) for t in texts]))
    assert len(parts) > 10 and [i for s in parts for i in range(s.start, s.stop)] == list(range(60))
    assert (np.concatenate([np.stack(infill.cut(texts[s], h1[s], h2[s], (infill.NEWLINE,))) for s in parts], axis=1) == whole).all()


def test_hard_rows(spark, hard_docs):
    got = agree(hard_docs)
    assert {r.form for r in got if r.text == ""} == {"plain"}
    held = spark.createDataFrame([(i, t) for i in range(20) for t in ("say <P> loud\nb", "<S>", "\n<M>\n")], "doc_id long, text string")
    assert {r.form for r in agree(held)} == {"plain"}
    assert infill.transform(hard_docs.limit(0)).count() == 0
