import hashlib
import re

import pytest
from llm_helpers import same_rows

from lectern.llm import catalog, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12)) if w and item is not None else ():
            wins.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                found = wins.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    names |= found
        ids = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), ids, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


PASSAGE = " ".join(f"p{i}" for i in range(20))
ITEMS = [(1, PASSAGE), (2, "Tiny ITEM here"), (2, PASSAGE.upper()), (10, PASSAGE), (3, None), (4, "..."), (None, "lonely words"), (5, "Tiny item here")]
DOCS = [
    (1, f"before {PASSAGE} after " + "x " * 10),
    (2, "x " * 300 + "tiny, Item-HERE!"),
    (3, " ".join(f"p{i}" for i in range(12))),
    (4, None),
    (5, ""),
    (6, f"{PASSAGE} {PASSAGE}"),
    (6, f"{PASSAGE} {PASSAGE}"),
    (None, PASSAGE),
    (7, "lonely words"),
    (8, "tiny item here tiny item here"),
    (9, " ".join(f"p{i}" for i in range(14)) + " é" * 200),
]


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_BYTES, 0])
def test_matches_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.judge(docs, items).collect()
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated) for r in got]
    assert sorted(rows, key=str) == brute(DOCS, ITEMS)


def test_removes_documents_or_spans(spark):
    docs = spark.createDataFrame([(*d, "mine") for d in DOCS], "doc_id long, text string, _s string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontaminate.drop_documents(docs, items)
    same_rows(left, docs)
    assert sorted((r.doc_id for r in left.collect()), key=str) == [2, 3, 4, 5, 7]
    cut = {r.doc_id: r.text for r in decontaminate.drop_spans(docs, items).collect()}
    assert cut[2] == "x " * 300 + ", -!"
    assert cut[7] == "lonely words" and cut[4] is None and cut[5] == ""
    assert "p3" not in cut[1] and cut[1].startswith("before ") and cut[1].rstrip().endswith("x")


def test_hard_rows_and_empty_tables(spark, hard_docs):
    items = spark.createDataFrame([(1, "the cat sat on the mat")], "item_id long, text string")
    assert decontaminate.judge(hard_docs, items).count() == hard_docs.count()
    left = decontaminate.drop_documents(hard_docs, items)
    same_rows(left, hard_docs)
    assert left.count() == hard_docs.count() - 3
    none = items.limit(0)
    assert decontaminate.drop_documents(hard_docs, none).count() == hard_docs.count()
    assert decontaminate.judge(hard_docs.limit(0), items).count() == 0


def test_query_is_registered():
    assert "op1_decontaminate" in catalog.QUERIES and "op1_decontaminate" in catalog.ORACLES
