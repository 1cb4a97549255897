"""Classifiers: held-out results on the small tables, restoration, EM, and hard rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.llm import catalog, language, quality, supervision, toxicity

SF = "/root/testdata/sf0.01"


def judged(spark, name, label):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label).toPandas()
    return got[got["held_out"]].merge(labels, on="doc_id")


def test_quality_held_out(spark):
    held = judged(spark, "op4_quality", "quality")
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert ((held["score"] >= 0.3).astype(int) == held["predicted"]).all()


def test_toxicity_held_out(spark):
    held = judged(spark, "op7_toxicity", "toxic")
    assert (held["predicted"] == held["toxic"]).mean() > 0.93
    assert held[held["toxic"] == 0]["predicted"].mean() < 0.03


def test_language_held_out(spark):
    got = catalog.QUERIES["op8_language"](spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got[got["held_out"]].merge(truth, on="doc_id")
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97


@pytest.fixture(scope="module")
def chars():
    rng = random.Random(1)
    plain = "you are such a loser and an idiot while the moron reads pathetic worthless trash stupid people say the other day".split()
    texts = [" ".join(rng.choice(plain) for _ in range(200)) for _ in range(20)]
    counts = {n: np.zeros(b) for n, b in toxicity.ORDER_BINS.items()}
    for found in toxicity._count([pd.DataFrame({"text": texts})]):
        counts[int(found["n"].iloc[0])][found["bin"]] = found["count"]
    return toxicity.CharModel(counts)


@pytest.mark.parametrize(
    "text,word",
    [("a l0ser", "loser"), ("1d10t", "idiot"), ("you m.o.r.o.n", "moron"), ("stuuuupid", "stupid"), ("w0rthle$$", "worthless"), ("t r a s h day", "trash"), ("p-a-t-h-e-t-i-c", "pathetic"), ("l 0 s e r", "loser")],
)
def test_restores_disguised_words(chars, text, word):
    assert word in toxicity.restored_words(chars, text)


@pytest.mark.parametrize(
    "text,word",
    [("l" + "0" * 150 + "s" * 150 + "er", "loser"), ("people,other/day-" * 20 + "1d10t,say", "idiot"), ("这是一句很长的话" * 30 + "l0ser了" + "你好" * 40, "loser")]
    + [("คนนี้" * 60 + "m0ron" + "ครับ", "moron"), ("x9" * 150 + "/pathet1c/" + "9x" * 150, "pathetic"), ("这loser了", "loser")]
    + [("id.iot", "idiot"), ("mo-ron", "moron"), ("mor_on", "moron"), ("you,lo/ser", "loser"), ("say/1d10t/day", "idiot")]
    + [("i  d  i  o  t", "idiot"), ("i\nd\ni\no\nt\n", "idiot"), ("i - d - i - o - t", "idiot"), ("i/d/i/o/t", "idiot"), ("m_o_r_o_n_", "moron"), ("say: l , 0 , s , e , r.", "loser")],
)
def test_restores_long_and_parted_words(chars, text, word):
    assert word in toxicity.restored_words(chars, text)


def test_long_hard_texts_take_linear_time(chars):
    for text in ("* " * 20_000 + "ab", "a_" * 20_000 + "bc", "ab." * 10_000, "-" * 100_000, "a!" + "!" * 100_000):
        toxicity.restored_words(chars, text)


def test_plain_words_stay(chars):
    assert toxicity.restored_words(chars, "The people say so 4 times, e.g. in 2.0.") == {"the", "people", "say", "so", "times", "e", "g", "in"}


def test_viterbi_is_the_best_path(chars):
    """Against all readings of the lattice, costed one by one."""
    import itertools

    for stretch in ("l0s3r", "i d 1", "aaab4"):
        best = None
        for path in itertools.product(*toxicity.lattice(stretch)):
            cost, before = 0.0, "  "
            for chars_, channel in [*path, (" ", 0.0)]:
                cost += channel
                for c in chars_:
                    if c == " " and before[-1] == " ":
                        continue
                    cost += chars.cost(before, c)
                    before = before[1] + c if c != " " else "  "
            text = "".join(c for c, _ in path).strip()
            if best is None or cost < best[0] - 1e-12:
                best = (cost, text)
        assert toxicity.decode(chars, stretch).split() == best[1].split()


def test_character_counts_cover_all_documents(spark):
    docs = spark.createDataFrame([("ab ab",), ("ab",), (None,), ("",)], "text string").repartition(3)
    model = toxicity.CharModel.fit(docs)
    assert model.counts[1][toxicity._hash(toxicity._codes("a"), 1)[0]] == 3
    assert model.counts[2][toxicity._hash(toxicity._codes("ab"), 2)[0]] == 3
    assert model.counts[3][toxicity._hash(toxicity._codes("  a"), 3)[0]] == 3


def test_em_finds_proportions():
    rng = np.random.default_rng(0)
    first = rng.random(400) < 0.7
    odds = np.where(first[:, None], [1.0, 0.01, 0.001], [0.01, 1.0, 0.001])
    shares = language.infer(odds, np.ones(400), np.array([400]))[0]
    assert shares[0] == pytest.approx(first.mean(), abs=0.02) and shares[2] == 0
    alone = language.infer(np.tile([1.0, 0.2, 0.1], (50, 1)), np.ones(50), np.array([50]))[0]
    assert alone.tolist() == [1.0, 0.0, 0.0]


def test_languages_do_not_depend_on_neighbours():
    """The second language adds nothing to the first, the third does; a neighbour has two clear languages."""
    own = np.where(np.arange(300)[:, None] % 3 > 0, [1.0, 0.999, 0.0001], [0.02, 0.0201, 0.2])
    other = np.where(np.arange(300)[:, None] % 5 > 1, [1.0, 0.01, 0.001], [0.01, 1.0, 0.001])
    alone = language.infer(own, np.ones(300), np.array([300]))[0]
    both = language.infer(np.r_[own, other], np.ones(600), np.array([300, 300]))[0]
    assert np.allclose(alone, both) and alone[2] > 0.2


def test_language_hard_rows(spark, hard_docs):
    model = language.fit(hard_docs)
    rows = language.identify(hard_docs, model).collect()
    assert len(rows) == hard_docs.count()
    assert all((r.lang_pred == "und" and r.score == 0) == (not any(map(str.isalpha, r.text or ""))) for r in rows)
    nothing = language.fit(hard_docs.limit(0))
    assert {r.lang_pred for r in language.identify(hard_docs, nothing).collect()} == {"und"}
    assert language.identify(hard_docs.limit(0), model).count() == 0


@pytest.mark.parametrize("module,keep", [(quality, "drop_poor"), (toxicity, "drop_toxic")])
def test_graders_hard_rows(spark, hard_docs, hard_labels, module, keep):
    rows = module.grade(hard_docs, hard_labels).collect()
    assert len(rows) == hard_docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert module.grade(hard_docs.limit(0), hard_labels).count() == 0
    kept = getattr(module, keep)(hard_docs, hard_labels)
    assert kept.columns == hard_docs.columns and kept.exceptAll(hard_docs).isEmpty()
    # nothing to learn from: all stay
    assert getattr(module, keep)(hard_docs, hard_labels.limit(0)).count() == hard_docs.count()
    one_class = hard_labels.where("doc_id = 1")
    assert all(r.score == pytest.approx(float(module is quality), abs=1e-12) for r in module.grade(hard_docs, one_class).collect())


def test_sample_is_bounded_and_fixed(spark, hard_docs, hard_labels):
    a = supervision.labelled(hard_docs, hard_labels, "quality", F.lit(True), per_class=1)
    b = supervision.labelled(hard_docs.repartition(5), hard_labels.repartition(3), "quality", F.lit(True), per_class=1)
    assert a == b and max(map(a.classes.count, (0, 1)), default=0) <= 1 and a.totals == {0: 3, 1: 2}
