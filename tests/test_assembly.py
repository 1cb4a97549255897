import random
import re
import time

from pyspark.sql import functions as F

from lectern.functions import fixed as X
from lectern.operators import analysis, assembly, references


def joined(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece_no)):
        assert r.piece_no == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append(r.piece)
    for parts in got.values():
        assert all(len(p) == assembly.PIECE for p in parts[:-1]) and 0 < len(parts[-1]) <= assembly.PIECE
    return {d: "".join(p) for d, p in got.items()}


def test_pieces_put_together_are_the_text(spark):
    rng = random.Random(4)
    letters = ["a", "é", "𝔸", "\n", " ", "中"]
    rows = [(1, i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 4094, 4096, 9000])))) for i in range(60)]
    rows += [(2, 0, None), (2, 5, "x"), (3, 0, ""), (4, 10**6, "y" * 4096), (5, 0, "z" * 4096), (5, 1, ""), *((6, i, "") for i in range(9000))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, pos long, text string").repartition(3)
    want = {}
    for d, _, t in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(d, []).append(t or "")
    want = {d: "\n\n".join(t) for d, t in want.items()}
    assert joined(assembly.pieces(df, ["doc_id"], "pos", "\n\n").collect()) == {d: t for d, t in want.items() if t}
    assert assembly.pieces(df.limit(0), ["doc_id"], "pos", "\n\n").count() == 0


def test_full_text_is_stripped_as_a_whole(spark):
    rows = [(1, 0, " \n"), (1, 1, " \t a "), (1, 2, "  "), (1, 3, " b　"), (1, 4, "\n"), (2, 0, "  "), (3, 0, " only "), (3, 1, None), (4, 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, pos long, text string")
    want = {r.doc_id: r.full_text for r in analysis.full_text(df).collect() if r.full_text}
    assert joined(analysis.full_text_pieces(df).collect()) == want == {1: "a \n\n  \n\n b", 3: "only"}


def test_citations_beside_each_other_and_in_long_bodies(spark):
    rng = random.Random(5)
    bits = ["[1]", "[2, 4-6]", "[9-7]", "[3]", "[3]", "word ", "𝔸é ", "x" * 90, "y" * 400, " \n"]
    bodies = ["", "[1]", "no mark", "[1][2][3]", "[1]" * 300, "[" + ", ".join(map(str, range(150))) + "]" + "[1]" * 3]
    bodies += ["".join(rng.choice(bits) for _ in range(n)) for n in (5, 40, 400)]
    want = []
    for d, body in enumerate(bodies):
        for n, m in enumerate(re.finditer(X.CITATION, body)):
            want.append((d, n, m.group(0), body[max(0, m.start() - 200) : m.end() + 200].strip()))
    df = spark.createDataFrame([*enumerate(bodies), (99, None)], "doc_id long, body string")
    got = references.citations(df)
    seen = {(r.doc_id, r.cite_no, r.in_text, r.surrounding_text) for r in got.collect()}
    assert seen == {w for w in want if w[2] != "[9-7]"}
    ids = [r.ref_id for r in got.where("doc_id = 5 and cite_no = 0").orderBy("id_no").collect()]
    assert ids == [str(i) for i in range(150)]


def test_citations_of_a_long_body_take_time_in_proportion(spark):
    def seconds(n):
        df = spark.range(1).select(F.lit(0).alias("doc_id"), F.repeat(F.lit("some words about it [12] and more, "), n).alias("body"))
        start = time.time()
        assert references.citations(df).agg(F.count("surrounding_text")).first()[0] == n
        return time.time() - start

    seconds(100)
    few, many = seconds(10_000), seconds(80_000)
    assert many < 20 * max(few, 0.5)
