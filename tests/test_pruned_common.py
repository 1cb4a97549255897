"""Where all words are common, few chunks are left to be scored in full."""

from pyspark.sql import functions as F

from lectern.operators import lexical


def test_few_candidates(spark, monkeypatch):
    word = lambda j: F.concat(F.lit("w"), (F.xxhash64("pos", F.lit(j)) % 120).cast("string"))
    chunks = spark.range(4000).select(F.lit("all").alias("scope_id"), F.col("id").alias("pos"), F.lit("").alias("section_id"))
    chunks = chunks.withColumn("search_text", F.regexp_replace(F.concat_ws(" ", *[word(j) for j in range(30)]), "-", "")).cache()
    asked = spark.createDataFrame([(f"r{i}", "all", " ".join(f"w{(i * 5 + j * 3) % 120}" for j in range(10)), 5) for i in range(4)], "request_id string, scope_id string, query string, k int")
    plain = lexical.search(chunks, asked, section_boost=False).select("request_id", "pos", "rank").collect()
    seen, met = [], lexical.met

    def counted(post, terms, *rest):
        if "pos" in terms.columns:
            seen.append(terms.select("request_id", "pos").distinct().count())
        return met(post, terms, *rest)

    monkeypatch.setattr(lexical, "met", counted)
    pruned = lexical.search(chunks, asked, section_boost=False, width=512).select("request_id", "pos", "rank").collect()
    assert sorted(pruned) == sorted(plain) and len(plain) == 20
    assert seen[-1] < 4 * 4000 / 20
