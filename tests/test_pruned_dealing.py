"""What the essential terms of a block add to a chunk is summed up where the block's postings lie."""

from pyspark.sql import functions as F

from lectern.operators import lexical


def test_pairs_of_requests_and_postings_are_not_moved(spark, monkeypatch):
    word = lambda j: F.concat(F.lit("w"), F.abs(F.xxhash64("pos", F.lit(j)) % 90).cast("string"))
    chunks = spark.range(1500).select(F.lit("all").alias("scope_id"), F.col("id").alias("pos"), F.lit("").alias("section_id"))
    chunks = chunks.withColumn("search_text", F.concat_ws(" ", *[word(j) for j in range(12)])).cache()
    asked = spark.createDataFrame([(f"r{i}", "all", f"w{i} w{i + 9} w{i + 30}", 5) for i in range(4)], "request_id string, scope_id string, query string, k int")
    plans, written = {}, lexical.written

    def kept(df, label, **more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, label, **more)

    monkeypatch.setattr(lexical, "written", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pruned = lexical.search(chunks, asked, section_boost=False, width=128).select("request_id", "pos", "rank").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plain = lexical.search(chunks, asked, section_boost=False).select("request_id", "pos", "rank").collect()
    assert sorted(pruned) == sorted(plain) and len(plain) == 20
    above = plans["lexical-candidates"].split("SortMergeJoin [scope_id")[0]
    assert "HashAggregate" in above and "Exchange" not in above
