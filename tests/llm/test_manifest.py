import hashlib

from pyspark.sql import functions as F

from lectern.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def leaf(row):
    parts = []
    for name in manifest.FIELDS:
        v = None if row[name] is None else str(row[name])
        parts.append("-" if v is None else f"{len(v.encode())}:{v}")
    return h(*parts)


def climb(nodes):
    """The top of a tree, and (left, right) of each level for each node."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 8 * 8 : a // 8 * 8 + 8]
            paths[i].append(("".join(run[: a % 8]), "".join(run[a % 8 + 1 :])))
        at = [a // 8 for a in at]
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        ordered = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)) for r in groups[g]))
        trees[g] = ordered, *climb([x[2] for x in ordered])
    root, tops = climb([trees[g][1] for g in order])
    out = []
    for g, up in zip(order, tops):
        ordered, top, paths = trees[g]
        for (has, doc, digest), path in zip(ordered, paths):
            out.append((g, doc if has else None, digest, top, root, tuple(path + up)))
    return sorted(out, key=str)


def agree(docs):
    rows = docs.select(*manifest.FIELDS).collect()
    built = manifest.build(docs)
    got = built.withColumn("folded", manifest.folded(F.col("path"), F.col("leaf"))).collect()
    assert all(r.folded == r.root for r in got)
    plain = sorted(((r.lang, r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in got), key=str)
    assert plain == brute(rows)
    return built


def with_size(docs):
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def test_several_stored_levels(spark):
    """One group of 4,700 leaves crosses two stored levels; others end within one."""
    lang = F.when(F.col("id") < 4700, "en").when(F.col("id") < 5214, "de").when(F.col("id") < 5223, "fr").when(F.col("id") < 5224, "é")
    docs = spark.range(5230).select(F.col("id").alias("doc_id"), F.concat(F.lit("text\n"), F.col("id")).alias("text"), lang.alias("lang"), F.lit("s").alias("source"))
    agree(with_size(docs))


def test_many_groups(spark):
    """More groups than a run has nodes."""
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("l"), F.col("id") % 70).alias("lang"), F.lit(None).cast("string").alias("source"))
    agree(with_size(docs))


def test_hard_rows(spark, hard_docs):
    docs = with_size(hard_docs)
    for name in ("leaf", "path", "root", "tree", "pos", "width", "digest", "_key"):
        docs = docs.withColumn(name, F.lit("mine"))
    agree(docs)
    one = agree(docs.where("doc_id = 10"))
    assert [(r.leaf == r.root, r.path) for r in one.collect()] == [(True, [])]
    assert manifest.build(docs.limit(0)).count() == 0


def test_tampered_rows_are_found(spark):
    docs = with_size(spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")))
    other = manifest.leaf([F.lower(F.col(f)) if f == "text" else F.col(f) for f in manifest.FIELDS])
    built = manifest.build(docs, presented=F.when(F.col("doc_id") % 4 == 0, other))
    ok = {r.doc_id: r.ok for r in built.select("doc_id", (manifest.folded(F.col("path"), F.coalesce("presented", "leaf")) == F.col("root")).alias("ok")).collect()}
    assert ok == {i: i % 4 != 0 for i in range(40)}
