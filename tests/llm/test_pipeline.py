from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import compression_classifier, line_dedup, mixing, simhash
from ledgerlens.llm.queries import oracle_sql, queries
from tests.compare import duck_rows, spark_rows
from tests.llm.cases import documents, words


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mix", "encode"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf_dir).persist())
    _, good, lines, single, mixed, ids = seen
    assert all(x.columns == docs.columns for x in seen[:-1])
    scores = compression_classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert good.count() == scores.filter("predicted = 1").count() < docs.count()
    assert lines.count() == good.count() and line_dedup.removed_lines(lines.filter("text <> ''")).filter("not near").count() == 0
    groups = simhash.near_duplicates(lines).select("component_id").distinct().count()
    assert single.count() == groups < lines.count()
    total = sum(len(words(r.text)) for r in single.collect())
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - 1.5 * total) <= 30
    assert ids.count() == mixed.count() and ids.columns == ["doc_id", "ids", "decoded"]


def test_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda r: repr(tuple(r))
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=key) == sorted(docs.collect(), key=key)


def test_stages_bear_odd_documents(spark, sf_dir):
    for docs in (documents(spark), documents(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert name == "encode" or len(docs.columns) == 11


def test_queries_equal_their_sql(spark, sf_dir):
    found = queries()
    for name, sql in oracle_sql().items():
        names, want = duck_rows(sql, sf_dir)
        got = spark_rows(found[name](spark, sf_dir).select(*names))
        assert got == (names, want), name


def test_very_many_equal_rows_without_an_id(spark):
    """A hundred thousand rows that are equal in all but a few: each stage takes them whole."""
    n = 100_000
    rows = spark.range(n, numPartitions=8).selectExpr("cast(null as bigint) as doc_id", "'the same few words of one text' as text", "'en' as lang", "cast(null as string) as source", "id % 3 as n_chars")
    rows = rows.unionByName(spark.range(200).selectExpr("id as doc_id", "concat('text ', id, ' of ', id * 7919, ' and ', sha2(cast(id as string), 256)) as text", "'en' as lang", "'s' as source", "1L as n_chars"))
    mixed = mixing.mixed_documents(rows).persist()
    plan = {(r.doc_id, r.size): r for r in mixing.mixture(rows).groupBy("doc_id", "size").agg(F.sum("taken").alias("taken")).collect()}
    assert mixed.filter("doc_id is null").select(F.sum(F.size(F.split("text", " ")))).first()[0] == plan[None, 7].taken
    assert mixed.columns == rows.columns and mixed.filter("doc_id is null").select("n_chars").distinct().count() >= 1
    assert {r.doc_id for r in mixed.filter("doc_id is not null").select("doc_id").distinct().collect()} == {i for i, size in plan if i is not None and plan[i, size].taken}
    mixed.unpersist()
    one = simhash.keep_one(rows)
    assert one.filter("doc_id is null").count() == 1 and one.columns == rows.columns
    groups = simhash.near_duplicates(rows).select("component_id").distinct().count()
    assert one.count() == groups
    assert line_dedup.without_repeats(rows).count() == n + 200


def test_rows_that_stay_are_not_shuffled(spark):
    """Beyond the few that go, texts pass the near-duplicate stage without an exchange."""
    rows = spark.range(400).selectExpr("id as doc_id", "concat(sha2(cast(id as string), 256), ' ', sha2(cast(id + 1e6 as string), 256), ' x ', id) as text", "1 as rank")
    rows = rows.union(rows.filter("doc_id % 50 = 0").selectExpr("doc_id + 1000", "text", "rank")).union(rows.filter("doc_id = 7"))
    one = simhash.keep_one(rows)
    assert sorted(r.doc_id for r in one.collect()) == [*range(400)] and one.filter("doc_id = 7").count() == 1
    simple = simhash.keep_one(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in simple and "Window" not in simple
