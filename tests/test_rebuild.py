"""Written tables: scores, specifications and compacted files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from varve.operators import ingest, specs
from varve.plans import readmodel, rebuild


def files(spark, path):
    return spark.read.parquet(path).select("_metadata.file_path").distinct().count()


def test_scores_replace_and_deactivate(spark, tmp_path):
    kind = "product_id long, category string, score double, is_active boolean"
    before = spark.createDataFrame([(1, "a", 5.0, True), (2, "b", 6.0, True), (3, None, None, None)], kind)
    scored = spark.createDataFrame([(2, "b", 7.0, True), (4, None, 1.0, True)], kind)
    got = {r.product_id: (r.category, r.score, r.is_active) for r in rebuild.write_scores(before, scored, str(tmp_path / "s")).collect()}
    assert got == {1: ("a", 5.0, False), 2: ("b", 7.0, True), 3: (None, None, False), 4: (None, 1.0, True)}
    assert rebuild.write_scores(before.limit(0), scored.limit(0), str(tmp_path / "e")).count() == 0


def test_distributions_are_those_of_the_extracted_rows(spark, tmp_path):
    items = spark.range(120).select(F.col("id").alias("product_id"), F.concat(F.lit("TV "), (F.col("id") % 40 + 30).cast("string"), F.lit(" po 120 Hz")).alias("title"), F.lit("televiseurs").alias("category"))
    rows = specs.extract(items, description=None)
    index, shares = rebuild.write_specs(rows, str(tmp_path / "t"))
    assert index.count() == rows.count() > 0 and shares.count() > 0
    assert sorted(map(tuple, shares.collect())) == sorted(map(tuple, specs.distributions(rows).collect()))


def test_compaction_merges_small_files_only(spark, tmp_path):
    many, one = str(tmp_path / "many"), str(tmp_path / "one")
    spark.range(1000).repartition(12).write.parquet(many)
    out = rebuild.compacted(spark, many, one)
    assert files(spark, many) == 12 and files(spark, one) == 1 and out.count() == 1000 and out.agg(F.sum("id")).first()[0] == 499_500
    assert rebuild.compacted(spark, many, str(tmp_path / "no"), file_bytes=64).inputFiles() == spark.read.parquet(many).inputFiles()
    spark.range(0).write.parquet(str(tmp_path / "empty"))
    assert rebuild.compacted(spark, str(tmp_path / "empty"), str(tmp_path / "none")).count() == 0


def test_compaction_keeps_the_order_of_rows(spark, tmp_path):
    """Forty sorted files, one of them large, become a few that overlap no more than they did; the large one stays."""
    source = str(tmp_path / "sorted")
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 40_000 >= 20_000, F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit(None).cast("int").alias("_none"))
    rows.repartitionByRange(40, "id").sortWithinPartitions("id").write.parquet(source)
    sizes = [size for _, size in rebuild._files(spark.read.parquet(source))]
    for file_bytes in (sum(sizes) // 4, max(sizes)):
        out = rebuild.compacted(spark, source, str(tmp_path / f"out-{file_bytes}"), file_bytes)
        span = out.groupBy(F.input_file_name().alias("f")).agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("low").collect()
        assert 1 < len(span) < 40 and all(a.high < b.low for a, b in zip(span, span[1:]))
        assert out.columns == rows.columns and out.exceptAll(rows).isEmpty() and rows.exceptAll(out).isEmpty()
        for f in out.inputFiles():
            inside = [r.id for r in spark.read.parquet(f).coalesce(1).collect()]
            assert inside == sorted(inside)
    assert rebuild.bins([5, 1, 1, 9, 4, 4, 4], 8) == [[0, 1, 2], [3], [4, 5], [6]]


def test_a_plan_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x)

    scored = spark.range(200).repartition(4).select(F.col("id").alias("product_id"), F.lit("c").alias("category"), counted("id").alias("score"), F.lit(True).alias("is_active"))
    assert rebuild.write_scores(scored.limit(0), scored, str(tmp_path / "s")).count() == 200 and seen.value == 200
    found = scored.select("product_id", "category", F.lit("f").alias("family"), F.lit("l").alias("label"), F.lit("v").alias("value"), F.col("score").alias("metric"), F.lit("u").alias("unit"), F.lit(1).alias("rank"), F.lit(2).alias("scale"), F.lit(False).alias("lower"))
    rebuild.write_specs(found, str(tmp_path / "t"))
    assert seen.value == 400


def test_a_snapshot_that_lost_rows_is_refused(spark):
    ingest.guard(spark.range(10), spark.range(8), 5, 5)
    with pytest.raises(ValueError, match="products fell"):
        ingest.guard(spark.range(10), spark.range(7), 5, 5)
    with pytest.raises(ValueError, match="price points fell"):
        ingest.guard(spark.range(10), spark.range(10), 5, 4)


def test_sections_of_the_first_page_are_cut_before_they_are_dealt_out(spark):
    kind = "product_id long, score double, confidence double, price double, condition string, is_lowest_ever boolean, is_active boolean, is_variant_lead boolean"
    deals = spark.createDataFrame([(k, float(k % 90), 0.6, 1.0, "new" if k % 3 else "used", k % 2 == 0, True, True) for k in range(400)], kind)
    got = readmodel.home_sections(deals)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.section, r["count"]) for r in got.groupBy("section").count().collect()} == set(readmodel.HOME_LIMITS.items())
    assert {r["count"] for r in readmodel.home_sections(deals, 3).groupBy("section").count().collect()} == {3}
