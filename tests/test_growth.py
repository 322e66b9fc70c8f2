"""Costly work per row is dealt out over the cores, however small the file, and what is landed isn't a file a page and task."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from varve.catalogue import base, catalog, landing, texts
from varve.functions import jsonld, text
from varve.operators import peers, textsearch
from varve.plans import rebuild
from varve.sources import landed


@pytest.fixture
def one_file(spark, tmp_path):
    rows = spark.range(1, 3001).select(F.col("id").alias("p_partkey"), F.lit("blue steel").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("promo").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"), (F.col("id") % 97 + 900.0).alias("p_retailprice"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("rows", [base.products, landing.parts, landing.items])
def test_rows_of_one_file_are_work_for_every_core(spark, one_file, rows):
    tasks = [n for (n,) in rows(spark, one_file).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).select("count(1)").collect()]
    assert len(tasks) >= 2 * spark.sparkContext.defaultParallelism and max(tasks) < 3 * sum(tasks) / len(tasks)


def test_blocks_of_a_page_are_found_once(spark):
    pages = spark.createDataFrame([("u", None)], "url string, html string")
    plan = landed.product_pages(pages, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(html") == 1


def test_landed_lines_are_as_many_files_as_tasks(spark, one_file):
    value = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("sku")))
    rows = landing.items(spark, one_file).select(value.alias("value"))
    path = landing.land_lines(rows, "lines")
    assert len(glob.glob(path.removeprefix("file://") + "/**/part-*", recursive=True)) <= rows.rdd.getNumPartitions()
    assert landed.details(spark, path).select("sku").distinct().count() == 3000
    before = set(glob.glob(path.removeprefix("file://").rsplit("/", 1)[0] + "/landed-*"))
    assert landing.src_details(spark, one_file).count() == 3000
    (new,) = set(glob.glob(path.removeprefix("file://").rsplit("/", 1)[0] + "/landed-*")) - before
    assert not glob.glob(f"{new}/page=*")


def test_a_title_is_folded_once_for_its_peer_key(spark):
    rows = spark.createDataFrame([("c", "Télé 55 po OLED", "lg")], "category string, title string, brand string")
    keyed = rows.select(peers.peer_key(F.col("category"), F.col("title"), F.col("brand")).alias("k"))
    assert keyed._jdf.queryExecution().optimizedPlan().toString().count("translate(title") <= 2  # for the key and for its type
    assert keyed.first().k == "c|t:tele|po:44-55|panel:oled"


def test_a_token_of_all_documents_is_dealt_out_over_the_files_of_an_index(spark, tmp_path):
    docs = spark.range(20_000).select("id", F.lit("écran bleu").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few, and would be put together
    try:
        index, stats = rebuild.write_text_index(docs, "id", ["text"], f"file://{tmp_path}/index")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = index.filter("token = 'bleu'").groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high")).orderBy("low").collect()
    assert sum(r.n for r in spans) == 20_000 and max(r.n for r in spans) < 15_000
    assert all(a.high < b.low for a, b in zip(spans, spans[1:], strict=False))
    assert tuple(stats.first()) == (20_000, 2.0)
    none, empty = rebuild.write_text_index(docs.limit(0), "id", ["text"], f"file://{tmp_path}/none")
    assert none.count() == 0 and tuple(empty.first()) == (0, None)


def test_tokens_are_made_once_and_counted_where_they_are_made(spark):
    docs = spark.createDataFrame([(1, "rouge rouge bleu"), (2, ""), (3, None)], "id long, text string")
    found = textsearch.entries(docs, "id", ["text"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("Exchange") == 1
    rows = {(r.doc, r.length, r.token, r.tf) for r in found.collect() if r.token}
    assert rows == {(1, 3, "rouge", 2), (1, 3, "bleu", 1)} and {r.doc for r in found.collect()} == {1, 2, 3}


def test_frequencies_of_tokens_count_documents_whose_ids_repeat_or_are_missing_once(spark):
    docs = spark.createDataFrame([(1, "rouge rouge bleu"), (2, "Rouge"), (2, "rouge vert"), (None, "vert"), (None, "vert bleu"), (3, None)], "id long, text string")
    assert {tuple(r) for r in textsearch.document_frequencies(docs, "id", ["text"]).collect()} == {("rouge", 2), ("bleu", 2), ("vert", 2)}


def test_items_are_made_once_for_the_rows_that_come_out_of_them(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id long, t string")
    found = text.unnested(rows, F.filter(F.split("t", " "), lambda x: x != ""), "item", "id")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {tuple(r) for r in found.collect()} == {(1, "a"), (1, "b")}


def test_a_pattern_of_a_peer_key_is_looked_for_once_and_not_once_a_band(spark):
    rows = spark.createDataFrame([("c", "Moniteur 27 po 144 Hz RTX 4070 1 To", "lg"), ("c", "Moniteur core i7 512 Go", "lg"), ("c", "Moniteur", "lg")], "category string, title string, brand string")
    keyed = rows.select(peers.peer_key(F.col("category"), F.col("title"), F.col("brand")).alias("k"))
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("inch)") == plan.count("\\s?hz") == 1
    assert [r.k for r in keyed.collect()] == ["c|t:moniteur|po:<=32|hz:165|gpu:4-7|sto:1to", "c|t:moniteur|cpu:7|sto:512", "c|t:moniteur"]


def test_statistics_are_made_once_for_scores_and_leaders(spark, one_file):
    spark.range(1, 301).select((F.col("id") % 60 + 1).alias("l_partkey"), F.expr("timestamp_ntz'2001-10-01' + make_dt_interval(id % 30)").alias("l_shipdate"), F.lit(10.0).alias("l_extendedprice"), F.lit(1.0).alias("l_quantity"), F.lit(0.1).alias("l_discount"), F.lit("F").alias("l_linestatus")).write.parquet(f"{one_file}/lineitem.parquet")
    scored = catalog.sco_score_all(spark, one_file)
    assert "Window" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.count() == scored.select("product_id").distinct().count() == sum(1 for k in range(1, 61) if k % 17)


def test_tokens_are_made_once_where_there_is_no_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Écran the THE bleu"), (2, "the écrans écran"), (2, "the other écran, twice"), (3, None), (4, "écran"), (None, "The écran")], "doc_id long, text string")
    rows = lambda found: sorted((str(r.doc), round(r.bm25, 9)) for r in found.collect())
    for raw in ("The écr", "écran", "nowhere", ""):
        want = textsearch.match(textsearch.postings(docs, "doc_id", ["text"]), textsearch.statistics(docs, ["text"]), raw)
        assert rows(textsearch.match_texts(docs, "doc_id", ["text"], raw)) == rows(want)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert "split(" not in texts.txt_bm25(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_and_numbers_of_layered_prices_are_made_once(spark):
    ld = '<script type="application/ld+json">{"@type": "Product", "offers": {"price": %s}}</script>'
    pages = [(ld % '"1,299.00"' + '<meta itemprop="price" content="7">', 1299.0), (ld % "2" + '<meta itemprop="price" content="70">', 70.0), ('<meta content="80" itemprop="price">', 80.0), ('<meta property="og:price:amount" content="90,50">', 90.5), ('<meta itemprop="price" content="1"><meta content="80" itemprop="price">', None), ('{"price":"10"} {"price":99} {"price":"40,5"} {"price":1}', 40.5), ("", None), (None, None)]
    rows = spark.createDataFrame(pages, "html string, want double").select("want", jsonld.layered_price(F.col("html")).alias("price"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<script") == 1 and plan.count("itemprop") == 2  # before and after
    assert all(r.price == r.want for r in rows.collect())
