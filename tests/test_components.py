"""Links of listings, the wide row of a deal, verdicts in words, and guards of snapshots."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from varve.functions import links
from varve.operators import ingest, spec_rules, specs
from varve.plans import readmodel


@pytest.mark.parametrize("query, value, want", [
    ("brands=lg%2Csony&page=3&sort=price", "lg", "brands=sony&sort=price"), ("brands=lg&page=3", "lg", ""), ("", "lg", "brands=lg"), (None, "a b,", "brands=a+b%2C"),
    ("sort=a&sort=b&x=", "lg", "brands=lg&sort=b"), ("z=%zz&noise&q=a%3Db", "lg", "brands=lg&q=a%3Db"), ("brands=lg", None, "brands=lg"), ("brands=lg&brands=", "tcl", "brands=tcl"),
])
def test_a_value_of_a_link_is_switched(spark, query, value, want):
    row = spark.createDataFrame([(query, value)], "q string, v string")
    assert row.select(links.toggled(F.col("q"), "brands", F.col("v"))).first()[0] == want


def test_a_link_of_many_parameters_is_switched_in_time(spark):
    rows = spark.range(2000).select(F.concat_ws("&", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.concat(F.lit("p"), k.cast("string"), F.lit("="), (F.col("id") + k).cast("string")))).alias("q"), F.lit("lg").alias("v"))
    began = time.monotonic()
    got = rows.select(F.sum(F.length(links.toggled(F.concat("q", F.lit("&brands=lg%2Csony&p3=x")), "brands", F.col("v"))))).first()[0]
    assert got == sum(len("&".join([f"p{k}={'x' if k == 3 else i + k}" for k in range(30)] + ["brands=sony"])) for i in range(2000))
    assert time.monotonic() - began < 30


def test_ways_back_stay_on_the_site(spark):
    rows = spark.createDataFrame([(p,) for p in ("/a/b", "//x", "/\\x", "https://x", "", None, "/")], "p string")
    assert [r[0] for r in rows.select(links.safe_return_path(F.col("p"), "/home")).collect()] == ["/a/b", "/home", "/home", "/home", "/home", "/home", "/"]


def test_the_wide_row_has_each_tables_own_columns(spark):
    mine = {name: columns.split() for name, columns in readmodel.WIDE.items()}
    sold = spark.range(1, 4).select("id", F.col("id").alias("product_id"), F.when(F.col("id") < 3, "s").alias("store_id"), F.lit(9).alias("score"), *(F.lit("p").alias(c) for c in mine["products"] if c not in ("product_id", "store_id")))
    scores = spark.range(1, 4).select("id", F.col("id").alias("product_id"), F.lit("t").alias("title"), *(F.lit(7).alias(c) for c in mine["scores"]))
    stores = spark.createDataFrame([("s", "Shop", "#000", "u")], "store_id string, name string, color string, url string")
    known = spark.range(1, 2).select("id", F.col("id").alias("product_id"), F.lit("e").alias("title"), *(F.lit("e").alias(c) for c in mine["enrichment"]))
    got = {r.product_id: r for r in readmodel.wide_deals(scores, sold, stores, known).collect()}
    assert set(got) == {1, 2} and len(got[1]) == 35 and got[1].title == "p" and got[1].score == 7 and got[1].store_name == "Shop" and got[1].reviews == "e" and got[2].reviews is None
    assert readmodel.wide_deals(scores.limit(0), sold, stores, known).count() == 0


def test_verdicts_say_what_they_rest_on(spark):
    assert set(spec_rules.EFFECTS) == set(spec_rules.FAMILIES)
    kind = "product_id long, category string, family string, unit string, metric double, rank int, scale int, lower boolean"
    rows = [(1, "c", "reponse", "ms", 0.5, None, None, True), (2, "c", "wifi", None, None, 2, 3, False), (3, "c", "hdmi", None, None, 2, 2, False), (4, None, "other", None, None, None, None, False)]
    dist = spark.createDataFrame([("c", "reponse|ms", 40, 0.1, 0.2, 0.25, 0.3, 0.4)], "category string, metric_key string, n long, p10 double, p25 double, p50 double, p75 double, p90 double")
    got = {r.product_id: r for r in specs.explain(spark.createDataFrame(rows, kind), dist).collect()}
    assert got[1].basis == "Médiane de la catégorie : 0.25 ms (40 produits comparés)" and got[1].tier == "entree" and got[1].group == "image"
    assert got[2].basis == "Échelon 2 sur 3 de sa gamme" and got[3].basis == "Échelle technique établie" and got[4].basis is None and got[4].effect is None


def test_guards_report_without_raising(spark):
    verdict = lambda *n: ingest.guard_report(*map(spark.range, n)).first().verdict
    assert [verdict(10, 8, 5, 5), verdict(10, 7, 5, 9), verdict(10, 10, 5, 4), verdict(0, 0, 3, 0)] == ["ok", "products", "history", "first"]
    ingest.guard(spark.range(0), spark.range(0), 3, 0)
