from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from varve.catalogue import landing
from varve.sources import paged


def land(root, scope, lap, page, records):
    folder = root / f"scope={scope}" / f"lap={lap}" / f"page={page}"
    folder.mkdir(parents=True)
    for k in range(2):
        (folder / f"part-{k}.json").write_text("\n".join(json.dumps({"sku": f"{scope}-{lap}-{page}-{i}"}) for i in range(k, records, 2)) + "\n")
    (folder / "_SUCCESS").write_text("")


def run(spark, tmp_path, records, sizes, fail_at=None):
    def keep(batch, number):
        rows = [(json.loads(r.record)["sku"], r.scope, r.lap, r.page) for r in batch.collect()]
        sizes.append(len(rows))
        if fail_at is not None and len(sizes) == fail_at:
            raise RuntimeError("lost")
        (tmp_path / f"batch-{number}.json").write_text(json.dumps(rows))  # a batch that comes again writes the same file

    stream = paged.page_stream(spark, str(tmp_path / "in"), str(tmp_path / "cursor"), records)
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    except Exception:
        assert fail_at is not None
    finally:
        query.stop()


def seen(tmp_path):
    return Counter(r[0] for p in tmp_path.glob("batch-*.json") for r in json.loads(p.read_text()))


def test_pages_come_once_over_stops_failures_and_laps(spark, tmp_path):
    root, sizes = tmp_path / "in", []
    for scope, pages in (("a", 7), ("b", 3), ("c", 1)):
        for p in range(1, pages + 1):
            land(root, scope, 0, p, 10)
    run(spark, tmp_path, 25, sizes)
    assert sum(seen(tmp_path).values()) == 110 and set(seen(tmp_path).values()) == {1}
    assert max(sizes) <= 34 and len(sizes) >= 4
    for p in (1, 2):
        land(root, "b", 1, p, 10)
    land(root, "c", 0, 2, 10)
    land(root, "d%23 e", 0, 1, 70)  # a page larger than a batch
    more = []
    run(spark, tmp_path, 25, more, fail_at=2)  # the second batch is lost after it was planned
    run(spark, tmp_path, 25, more)
    assert sum(seen(tmp_path).values()) == 110 + 30 + 70 and set(seen(tmp_path).values()) == {1}
    got = {(r.scope, r.laps, r.next_page) for r in paged.cursors(spark, str(tmp_path / "cursor"), "s").collect()}
    assert got == {("a", 0, 8), ("b", 1, 3), ("c", 0, 3), ("d# e", 0, 2)}


def test_scopes_with_fewer_laps_come_first(tmp_path):
    root = tmp_path / "in"
    for scope, lap, page in (("a", 0, 1), ("a", 1, 1), ("a", 1, 2), ("b", 0, 1), ("b", 0, 2), ("b", 0, 3)):
        land(root, scope, lap, page, 10)
    reader = paged.PageReader({"path": str(root), "cursor": str(tmp_path / "cursor"), "records": "20"})
    start, order = reader.initialOffset(), []
    for _ in range(4):
        end = reader.latestOffset()
        assert end == reader.latestOffset()
        order.append([(p.scope, p.lap, p.page) for p in reader.partitions(start, end)])
        start = end
    assert order == [[("a", 0, 1), ("b", 0, 1)], [("b", 0, 2), ("b", 0, 3)], [("a", 1, 1), ("a", 1, 2)], []]
    assert paged.PageReader({"path": str(root), "cursor": str(tmp_path / "cursor")}).latestOffset() == start


def test_a_batch_of_many_pages_is_as_many_tasks_as_are_asked_for(tmp_path):
    root = tmp_path / "in"
    for p in range(1, 8):
        land(root, "a", 0, p, 3)
    reader = paged.PageReader({"path": str(root), "cursor": str(tmp_path / "cursor"), "records": "100", "tasks": "2"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    rows = [row for part in parts for row in reader.read(part)]
    assert len(parts) == 2 and len(rows) == len(set(rows)) == 21 and {r[2] for r in rows} == set(range(1, 8))


def drain(streams):
    try:
        for stream in streams:
            stream.processAllAvailable()
    finally:
        for stream in streams:
            stream.stop()


def test_pages_that_spark_lands_come_back_whole(spark, tmp_path):
    rows = [(scope, 0, page, json.dumps({"sku": f"{scope}-{page}-{i}", "text": "a\x85b\u2028c"}, ensure_ascii=False)) for scope in ("a/b", "ç #1", None) for page in range(1, 13) for i in range(5)]
    pages = spark.createDataFrame(rows, paged.SCHEMA)
    for half in (F.col("page") <= 2, F.col("page") > 2):
        paged.land(pages.filter(half), str(tmp_path / "in"))
    files = [p for p in (tmp_path / "in").rglob("*") if p.is_file()]
    assert len(files) == 36 and all(p.name.endswith(".json") and not p.name.startswith("_") for p in files)
    got, tasks = [], []

    def keep(batch, number):
        tasks.append(batch.rdd.getNumPartitions())
        got.extend(tuple(r) for r in batch.collect())

    drain([paged.page_stream(spark, str(tmp_path / "in"), str(tmp_path / "cursor"), 50).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()])
    assert Counter(got) == Counter((s or paged.NONE, *rest) for s, *rest in rows)
    assert len(tasks) >= 3 and set(tasks) == {1}  # few records are one task, whatever cores there are


def test_a_landing_that_fails_leaves_no_page(spark, tmp_path):
    fails = F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit("{}"))
    pages = spark.range(40).select(F.lit("a").alias("scope"), F.lit(0).alias("lap"), F.col("id").cast("int").alias("page"), F.lit("{}").alias("record"))
    paged.land(pages.filter("id < 5"), str(tmp_path / "in"))
    with pytest.raises(Exception, match="lost"):
        paged.land(pages.withColumn("id", F.col("page")).withColumn("record", fails.cast("string")), str(tmp_path / "in"))
    assert len([p for p in (tmp_path / "in").rglob("*") if p.is_file()]) == 5


def test_streams_side_by_side_share_the_scopes(spark, tmp_path):
    scopes, got = ["a", "b", "c", "d", "e"], [[], []]
    for scope in scopes:
        for p in range(1, 8):
            land(tmp_path / "in", scope, 0, p, 10)

    def stream(k):
        pages = paged.page_stream(spark, str(tmp_path / "in"), str(tmp_path / "cursor" / f"{k}"), 25, scopes[k::2])
        return pages.writeStream.foreachBatch(lambda batch, number: got[k].append(batch.collect())).option("checkpointLocation", str(tmp_path / "cp" / f"{k}")).start()

    drain([stream(0), stream(1)])
    land(tmp_path / "in", "d", 0, 8, 10)
    drain([stream(0), stream(1)])  # each goes on from its own cursor
    assert [{r.scope for batch in batches for r in batch} for batches in got] == [{"a", "c", "e"}, {"b", "d"}]
    assert all(len(batch) < 25 + 10 for batches in got for batch in batches)
    assert set(Counter(r.record for batches in got for batch in batches for r in batch).values()) == {1} and sum(len(b) for batches in got for b in batches) == 360
    at = {(r.scope, r.next_page) for r in paged.cursors(spark, str(tmp_path / "cursor" / "*"), "s").collect()}
    assert at == {("a", 8), ("b", 8), ("c", 8), ("d", 9), ("e", 8)}


def test_odd_brands_are_scopes_of_their_own(spark, tmp_path):
    brands = [None, "", "a/b%2F=c", "ü #1", "."]
    rows = [(i, "name\u2028of\x85it", brands[i % 5]) for i in range(123)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.scope, r.next_page, r.laps, r.records, r.pages, r.bounded) for r in landing.src_paged_stream(spark, str(tmp_path)).collect()}
    assert got == {(brand, 4, 0, n, 3, True) for brand, n in zip(brands, (25, 25, 25, 24, 24))}
