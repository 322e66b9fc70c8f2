from __future__ import annotations

import json
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from varve import schema
from varve.streaming import cdc, keyed

from .test_ingest import listing

KIND = "store_id string, sku string, price double"


def put(state, news):
    """Prices of keys are replaced."""
    return state.join(news, ["store_id", "sku"], "left_anti").unionByName(news)


def keys(spark, root, buckets=64):
    return keyed.KeyedState(spark, root, KIND, ["store_id", "sku"], buckets)


def of(spark, rows):
    return spark.createDataFrame(rows, KIND)


def test_a_batch_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    root, rng = str(tmp_path / "state"), random.Random(4)
    state, want = keys(spark, root), {}
    rows = [("s", f"k{k}", float(k)) for k in range(400)]
    assert len(state.merge(of(spark, rows), put)) > 50
    want.update({r[1]: r[2] for r in rows})
    for v in range(4):
        sku = f"k{rng.randrange(500)}"
        want[sku] = 1000.0 + v
        touched = state.merge(of(spark, [("s", sku, want[sku])]), put)
        assert len(touched) == 1
        assert [n for n in os.listdir(f"{root}/data/{state.version}") if n.startswith("_bucket")] == [f"_bucket={touched[0]}"]
    assert {r.sku: r.price for r in state.read().collect()} == want
    assert state.versions() == [3, 4] and len(state.manifest()["folders"]) > 50
    assert keys(spark, root, 7).buckets == 64
    assert sum(len([n for n in os.listdir(f"{root}/data/{v}") if n.startswith("_bucket")]) for v in os.listdir(f"{root}/data")) <= len(state.manifest()["folders"]) + 1


def test_a_crash_before_the_manifest_leaves_the_version_before(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "state")
    state = keys(spark, root, 4)
    state.merge(of(spark, [("s", "a", 1.0), ("s", "b", 2.0)]), put, 0)

    def crash(self, manifest):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedState, "_put", crash)
        with pytest.raises(RuntimeError):
            state.merge(of(spark, [("s", "a", 9.0)]), put, 1)
    again = keys(spark, root, 4)
    assert again.version == 0 and {r.sku: r.price for r in again.read().collect()} == {"a": 1.0, "b": 2.0}
    assert again.merge(of(spark, [("s", "a", 9.0)]), put, 1)
    assert again.merge(of(spark, [("s", "a", 7.0)]), put, 1) == []
    assert {r.sku: r.price for r in again.read().collect()} == {"a": 9.0, "b": 2.0}
    assert {r.sku: r.price for r in again.read(0).collect()} == {"a": 1.0, "b": 2.0}


def test_emptied_buckets_and_empty_batches(spark, tmp_path):
    state = keys(spark, str(tmp_path / "state"), 4)
    assert state.merge(of(spark, []), put) == [] and state.read().count() == 0
    state.merge(of(spark, [("s", "a", 1.0), (None, None, 2.0)]), put)
    assert state.read().count() == 2
    state.merge(of(spark, [("s", "a", 1.0)]), lambda part, news: part.filter(F.lit(False)))
    assert [r.price for r in state.read().collect()] in ([2.0], [])


def test_streamed_upserts_into_keyed_state(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    root, points = str(tmp_path / "state"), str(tmp_path / "points")
    names = [n for n, _ in schema.columns(schema.LISTINGS)]
    for k, rows in enumerate(([listing("a", 10.0), listing("b", 3.0)], [listing("a", 9.0, 1, 1)])):
        lines = [json.dumps({n: v.isoformat() if isinstance(v, datetime) else v for n, v in zip(names, r) if v is not None}) for r in rows]
        (source / f"{k}.json").write_text("\n".join(lines))
        query = keyed.merge_batches(cdc.listing_stream(spark, str(source), schema.LISTINGS), root, points, str(tmp_path / "cp"), schema.PRODUCTS, every=None)
        assert query.awaitTermination(120)
    state = keyed.KeyedState(spark, root, schema.PRODUCTS, ["store_id", "sku"])
    assert state.version == 1 and {r.sku: r.price for r in state.read().collect()} == {"a": 9.0, "b": 3.0}
    assert spark.read.parquet(points).count() == 3
    keyed.merger(root, points, schema.PRODUCTS)(spark.createDataFrame([listing("a", 8.0, 1, 1)], schema.LISTINGS), 1)
    assert {r.sku: r.price for r in state.read().collect()} == {"a": 9.0, "b": 3.0} and spark.read.parquet(points).count() == 3
