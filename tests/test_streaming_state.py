from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from varve.streaming import cdc, ordered

T0 = datetime(2024, 1, 1)
KIND = "key string, observed_at timestamp, price double, list_price double, in_stock boolean"


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, source, out, late, forget=None):
    stream = cdc.listing_stream(spark, str(source), KIND)
    query = ordered.ordered_changes(stream, late, forget_days=forget).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    assert query.awaitTermination(200)


def changes(rows, until):
    """Brute force over one key's rows up to a time."""
    out, last = [], None
    for at, *now in sorted((r for r in rows if r[0] <= until), key=lambda r: r[:2]):
        same = lambda a, b: a is None and b is None or a is not None and b is not None and abs(a - b) < 0.005
        if last is None or not same(now[0], last[0]) or not same(now[1], last[1]) or now[2] != last[2]:
            out.append((at, *now))
            last = now
    return out


def test_answers_do_not_depend_on_the_order_of_files(store, tmp_path, monkeypatch):
    """Rows up to three hours late, in four files that are read one run after the other (a restart each), in two orders."""
    rng = random.Random(1)
    rows = [(k, T0 + timedelta(minutes=15 * i), float(rng.randrange(3)), rng.choice([None, 9.0]), rng.choice([True, None])) for k in "abc" for i in range(60)]
    waves = [[] for _ in range(4)]
    for r in rows:
        slot = int((r[1] - T0) / timedelta(hours=3))
        waves[min(3, max(0, slot - 1 + rng.randrange(2)) // 2 + rng.randrange(2))].append(r)
    got = []
    for name, order in (("one", waves), ("two", [list(reversed(w)) for w in (waves[1], waves[0], waves[3], waves[2])])):
        source = tmp_path / name
        source.mkdir()
        for k, wave in enumerate([*order, [("z", T0 + timedelta(days=3), 1.0, None, True)]]):
            (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("key", "observed_at", "price", "list_price", "in_stock"), (r[0], r[1].isoformat(), *r[2:])))) for r in wave))
            run(store, source, str(tmp_path / f"{name}-out"), "24 hours")
        read = store.read.schema(ordered.OUT).parquet(str(tmp_path / f"{name}-out/rows")).collect()
        got.append({k: sorted((r.observed_at, r.price, r.list_price, r.in_stock) for r in read if r.key == k) for k in "abcz"})
    assert got[0] == got[1]
    assert {k: got[0][k] for k in "abc"} == {k: sorted(changes([r[1:] for r in rows if r[0] == k], T0 + timedelta(days=9))) for k in "abc"}
    assert got[0]["z"] == []  # still waiting


def test_forgotten_keys_start_anew(store, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, (key, days) in enumerate([("a", 0), ("b", 3), ("b", 20), ("a", 21), ("c", 40), ("c", 60)]):
        (source / f"{k}.json").write_text(json.dumps({"key": key, "observed_at": (T0 + timedelta(days=days)).isoformat(), "price": 5.0}))
        run(store, source, str(tmp_path / "out"), "1 day", 10)
    got = sorted((r.key, (r.observed_at - T0).days) for r in store.read.schema(ordered.OUT).parquet(str(tmp_path / "out/rows")).collect())
    assert got == [("a", 0), ("a", 21), ("b", 3), ("b", 20), ("c", 40)]


def test_changes_of_many_rows_go_stretch_by_stretch():
    """Each stretch goes on from the last row of the one before."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"at": np.arange(9000), "price": np.round(rng.random(9000) * 0.02, 3), "list_price": np.where(rng.random(9000) < 0.2, np.nan, 7.0), "in_stock": rng.choice(np.array([True, False, None], object), 9000)})
    one, last = ordered.changed(rows, None)
    parts, carried = [], None
    for k in range(0, 9000, 700):
        part, carried = ordered.changed(rows[k : k + 700], carried)
        parts.append(part)
    assert pd.concat(parts).equals(one) and carried == last
    none = lambda v: None if v is None or v != v else v
    brute = changes([(r.at, none(r.price), none(r.list_price), none(r.in_stock)) for r in rows.itertuples()], 1 << 40)
    assert one["at"].tolist() == [b[0] for b in brute]


class Kept:
    """A list state or value state in memory, with a handle's timers."""

    def __init__(self):
        self.values, self.timers, self.states = [], set(), {}

    def getListState(self, name, kind):
        return self.states.setdefault(name, Kept())

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def exists(self):
        return bool(self.values)

    def get(self):
        return self.values[0] if self.values and isinstance(self.values[0][0], int) else iter(list(self.values))

    def update(self, value):
        self.values = [value]

    def put(self, values):
        self.values = list(values)

    def appendList(self, values):
        self.values += values

    def clear(self):
        self.values = []

    def getCurrentWatermarkInMs(self):
        return self.watermark


def drifting(seed, n, keys):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"key": rng.choice(keys, n), "at": rng.permutation(n) * 1000, "price": np.round(rng.random(n) * 0.02, 3), "list_price": np.where(rng.random(n) < 0.2, np.nan, 7.0), "in_stock": rng.choice([0.0, 1.0, np.nan], n, p=[0.1, 0.8, 0.1])})


@pytest.mark.parametrize("forget", [None, 30_000])
def test_many_keys_at_once_are_as_each_alone(forget):
    """Steps smaller than EPSILON add up, so that some keys go from change to change."""
    keys = np.array(["a", "b", "c", None, "lone"], object)
    rows = drifting(5, 4000, keys[:4])
    rows.loc[len(rows)] = ["lone", 5, 1.0, np.nan, 1.0]
    last, got = ordered.ROW.empty_table().to_pandas(), []
    for part in (rows[rows["at"] < 1_500_000], rows[rows["at"] >= 1_500_000]):
        out, last = ordered.changed_of_keys(part, last, forget)
        got.append(out)
    got, flags = pd.concat(got), {0.0: False, 1.0: True}
    for key in keys:
        mine = rows[rows["key"].isna() if key is None else rows["key"] == key].sort_values(["at"], ignore_index=True)
        want, end = ordered.changed(mine.assign(in_stock=mine["in_stock"].map(flags).astype(object)), None, forget)
        out = got[got["key"].isna() if key is None else got["key"] == key]
        assert out["at"].tolist() == want["at"].tolist() and (key == "lone" or 1 < len(out) < len(mine))
        row = last[last["key"].isna() if key is None else last["key"] == key]
        assert row["at"].tolist() == [end[0]] and np.isclose(row["price"].iloc[0], end[1])


def test_state_is_written_in_chunks_of_rows_and_not_row_by_row(monkeypatch):
    monkeypatch.setattr(ordered, "STRETCH", 500)
    processor, handle, rows = ordered.OrderedChanges(None), Kept(), drifting(7, 3000, np.array(["a", "b", "c"], object))
    processor.init(handle)
    for part in (rows[:1000], rows[1000:]):
        assert list(processor.handleInputRows((1,), iter([part]), None)) == []
    assert len(handle.states["waiting_0"].values) == 2
    got = []
    for handle.watermark in (2000, 10_000):
        assert len(handle.timers) == 1 and handle.timers.pop() <= handle.watermark
        got += processor.handleExpiredTimer((1,), handle, None)
    assert len(got) >= 6 and not handle.timers and not handle.states["waiting_0"].values + handle.states["waiting_1"].values
    want, _ = ordered.changed_of_keys(rows, ordered.ROW.empty_table().to_pandas())
    assert sorted((r.key, r.observed_at.value // 1000) for out in got for r in out.itertuples()) == sorted(zip(want["key"], want["at"]))
