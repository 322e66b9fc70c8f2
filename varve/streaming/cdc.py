"""Change-only price points from a stream of observations, keyed by product.

changes() keeps one small state per key (the last price, list price and stock), so that every observation is
compared with the one before it across micro-batches; merge_batches() upserts micro-batches into a versioned
Parquet state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from varve.functions.prices import EPSILON
from varve.operators import ingest

OUT = "key string, observed_at timestamp, price double, list_price double, in_stock boolean"
STATE = "at timestamp, price double, list_price double, in_stock boolean"


def _none(x):
    return None if x is None or x != x else x


def _near(a, b) -> bool:
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < EPSILON)


def _changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key's rows of a micro-batch come in several frames that aren't in order of time: all are sorted before any is compared."""
    last = state.get if state.exists else None
    columns = ["observed_at", "price", "list_price", "in_stock"]
    rows = []
    for at, price, list_price, stock in pd.concat([f[columns] for f in frames]).sort_values(["observed_at", "price"]).itertuples(index=False):
        now = (at, _none(price), _none(list_price), None if stock is None or stock != stock else bool(stock))
        if last is not None and now[0] < last[0]:
            continue  # older than what was known before this micro-batch
        if last is None or not _near(last[1], now[1]) or not _near(last[2], now[2]) or last[3] != now[3]:
            rows.append((key[0], *now))
            last = now
        else:
            last = (now[0], *last[1:])
    if last is not None:
        state.update(last)
    yield pd.DataFrame(rows, columns=["key", *columns])


def changes(observations: DataFrame, key: str = "key") -> DataFrame:
    """A stream (or a batch) of key, observed_at, price, list_price, in_stock as its changes only. Rows that are
    older than one of their key in an earlier micro-batch are left out. A task holds one key's rows of a micro-batch at a time."""
    rows = observations.select(F.col(key).cast("string").alias("key"), F.col("observed_at").cast("timestamp").alias("observed_at"), "price", "list_price", "in_stock")
    return rows.groupBy("key").applyInPandasWithState(_changed, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def listing_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def latest(root: str, spark: SparkSession) -> tuple[int, str | None]:
    """The last complete version of the state and its path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return -1, None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [int(n[1:]) for n in names if n.startswith("v") and fs.exists(hadoop.Path(f"{root}/{n}/_SUCCESS"))]
    return (max(done), f"{root}/v{max(done)}") if done else (-1, None)


def merger(root: str, points_root: str, state_schema) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: version n of the state is version n - 1 merged with batch n; a batch that comes again writes
    the same paths again."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version, path = latest(root, spark)
        if version >= batch_id:  # a replay: start from the version before
            path = f"{root}/v{batch_id - 1}" if batch_id > 0 else None
        state = spark.read.schema(state_schema).parquet(path) if path else spark.createDataFrame([], state_schema)
        rows = ingest.clean(batch)
        ingest.points_of(state, rows).write.mode("overwrite").parquet(f"{points_root}/batch={batch_id}")
        ingest.upsert(state, rows).write.mode("overwrite").parquet(f"{root}/v{batch_id}")

    return merge


def merge_batches(stream: DataFrame, root: str, points_root: str, checkpoint: str, state_schema, every: str | None = "45 seconds") -> StreamingQuery:
    """Upsert a listing stream into the versioned state, every so often; `every` None takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(merger(root, points_root, state_schema)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_prices(observations: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Lowest, highest and number of observations per key and window, with a watermark for late rows."""
    return observations.withWatermark("observed_at", late).groupBy(F.window("observed_at", width), "key").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count(F.lit(1)).alias("n"))
