"""Versioned state that a micro-batch changes where its keys are, and nowhere else.

The state lies in buckets by a hash of the key. A version is a manifest: for each bucket the folder that holds it, which
may have been written many versions ago. A merge reads the buckets of its batch's keys, writes those anew, and then
puts the next manifest in place by one rename. A crash before the rename leaves the version before, and the batch that
comes again writes over what it left; one that comes again after the rename changes nothing. Folders that the last
KEPT manifests don't name are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from varve.operators import ingest
from varve.staging import put_file, read_file

BUCKETS, KEPT = 64, 2


class KeyedState:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: list[str], buckets: int = BUCKETS):
        """The number of buckets is the first manifest's from then on."""
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        have = self.manifest()
        self.buckets = have["buckets"] if have else buckets

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        at = self._path("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """version, buckets and folders (bucket: folder) of a version, the last one if none is named."""
        known = self.versions()
        if not known:
            return None
        return json.loads(read_file(self.spark, f"{self.root}/manifests/{known[-1] if version is None else version}.json"))

    @property
    def version(self) -> int:
        return (self.versions() or [-1])[-1]

    def bucket(self):
        return F.pmod(F.xxhash64(*(F.col(k) for k in self.key)), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The state of a version, or its buckets in `only`."""
        have = self.manifest(version)
        folders = {int(b): f for b, f in have["folders"].items()} if have else {}
        paths = sorted(f"{self.root}/{f}" for b, f in folders.items() if only is None or b in only)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> list[int]:
        """Make a version of which the batch's buckets hold change(their state, batch); gives those buckets. version: the batch's
        number, by which one that comes again is known."""
        now = self.version
        version = now + 1 if version is None else version
        if version <= now:
            return []
        touched = sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())  # `buckets` numbers at most
        have = self.manifest()
        folders = dict(have["folders"]) if have else {}
        if touched:
            rows = change(self.read(only=touched), batch)
            data = f"data/{version}"
            rows.withColumn("_bucket", self.bucket()).repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/{data}")
            written = {s.getPath().getName() for s in self._fs.listStatus(self._path(data))}
            for b in touched:
                folders.pop(str(b), None)
                if f"_bucket={b}" in written:
                    folders[str(b)] = f"{data}/_bucket={b}"
        self._put({"version": version, "buckets": self.buckets, "folders": folders})
        self.clean()
        return touched

    def _put(self, manifest: dict) -> None:
        put_file(self.spark, f"{self.root}/manifests/{manifest['version']}.json", json.dumps(manifest))

    def clean(self, keep: int = KEPT) -> list[str]:
        """Remove manifests but the last `keep`, and folders that none of those names."""
        known = self.versions()
        live = {f for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in known[:-keep]:
            self._fs.delete(self._path("manifests", f"{v}.json"), False)
        gone = []
        for s in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            v = s.getPath().getName()
            if v.isdigit() and int(v) > known[-1]:
                continue  # of a merge that isn't done
            for b in self._fs.listStatus(s.getPath()):
                name = f"data/{v}/{b.getPath().getName()}"
                if b.isDirectory() and name not in live:
                    self._fs.delete(b.getPath(), True)
                    gone.append(name)
            if not any(f.startswith(f"data/{v}/") for f in live):
                self._fs.delete(s.getPath(), True)
        return gone


def merger(root: str, points_root: str, state_schema: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: upsert a batch of listings into the keyed state; its price points are written before the state moves on."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        state = KeyedState(batch.sparkSession, root, state_schema, ingest.KEY, buckets)
        if state.version >= batch_id:
            return
        rows = ingest.clean(batch).persist()
        try:

            def change(part: DataFrame, news: DataFrame) -> DataFrame:
                ingest.points_of(part, news).write.mode("overwrite").parquet(f"{points_root}/batch={batch_id}")
                return ingest.upsert(part, news)

            state.merge(rows, change, batch_id)
        finally:
            rows.unpersist()

    return merge


def merge_batches(stream: DataFrame, root: str, points_root: str, checkpoint: str, state_schema: str, every: str | None = "45 seconds", buckets: int = BUCKETS) -> StreamingQuery:
    """Upsert a listing stream into the keyed state, every so often; `every` None takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(merger(root, points_root, state_schema, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
