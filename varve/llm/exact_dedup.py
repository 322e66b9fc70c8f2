"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest, adding up
before the shuffle; an anti-join against the index finds the digests that are new, and only those are appended; a
batch that is sent again after a failure adds nothing.

Rows: a null text counts as empty. Of equal texts in a batch the row with the largest doc_id is
entered (a null doc_id comes last); a text that the index knows keeps the row that entered it.
Repeated rows (same doc_id and text) are one entry. An empty batch changes nothing. Columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, fresh_path

#: A digest with more than one in HOT_SHARE of all rows is joined by broadcast: there are at most HOT_SHARE of them.
HOT_SHARE = 2000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and digest of each row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("digest"))


class DigestIndex:
    """digest, keep_id, group_size (rows of the batch that entered it) of all texts seen, kept at path. The number of
    buckets is written beside the data when the index is made and holds from then on, whatever the session's settings."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type
        self.buckets = self._stored_buckets()
        if self.buckets is None:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(self._layout)
        elif buckets not in (None, self.buckets):
            raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id {id_type}, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    @property
    def _layout(self) -> str:
        return f"{self.path}-layout"

    def _stored_buckets(self) -> int | None:
        try:
            return self.spark.read.schema("buckets int").parquet(self._layout).first()["buckets"]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def new_entries(self, batch: DataFrame) -> DataFrame:
        """One row for each digest of the batch (doc_id, digest) that the index lacks. The groups are written before
        they meet the index: else Spark would join, shuffle and sort the batch's rows and group them only then."""
        groups = cut(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
        return groups.join(self.entries().hint("merge"), "digest", "left_anti")

    def append(self, batch: DataFrame) -> None:
        """Enter the batch's new digests; every bucket gets one sorted file."""
        self._write(self.new_entries(batch))

    def _write(self, entries: DataFrame) -> None:
        dealt = entries.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def compacted(self, path: str) -> DigestIndex:
        """The same index at another path, with the files that the appends left of each bucket merged into one."""
        out = DigestIndex(self.spark, path, self.buckets, self.id_type)
        out._write(self.spark.read.schema(self.entries().schema).parquet(self.path))  # read as plain files, so that they are dealt out anew
        return out

    def forget(self) -> None:
        """Take the index out of the session's catalogue; its files stay, and so do plans that read them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def resolve(self, batch: DataFrame) -> DataFrame:
        """The batch with keep_id and group_size of each row. Digests with very many rows are joined by
        broadcast (at most HOT_SHARE of them, by the share that makes them hot), all others by sort-merge."""
        index = self.entries()
        total = index.agg(F.sum("group_size")).first()[0] or 0
        is_hot = F.col("group_size") * HOT_SHARE > max(total, HOT_SHARE * 100)
        hot = index.filter(is_hot)
        met = batch.join(F.broadcast(hot), "digest", "left")
        rest = met.filter(F.col("group_size").isNull()).select("doc_id", "digest").join(index.filter(~is_hot).hint("merge"), "digest")
        return met.filter(F.col("group_size").isNotNull()).unionByName(rest)


def classify(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Without an index, a new one is made."""
    batch = cut(digests(docs), "digests")
    found = index or _new_index(docs)
    found.append(batch)
    out = found.resolve(batch).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
    if index is None:
        found.forget()
    return out


def _new_index(docs: DataFrame) -> DigestIndex:
    return DigestIndex(docs.sparkSession, fresh_path(docs.sparkSession, "index"), id_type=dict(docs.dtypes)["doc_id"])


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row for each text, in docs' columns."""
    batch = cut(digests(docs), "digests")
    index = _new_index(docs)
    index.append(batch)
    kept = index.entries().select("keep_id", "digest")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("hash"))
    found = rows.join(kept, rows["id"].eqNullSafe(kept["keep_id"]) & (rows["hash"] == kept["digest"]), "left_semi")
    if not batch.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():  # rows that repeat whole
        found = found.dropDuplicates(["id", "hash"])
    out = found.select("doc.*")
    index.forget()
    return out
