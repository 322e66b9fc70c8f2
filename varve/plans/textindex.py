"""The text index kept up to date: segments that never change, marks of what has left them, and merges.

A segment has the postings of the documents of one update, sorted by token, and their lengths. An update writes a segment for
what is new or changed, and marks those documents as gone from all older segments; a removal writes marks alone. A manifest,
put in place last, names segments and marks, and has the number and length of documents of each, so that statistics are
sums and not scans. Where FANOUT segments are of one size class, they are merged into one without what is gone, as the
next version; marks that no older segment needs are dropped.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.operators import textsearch
from varve.staging import put_file, read_file, stage

#: Segments of one size class that are merged; how much larger the documents of the next class are.
FANOUT = 4
POSTINGS = "doc {id}, length int, token string, tf long"


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, id_type: str = "bigint"):
        self.spark, self.root, self.id_type = spark, root.rstrip("/"), id_type

    def _there(self, path: str) -> bool:
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(there)

    def manifest(self) -> dict:
        """version; segments: name, version, docs, length; marks: name, version, docs, length."""
        path = f"{self.root}/manifest.json"
        return json.loads(read_file(self.spark, path)) if self._there(path) else {"version": 0, "segments": [], "marks": []}

    def _read(self, name: str, part: str, kind: str) -> DataFrame:
        return self.spark.read.schema(kind.format(id=self.id_type)).parquet(f"{self.root}/{name}/{part}")

    def _union(self, entries: list[dict], part: str, kind: str) -> DataFrame:
        """The rows of all entries, each with the version it is of."""
        found = None
        for x in entries:
            rows = self._read(x["name"], part, kind).withColumn("version", F.lit(x["version"]))
            found = rows if found is None else found.unionByName(rows)
        return self.spark.createDataFrame([], f"{kind.format(id=self.id_type)}, version int") if found is None else found

    def _live(self, rows: DataFrame, marks: list[dict]) -> DataFrame:
        """rows (doc, version) that no later mark names."""
        if not marks:
            return rows
        gone = self._union(marks, "docs", "doc {id}").groupBy("doc").agg(F.max("version").alias("gone"))
        return rows.join(gone, "doc", "left").filter(F.col("gone").isNull() | (F.col("gone") <= F.col("version"))).drop("gone")

    def postings(self) -> DataFrame:
        """doc, length, token, tf of all documents, as textsearch.match takes them: a filter by token reaches every segment's
        files, which are sorted by it."""
        have = self.manifest()
        return self._live(self._union(have["segments"], "postings", POSTINGS), have["marks"]).drop("version")

    def statistics(self) -> DataFrame:
        """One row: n and mean_length, from the sums that the manifest has."""
        have = self.manifest()
        n, length = (sum(x[k] for x in have["segments"]) - sum(x[k] for x in have["marks"]) for k in ("docs", "length"))
        return self.spark.createDataFrame([(n, length / n if n else None)], "n long, mean_length double")

    def match(self, raw: str) -> DataFrame:
        return textsearch.match(self.postings(), self.statistics(), raw)

    def _put(self, have: dict) -> None:
        put_file(self.spark, f"{self.root}/manifest.json", json.dumps(have))

    def _sums(self, lengths: DataFrame) -> dict:
        docs, length = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return {"docs": docs, "length": length}

    def _mark(self, have: dict, ids: DataFrame) -> dict | None:
        """Marks for those of the ids that segments have; what they take away is what of them was live."""
        lengths = self._live(self._union(have["segments"], "lengths", "doc {id}, length int"), have["marks"])
        gone = stage(lengths.join(ids.distinct(), "doc", "left_semi").select("doc", "length"), "gone")
        sums = self._sums(gone)
        if not sums["docs"]:
            return None
        name = f"marks-{uuid.uuid4().hex}"
        gone.select("doc").write.parquet(f"{self.root}/{name}/docs")
        return {"name": name, "version": have["version"] + 1, **sums}

    def _segment(self, postings: DataFrame, lengths: DataFrame, version: int) -> dict:
        name = f"segment-{uuid.uuid4().hex}"
        textsearch.write_index(postings.select("doc", "length", "token", "tf"), f"{self.root}/{name}/postings")
        lengths.select("doc", "length").write.parquet(f"{self.root}/{name}/lengths")
        return {"name": name, "version": version, **self._sums(self._read(name, "lengths", "doc {id}, length int"))}

    def update(self, docs: DataFrame, doc: str, columns: list[str]) -> None:
        """Enter documents, or enter them anew; of rows with one id the index has the postings of all, so ids should be without repeats. Rows without id
        aren't entered."""
        have = self.manifest()
        entered = docs.filter(F.col(doc).isNotNull()).withColumn(doc, F.col(doc).cast(self.id_type))
        found = stage(textsearch.entries(entered, doc, columns), "postings")  # dealing out by range reads its input twice
        lengths = found.groupBy("doc").agg(F.max("length").alias("length"))
        mark = self._mark(have, lengths.select("doc"))
        segment = self._segment(found.filter("token is not null"), lengths, have["version"] + 1)
        self._put({"version": have["version"] + 1, "segments": have["segments"] + [segment] * bool(segment["docs"]), "marks": have["marks"] + [mark] * bool(mark)})
        self.merge()

    def remove(self, ids: DataFrame) -> None:
        """Take out the documents with these ids (doc)."""
        have = self.manifest()
        if mark := self._mark(have, ids.select(F.col("doc").cast(self.id_type).alias("doc"))):
            self._put({"version": mark["version"], "segments": have["segments"], "marks": have["marks"] + [mark]})

    def merge(self) -> bool:
        """Merge the segments of the smallest size class that has FANOUT of them."""
        have = self.manifest()
        classes = defaultdict(list)
        for s in have["segments"]:
            classes[s["docs"].bit_length() // 2].append(s)  # a class has up to four times the documents of the one before
        full = next((classes[k] for k in sorted(classes) if len(classes[k]) >= FANOUT), None)
        if full is None:
            return False
        version = have["version"] + 1
        # a mark takes a document from one segment alone, the one in which it was live: merging these settles what marks took from them
        postings = self._live(self._union(full, "postings", POSTINGS), have["marks"])
        lengths = self._live(self._union(full, "lengths", "doc {id}, length int"), have["marks"])
        segment = self._segment(postings, lengths, version)
        rest = [s for s in have["segments"] if s not in full]
        marks = []
        for m in have["marks"]:
            older = [s for s in rest if s["version"] < m["version"]]
            if not older:
                continue
            # what the mark still takes from the segments that stay
            ids = self._read(m["name"], "docs", "doc {id}")
            before = [x for x in have["marks"] if x["version"] < m["version"]]
            taken = self._live(self._union(older, "lengths", "doc {id}, length int"), before).join(ids, "doc", "left_semi")
            marks.append({**m, **self._sums(taken)})
        self._put({"version": version, "segments": rest + [segment], "marks": [m for m in marks if m["docs"]]})
        return True
