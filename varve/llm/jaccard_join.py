"""An exact n-gram Jaccard self-join by PartEnum signatures, and the components of its links.

Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of shingles (words lower-cased in A-Z only).
Sizes fall into bands such that a set links only with sets of its own band and of the two beside it; a set is in the
instance of its own band, and in the next one if sets there are small enough. What sets of one instance that link may
differ in is bounded. The domain of shingles is cut by hash into partitions of PARTS parts, so many that in one of them
at most SPARE parts hold differences; each choice of PARTS - SPARE parts in each partition gives a signature, a hash of
all the set's shingles there. Linked sets share one, always: nothing is missed.

Equal sets are one class, found by digest, so that copies never meet. In each bucket (signature) the classes are compared
with its smallest class, its pivot; those that aren't in the pivot's component then are compared in tiles of bounded
size, and a tile gives only the links that join components. Buckets with the same open members are compared once, and
buckets that share members as one where that is less work. All comparisons are on full sets.

Rows: null or empty texts and texts without words have no shingles and are linked with nothing. Rows without doc_id
are never linked. Rows that share a doc_id but not a text are separate classes under that id. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .near_dedup import _digest, _shingle_sets, connected_components
from .scratch import cut

SHINGLE, PERCENT = 3, 90
#: Parts of a partition, and how many of them may hold differences; steps from a size to its largest partner in a band.
PARTS, SPARE, STEPS = 3, 1, 3
#: Shingles that a block of a tile holds, about, and its classes at most.
BLOCK_SHINGLES, BLOCK_CLASSES = 1 << 19, 256
#: Digests that a task remembers, so that it makes the signatures of equal sets once.
REMEMBERED = 1 << 20


@lru_cache(64)
def bands(percent: int, most: int) -> np.ndarray:
    """The largest size of each band, up to the band above the one that holds `most`. A set's largest partners are in its own band or
    the next one; bands of several steps spare most sets the second."""
    tops = [0, 0]
    while tops[-2] < most:
        top = tops[-1] + 1
        for _ in range(STEPS):
            top = top * 100 // percent
        tops.append(top)
    return np.array(tops[1:], np.int64)


def differing(percent: int, a: int, b: int) -> int:
    """The most shingles that are in only one of two linked sets of up to a and b."""
    return (a + b) * (100 - percent) // (100 + percent)


def instances(size: int, percent: int) -> list[tuple[int, int]]:
    """instance and number of partitions, for the bands where a set of this size has signatures: its own, and the next if sets
    there may link with it. Where no differences are allowed, only equal sets link."""
    tops = bands(percent, 1 << max(size, 1).bit_length())
    band = int(np.searchsorted(tops, size))
    out = []
    for instance in range(band, band + 1 + (size * 100 // percent > tops[band])):
        k = differing(percent, int(tops[instance]), int(tops[instance]))
        if k:
            out.append((instance, -(-(k + 1) // (SPARE + 1))))
    return out


_CHOICES = list(combinations(range(PARTS), PARTS - SPARE))
_SALT = np.uint64(0xA24BAED4963EE407)
_LOW = np.uint64(0xFFFFFFFF)


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set of 64-bit hashes."""
    found = []
    mixed = T.mix(s ^ _SALT)
    for instance, n1 in instances(len(s), percent):
        partition = ((s >> np.uint64(32)) * np.uint64(n1)) >> np.uint64(32)
        part = ((s & _LOW) * np.uint64(PARTS)) >> np.uint64(32)
        sums = np.zeros(n1 * PARTS, np.uint64)
        np.add.at(sums, (partition * np.uint64(PARTS) + part).astype(np.int64), mixed)
        sums = sums.reshape(n1, PARTS)
        for c, choice in enumerate(_CHOICES):
            place = np.arange(n1, dtype=np.uint64) * np.uint64(len(_CHOICES)) + np.uint64(c)
            total = sum((T.mix(sums[:, p] + np.uint64(p + 1)) for p in choice), np.zeros(n1, np.uint64))
            found.append(T.mix(total * T._STEP + T.mix(place + np.uint64(instance << 40))))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def sketches(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set) and signatures of each row; null where the task has given those of an equal
    set before."""

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            at = 0
            for sets in _shingle_sets(batch.column(1), size):
                digests = [_digest(s) for s in sets]
                keys: list = [None] * len(sets)
                for k, s in enumerate(sets):
                    if len(s) and digests[k] not in seen:
                        keys[k] = signatures(s, percent).view(np.int64)
                        if len(seen) < REMEMBERED:
                            seen.add(digests[k])
                yield pa.record_batch([batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "keys"])
                at += len(sets)

    # rows without doc_id are linked with nothing and must not hide an equal set
    kind, known = dict(docs.dtypes)["doc_id"], F.col("doc_id").isNotNull()
    some = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {kind}, n_shingles long, digest binary, keys array<long>"
    return some.filter(known).mapInArrow(run, schema).union(some.filter(~known).mapInArrow(run, schema).withColumn("keys", F.lit(None).cast("array<long>")))


def _full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node and shingles (sorted hashes) of the classes in nodes, from the text of each class's first document."""
    wanted = nodes.join(classes.select("node", "first_doc", "digest"), "node")

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            digests, at = x.column(2).to_pylist(), 0
            for sets in _shingle_sets(x.column(1), size):
                hit = [k for k, s in enumerate(sets) if _digest(s) == digests[at + k]]
                yield pa.record_batch([x.column(0).take(pa.array([at + k for k in hit], pa.int64())), pa.array([sets[k].view(np.int64) for k in hit], pa.list_(pa.int64()))], names=["node", "shingles"])
                at += len(sets)

    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(wanted, F.col("doc_id") == F.col("first_doc")).select("node", "text", "digest")
    # texts of one doc_id may share a set
    return cut(found.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    sizes = lambda c: classes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"))
    able = pairs.join(sizes("a"), "a").join(sizes("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    able = cut(able.select("a", "b"), "able")
    sets = _full_sets(able.select(F.col("a").alias("node")).union(able.select(F.col("b").alias("node"))).distinct(), classes, docs, size)

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for k in range(x.num_rows):
                one, two = (x.column(c)[k].values.to_numpy() for c in (2, 3))
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = able.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b")
    return cut(both.mapInArrow(run, "a long, b long"), "linked")


def _gathered(open_: DataFrame) -> DataFrame:
    """The open members of buckets, in clusters of buckets that share members where that makes less work: near copies that fall
    short of the limit meet in many buckets, of which each holds other ones of them."""
    work = lambda size: F.col(size) * F.ceil(F.col(size) / BLOCK_CLASSES)
    sized = cut(open_.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("size")), "sized")
    stars = open_.join(sized, "key").filter("node != low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    clusters = cut(connected_components(stars), "clusters").select("node", F.col("root").alias("cluster"))
    of_key = sized.join(clusters, sized["low"] == clusters["node"]).select("key", "cluster", "size")
    apart = of_key.groupBy("cluster").agg(F.sum(work("size")).alias("apart"))
    whole = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).select("cluster", work("size").alias("whole"))
    less = cut(apart.join(whole, "cluster").filter("whole <= apart").select("cluster"), "less")
    one = open_.select("node", "root", "n_shingles").distinct().join(clusters, "node").join(less, "cluster", "left_semi").select(F.col("cluster").alias("key"), "node", "root", "n_shingles")
    rest = of_key.join(less, "cluster", "left_anti").select("key")
    return cut(one.union(open_.join(rest, "key", "left_semi").select("key", "node", "root", "n_shingles")), "gathered")


def _tiled(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between open members (key, node, root, n_shingles) of a bucket that join components, from tiles of two blocks."""
    sized = open_.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("n_shingles").alias("largest"))
    per_block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_CLASSES), F.floor(F.lit(BLOCK_SHINGLES) / F.col("largest"))))
    blocks = sized.select("key", F.ceil(F.col("size") / per_block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks").cast("long")).cast("int")
    rows = open_.join(blocks, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root").join(sets, "node")

    def run(t: pa.Table) -> pa.Table:
        node, label, mine = (t[c].to_numpy().copy() for c in ("node", "root", "mine"))
        lists = t["shingles"].combine_chunks()
        some = [lists[k].values.to_numpy().view(np.uint64) for k in range(t.num_rows)]  # they are sorted as such
        size = np.fromiter(map(len, some), np.int64, len(some))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        out = []
        for x in left:
            y = right[label[right] != label[x]]
            y = y[node[y] > node[x]] if i == j else y
            y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
            if not len(y):
                continue
            flat = np.concatenate([some[k] for k in y])
            place = np.searchsorted(some[x], flat)
            hit = some[x][np.minimum(place, len(some[x]) - 1)] == flat
            common = np.add.reduceat(hit, np.cumsum([0, *size[y][:-1]]), dtype=np.int64)
            for k in y[100 * common >= percent * (size[x] + size[y] - common)]:
                if label[k] != label[x]:
                    out.append((node[x], node[k]))
                    label[label == label[k]] = label[x]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


_IS_LINKED = "n_shingles > 0 and doc_id is not null"


def _name(seed: int) -> Column:
    return F.xxhash64("digest", F.lit(seed))


def _named(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows and their classes (node, digest, first_doc, n_shingles). A class is named by a hash of its digest, so that a row's
    signatures need no join to carry the name; of two digests with one hash, one takes another."""
    seed = 0
    while True:
        classes = cut(rows.filter(_IS_LINKED).groupBy("node", "digest").agg(F.min("doc_id").alias("first_doc"), F.any_value("n_shingles").alias("n_shingles")), "classes")
        alike = classes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("digest").alias("digest")).filter("n > 1").select("digest", F.lit(True).alias("moves"))
        if alike.isEmpty():
            return rows, classes
        seed += 1
        rows = cut(rows.join(alike, "digest", "left").withColumn("node", F.when(F.col("moves"), _name(seed)).otherwise(F.col("node"))).drop("moves"), "sketches")


def components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    rows, classes = _named(cut(sketches(docs, percent, size).withColumn("node", _name(0)), "sketches"))
    able = rows.filter(_IS_LINKED)
    keyed = able.filter("keys is not null").select("node", F.explode("keys").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("high")).filter("pivot != high").select("key", "pivot"), "shared")
    members = cut(keyed.join(shared, "key").select("key", "node", "pivot").distinct(), "members")

    met = cut(members.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "met")
    edges = _linked(met, classes, docs, percent, size)
    roots = cut(connected_components(edges), "roots")

    known = members.filter("node != pivot").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"), *(F.sum(F.xxhash64("node", F.lit(s)).cast("decimal(38,0)")).alias(f"sum{s}") for s in (1, 2))).filter("low != high")
    mixed = cut(mixed.groupBy("size", "sum1", "sum2").agg(F.min("key").alias("key")).select("key"), "mixed")  # one of the buckets with the same open members
    open_ = cut(known.join(mixed, "key", "left_semi").join(classes.select("node", "n_shingles"), "node").select("key", "node", "root", "n_shingles"), "open")
    if not open_.isEmpty():
        more = cut(_tiled(_gathered(open_), _full_sets(open_.select("node").distinct(), classes, docs, size), percent), "tiled")
        roots = cut(connected_components(edges.union(more)), "roots")

    of_class = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = of_class.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_class = cut(of_class.join(lowest, "root").select("node", "component_id"), "components")
    out = rows.select("doc_id", "n_shingles", "node").join(of_class, "node", "left")
    alone = F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
