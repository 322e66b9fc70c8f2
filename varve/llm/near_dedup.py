"""MinHash near-deduplication: universal hash minima, bands, signature and exact verification, and
connected components by alternating large-star and small-star.

Two documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of shingles (words
lower-cased in A-Z only). Equal sets are one class, found by digest, so that copies never meet in
pairs. In each bucket (band, key) the classes are compared with the bucket's smallest class, its pivot: first
each class with the smallest of its pivots, then with those that aren't in its component yet. Buckets
whose members are then in one component are done; in the others the members of different components
are compared in tiles of bounded size, and a tile gives no more links than it has members, unless sets
are too large for it. Very large buckets are split by shingles that are rare in them first. Pairs that pass are
confirmed on their full sets.

Rows: null or empty texts and texts without words have no shingles and are linked with nothing. Rows
without doc_id are never linked and always kept. Rows that share a doc_id but not a text are separate
classes under that id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import cut

SHINGLE, BANDS, ROWS, PERCENT = 5, 25, 5, 85
#: What drop_near_copies takes; buckets find 0.8 with a miss in 20,000 pairs.
DROP_PERCENT = 80
#: Classes of one block of a tile, and the smallest shingle hashes of each that a tile sees: sets of up to BOTTOM are whole.
TILE, BOTTOM = 256, 512
#: A bucket of more classes is split by its members' rare shingles before it is tiled, where that makes less work.
SPLIT = 4096


def least_agreeing(n: int, percent: int) -> int:
    """Of n values that agree with probability percent, the number below which 3 in a million fall (4.5 standard deviations)."""
    p = percent / 100
    return int(n * p - 4.5 * (n * p * (1 - p)) ** 0.5)


_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def _shingle_sets(column: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    """For each slice of a text column, each row's sorted set of shingle hashes."""
    data, offsets = T.bytes_of(column)
    for i, j in T.slices(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = T.words(part, off)
        hashes = T.hash_spans(part, starts, ends, T.LOWER)
        grams = T.ngrams(hashes, size)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(grams[a : b - size + 1]))
            elif b > a:
                out.append(T.ngrams(hashes[a:b], b - a) ^ np.uint64(b - a))
            else:
                out.append(np.zeros(0, np.uint64))
        yield out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minimum of each hash over each set; sets aren't empty."""
    x, cuts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out, t = np.empty((len(sets), len(_A)), np.uint32), np.empty_like(x)
    for k in range(len(_A)):
        np.multiply(x, _A[k], out=t)
        t += _B[k]
        out[:, k] = np.minimum.reduceat(t, cuts) >> np.uint64(32)
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            h = T.mix(h * T._STEP + sig[:, b * ROWS + r])
        keys[:, b] = h
    return keys


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, sha (hash of the text), n_shingles, digest of the set, band keys and signature (16 bits of each minimum)
    of each row."""

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in _shingle_sets(batch.column(2), SHINGLE):
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                sigs: list = [None] * len(sets)
                if full:
                    sig = _signatures([sets[k] for k in full])
                    for k, row, short in zip(full, _band_keys(sig).view(np.int64), (sig & 0xFFFF).astype(np.uint16)):
                        keys[k], sigs[k] = row, short.tobytes()
                yield pa.record_batch(
                    [*(batch.column(c).slice(at, len(sets)) for c in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    names=["doc_id", "sha", "n_shingles", "digest", "keys", "sig"],
                )
                at += len(sets)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, sha long, n_shingles long, digest binary, keys array<long>, sig binary")


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose signatures and sizes let them be linked."""
    least = least_agreeing(BANDS * ROWS, percent)

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint16).reshape(x.num_rows, -1) for c in (2, 3))
            yield x.select(["a", "b"]).filter(pa.array((one == two).sum(1) >= least))

    of = lambda c: classes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, most: int | None = None) -> DataFrame:
    """node and shingles of the classes in nodes: their sorted hashes, the `most` smallest."""
    wanted = nodes.join(classes.select("node", "first_doc", "digest"), "node")

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            digests, at = x.column(2).to_pylist(), 0
            for sets in _shingle_sets(x.column(1), SHINGLE):
                hit = [k for k, s in enumerate(sets) if _digest(s) == digests[at + k]]
                yield pa.record_batch([x.column(0).take(pa.array([at + k for k in hit], pa.int64())), pa.array([sets[k][:most].view(np.int64) for k in hit], pa.list_(pa.int64()))], names=["node", "shingles"])
                at += len(sets)

    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(wanted, F.col("doc_id") == F.col("first_doc")).select("node", "text", "digest")
    return cut(found.mapInArrow(run, "node long, shingles array<long>"), "sets")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked, by intersecting their full sets."""
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), classes, docs)
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    linked = F.col("common") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("common")) * percent
    return both.filter(linked).select("a", "b")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of every node in edges (a, b).

    Alternating large-star and small-star, until all that is left is stars; each half step writes the minima and the new
    edges, so that both sides of its join are plain shuffles that Spark can split where a star's centre is hot.
    """

    def minima(e: DataFrame) -> DataFrame:
        return cut(e.groupBy("u").agg(F.min("v").alias("m")), "minima")

    def stars(e: DataFrame) -> bool:
        """Whether each u has one v, and no v is a u: then nothing moves any more."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(e.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return ends.filter("up + down > 1 and up > 0").isEmpty()

    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = minima(large)
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = cut(small.distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node and root of every node in roots (node, root; each root is its own) and in edges (a, b), which join its
    components: only the roots that edges name are gone through again, not the edges that roots were made of."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    above = cut(connected_components(between), "above").select(F.col("node").alias("root"), F.col("root").alias("top"))
    fresh = above.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(fresh)


def _rare_shingles(large: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """band, key, node, root, part: the members of each bucket by the shingles that are rare in it. Of two linked sets,
    each in the order of rising frequency in the bucket, the first size - ceil(size * percent / 100) + 1 shingles share
    one, so that no link is lost, and what many members have in common brings no two of them together."""
    of = ["band", "key"]
    held = large.select(*of, "node", "root").join(_sets(large.select("node").distinct(), classes, docs), "node")
    held = cut(held.select(*of, "node", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("part")), "elements")
    often = cut(held.groupBy(*of, "part").agg(F.count(F.lit(1)).alias("often")), "often")
    ranked = held.join(often, [*of, "part"]).groupBy(*of, "node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("often", "part"))).alias("by"))
    first = F.slice("by", 1, (F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).cast("int"))
    return ranked.select(*of, "node", "root", F.explode(first).alias("x")).filter("x.often > 1").select(*of, "node", "root", F.col("x.part").alias("part"))


def _tiled(members: DataFrame, classes: DataFrame, roots: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """a, b, sure from buckets that still hold several components: members of different components are compared
    within tiles of TILE by TILE classes, each pair in its first common bucket. Where both sets are whole, links are
    sure and a tile gives only those that join its components, so it never has more rows than members; pairs with
    larger sets are given where their smallest hashes let them be linked (3 in a million linked pairs fall short). A
    bucket's smallest class has met all others. Buckets of more than SPLIT are split by rare shingles first."""
    known = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("band", "key")
    open_ = cut(cut(known.filter("size > 2 and node != pivot"), "members").join(cut(mixed, "mixed"), ["band", "key"]), "open")
    rows = open_.filter(F.col("size") <= SPLIT).select("band", "key", F.lit(0).cast("long").alias("part"), "node", "root", "size")
    large = open_.filter(F.col("size") > SPLIT)
    if not large.isEmpty():
        tiles = F.col("size") * F.ceil(F.col("size") / TILE)
        rare = cut(_rare_shingles(large, classes, docs, percent), "rare")
        several = rare.groupBy("band", "key", "part").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
        several = cut(several, "several")
        split = several.groupBy("band", "key").agg(F.sum(tiles).alias("split"))
        work = cut(large.groupBy("band", "key").agg(F.first(tiles).alias("whole")).join(split, ["band", "key"], "left"), "work")
        less = F.coalesce("split", F.lit(0)) < F.col("whole")
        again = large.join(work.filter(~less), ["band", "key"]).select("band", "key", F.lit(0).cast("long").alias("part"), "node", "root", "size")
        parts = rare.join(several, ["band", "key", "part"]).join(work.filter(less).select("band", "key"), ["band", "key"], "left_semi").select(*rows.columns)
        rows = cut(rows.union(again).union(parts), "open")
    bottoms = _sets(rows.select("node").distinct(), classes, docs, BOTTOM)
    traits = classes.select("node", "sig", "keys", "n_shingles").join(bottoms, "node")
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).join(cut(traits, "traits"), "node")
    rows = rows.select("band", "key", "part", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root", "sig", "keys", "n_shingles", "shingles")
    least, least_bottom = least_agreeing(BANDS * ROWS, percent), least_agreeing(BOTTOM, percent)

    def run(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(table.num_rows, -1)
        node, root, mine, size = (table[c].to_numpy() for c in ("node", "root", "mine", "n_shingles"))
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, BANDS)
        lists = table["shingles"].combine_chunks()
        sets = [lists[k].values.to_numpy().view(np.uint64) for k in range(table.num_rows)]
        i, j, band = (table[c][0].as_py() for c in ("i", "j", "band"))
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        label = root.copy()
        out = []
        for x in left:
            y = right[label[right] != label[x]]
            y = y[node[y] > node[x]] if i == j else y
            y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
            y = y[~(keys[y, :band] == keys[x, :band]).any(1)]
            y = y[(sig[y] == sig[x]).sum(1) >= least]
            whole = y[size[y] <= BOTTOM] if size[x] <= BOTTOM else y[:0]
            if len(whole):
                each = [len(sets[k]) for k in whole]
                place = np.searchsorted(sets[x], flat := np.concatenate([sets[k] for k in whole]))
                hit = sets[x][np.minimum(place, len(sets[x]) - 1)] == flat
                common = np.add.reduceat(hit, np.cumsum([0, *each[:-1]]), dtype=np.int64)
                for k in whole[100 * common >= percent * (size[x] + size[whole] - common)]:
                    if label[k] != label[x]:
                        out.append((node[x], node[k], True))
                        label[label == label[k]] = label[x]
            for k in np.setdiff1d(y, whole):
                both = np.union1d(sets[x], sets[k])[:BOTTOM]
                if np.isin(np.intersect1d(sets[x], sets[k]), both).sum() >= least_bottom * len(both) / BOTTOM:
                    out.append((node[x], node[k], False))
        a, b, sure = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(np.minimum(a, b).astype(np.int64)), "b": pa.array(np.maximum(a, b).astype(np.int64)), "sure": pa.array(sure, pa.bool_())})

    return rows.groupBy("band", "key", "part", "i", "j").applyInArrow(run, "a long, b long, sure boolean").distinct()


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id of its component)
    and kept (doc_id is component_id, or there is no doc_id)."""
    return _labelled(docs, percent).drop("sha")


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    rows = cut(sketches(docs).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    able = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = able.groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_doc"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("keys").alias("keys"), F.any_value("sig").alias("sig"))
    classes = cut(classes, "classes")
    buckets = classes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut(buckets.join(cut(shared, "shared"), ["band", "key"]), "members")

    def linked(pairs: DataFrame) -> DataFrame:
        return cut(_confirmed(cut(_agreeing(pairs, classes, percent), "agreeing"), classes, docs, percent), "linked")

    # each class meets one pivot, the smallest of its buckets; then those of its other pivots that aren't in its
    # component yet; then, in buckets that still hold several components, the members of different ones
    nearest = cut(members.groupBy("node").agg(F.min("pivot").alias("pivot")).filter("node != pivot"), "nearest")
    roots = cut(connected_components(linked(nearest.select(F.col("pivot").alias("a"), F.col("node").alias("b")))), "roots")
    met = members.filter("node != pivot").select("node", "pivot").distinct().join(nearest, ["node", "pivot"], "left_anti")
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    apart = met.join(of("node"), "node", "left").join(of("pivot"), "pivot", "left")
    apart = apart.filter(F.coalesce("node_root", "node") != F.coalesce("pivot_root", "pivot"))

    def joined(more: DataFrame) -> None:
        nonlocal roots
        if not more.isEmpty():
            roots = cut(joined_components(roots, more), "roots")

    joined(linked(cut(apart.select(F.col("pivot").alias("a"), F.col("node").alias("b")), "pairs")))
    found = cut(_tiled(members, classes, roots, docs, percent), "tiled")
    maybe = found.filter("not sure").select("a", "b")
    more = found.filter("sure").select("a", "b")
    joined(more if maybe.isEmpty() else more.union(linked(maybe)))

    of_class = cut(classes.select("digest", "node", "first_doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    lowest = cut(of_class.groupBy("root").agg(F.min("first_doc").alias("component_id")), "lowest")
    of_class = cut(of_class.join(lowest, "root").select("digest", "component_id"), "components")
    out = rows.select("doc_id", "sha", "n_shingles", "digest").join(of_class, "digest", "left")
    alone = F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").isNull()
    out = out.select("doc_id", "sha", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, percent: int = DROP_PERCENT) -> DataFrame:
    """docs without those whose component has a smaller doc_id, in docs' columns. A row goes by its own text's
    component: another text with the same doc_id stays."""
    gone = cut(_labelled(docs, percent).filter(~F.col("kept")).select("doc_id", "sha").distinct(), "gone")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    return rows.join(gone, (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("sha")), "left_anti").select("doc.*")
