"""The trie of conversation prefixes, as succinct level-order tries of its parts.

A node is a distinct sequence of first turns (role, text); its members are the conversations that begin with it. Spark
counts the members of every node. A node under which more than HEAVY turns lie is heavy: heavy nodes are the upper
levels, and each node right below them is the top of a light part. Light parts are built whole, many in one task: numpy
sorts a part's nodes level by level and writes the LOUDS bit vector (for each node, a one per child and then a zero)
and the labels; going backwards over the levels, np.add.at adds leaves and tokens up to the parents. The upper levels
are merged apart from them: what the tops of light parts and the heavy nodes add is laid on the path of one member
each, added up along that path, and grouped by node, so that a node that a third of all conversations share is added
up in each task before it is shuffled.

Long conversations are dealt out as well: places of turns, and what is added up along a path, are computed in blocks
of BLOCK turns and then over the blocks.

Rows: null role or text counts as empty. Turns are ordered by turn, null first, then role and text. Rows without conv_id
belong to no conversation. Repeated rows are turns of their own. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .scratch import cut

#: Turns below a node that make it heavy; nodes of one level-order trie, about; turns of a conversation that are handled at once.
HEAVY, TRIE_NODES, BLOCK = 50_000, 100_000, 1024
#: Conversation ids in a piece of what is digested in one sequence.
PIECE = 20_000
NODE = ["depth", "k1", "k2"]


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), t1, t2 (hashes of role and text) and words of each turn."""
    role, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.size(F.filter(F.split(said, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    turns = rows.filter("conv_id is not null").select("conv_id", F.col("turn"), role.alias("role"), said.alias("said"), words.alias("words"))
    turns = turns.select("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"), "turn", F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "said"), 256).alias("sha"), "role", "words", "said")
    half = lambda k: F.conv(F.substring("sha", k, 15), 16, 10).cast("long")
    turns = cut(turns.select("conv_id", "block", "turn", "role", F.xxhash64("said").alias("said"), "sha", half(1).alias("t1"), half(17).alias("t2"), "words"), "turns")
    # equal turns may change places; of those that differ, role and digest decide where turn doesn't
    counts = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), earlier.alias("before"))
    met = turns.join(before, (F.col("conv_id") == F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "sha"))
    return met.select("conv_id", (F.col("before") + within).alias("place"), "t1", "t2", "words")


def rebuilt(turns: DataFrame, borrow: tuple[Column, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n) and their turns (conv_id, depth, t1, t2, words). borrow: for each conv_id, the conversation
    whose first turns replace its own, and how many (few; at most 3)."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    if borrow is None:
        return convs, turns.withColumnRenamed("place", "depth")
    source, h = borrow
    convs = cut(convs.select("conv_id", "n", source.alias("source"), h.cast("long").alias("h")), "convs")
    sizes = convs.select(F.col("conv_id").alias("source"), F.col("n").alias("there"))
    convs = convs.join(sizes, "source", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    convs = cut(convs.select("conv_id", "source", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "convs")
    lent = turns.filter("place <= 3").withColumnRenamed("conv_id", "source").join(convs.filter("lent > 0"), "source").filter("place <= lent").select("conv_id", F.col("place").alias("depth"), "t1", "t2", "words")
    own = turns.join(convs, "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "t1", "t2", "words")
    return convs.select("conv_id", "n"), lent.union(own)


def _along(rows: DataFrame, values: dict[str, Column], down: bool, name: str) -> DataFrame:
    """rows with each value combined (values: what combines a column of that name) over all rows of the conversation from its first to this one, or
    from this one to its last: in blocks, then over the blocks."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    order = lambda c: F.col(c).asc() if down else F.col(c).desc()
    whole = rows.groupBy("conv_id", "block").agg(*(v.alias(f"{c}_b") for c, v in values.items()))
    over = Window.partitionBy("conv_id").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    fold = lambda c, f: f(F.col(f"{c}_b")).over(over)
    ops = {c: F.bit_xor if c in ("k1", "k2") else F.sum for c in values}
    whole = whole.select("conv_id", "block", *(F.coalesce(fold(c, ops[c]), F.lit(0)).alias(f"{c}_b") for c in values))
    inside = Window.partitionBy("conv_id", "block").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    mine = rows.withColumns({c: v.over(inside) for c, v in values.items()})
    both = lambda c: F.col(c).bitwiseXOR(F.col(f"{c}_b")) if c in ("k1", "k2") else F.col(c) + F.col(f"{c}_b")
    keep = [c for c in rows.columns if c not in values and c != "block"]
    return cut(mine.join(whole, ["conv_id", "block"]).select(*keep, *(both(c).alias(c) for c in values)), name)


def paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2 (the node: both halves of a digest of the turns so far), p1, p2 (its parent), words and below
    (turns from here to the conversation's end) of each turn and of the textless root."""
    seed = lambda k: F.xxhash64(F.lit(k), "depth", f"t{k}")
    keyed = turns.select("conv_id", "depth", "words", seed(1).alias("k1"), seed(2).alias("k2"), seed(1).alias("s1"), seed(2).alias("s2"))
    chained = _along(keyed, {"k1": F.bit_xor("k1"), "k2": F.bit_xor("k2")}, True, "chained")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("words"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    rows = chained.select("conv_id", "depth", "words", "k1", "k2", F.col("k1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("s2")).alias("p2")).union(root)
    return cut(rows.join(convs, "conv_id").withColumn("below", F.col("n") - F.col("depth") + 1).drop("n"), "paths")


@dataclass
class Louds:
    """Level-order tries of one forest: for each node, in level order, a one per child and then a zero; its label."""

    bits: np.ndarray
    labels: np.ndarray
    order: np.ndarray
    parent: np.ndarray
    levels: list[tuple[int, int]]

    @property
    def children(self) -> np.ndarray:
        """How many ones stand before each node's zero."""
        zeros = np.flatnonzero(self.bits == 0)
        return np.diff(np.concatenate([[-1], zeros])) - 1

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees of values in level order: backwards over the levels, each adds to its parents."""
        total = values.copy()
        for begin, end in reversed(self.levels[1:]):
            np.add.at(total, self.parent[begin:end], total[begin:end])
        return total


def louds(part: np.ndarray, depth: np.ndarray, node: np.ndarray, parent: np.ndarray, label: np.ndarray) -> Louds:
    """The tries of a forest. part: a number for the trie that a row is in; depth, node and parent: of each row, a node being
    its number at its depth. A row without a parent in its trie is a top."""
    rank = np.lexsort((node, part, depth))
    first = np.full(int(part.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, part, depth)
    level = depth - first[part]  # tops of all tries form the first level
    at_level = [np.flatnonzero(level == k) for k in range(int(level.max()) + 1)] if len(rank) < 64 else np.split(np.argsort(level, kind="stable"), np.cumsum(np.bincount(level))[:-1])
    order, up, levels, done = [], [], [], 0
    before: np.ndarray | None = None
    for rows in at_level:
        if before is None:
            rows, above = rows[np.lexsort((label[rows], part[rows]))], np.full(len(rows), -1)
        else:
            known = np.lexsort((node[before], part[before]))
            have = np.stack([part[before][known], node[before][known]], 1)
            _, code = np.unique(np.concatenate([have, np.stack([part[rows], parent[rows]], 1)]), axis=0, return_inverse=True)
            place = np.empty(int(code.max()) + 1, np.int64)
            place[code[: len(have)]] = known
            above = place[code[len(have) :]] + levels[-1][0]
            by = np.lexsort((label[rows], above))  # children follow their parents' order
            rows, above = rows[by], above[by]
        order.append(rows)
        up.append(above)
        levels.append((done, done + len(rows)))
        done += len(rows)
        before = rows
    order, up = np.concatenate(order), np.concatenate(up)
    n = len(order)
    counts = np.bincount(up[up >= 0], minlength=n)
    bits = np.ones(int(counts.sum()) + n, np.uint8)
    bits[np.cumsum(counts + 1) - 1] = 0
    return Louds(bits, label[order], order, up, levels)


def _light(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_children, n_leaves, saved of the nodes (top1, top2: the light part of each; rep: the smallest member).
    Parts come one after the other, and a task builds tries of whole parts until it holds TRIE_NODES nodes."""
    names = ["top1", "top2", "depth", "conv_id", "parent_rep", "k1", "gain"]

    def tries(t: pa.Table) -> pa.RecordBatch:
        c = {k: t[k].to_numpy() for k in names}
        part = np.cumsum(np.concatenate([[0], (np.diff(c["top1"]) != 0) | (np.diff(c["top2"]) != 0)]).astype(np.int64))
        trie = louds(part, c["depth"], c["conv_id"], c["parent_rep"], c["k1"])
        children = trie.children
        leaves = trie.up((children == 0).astype(np.int64))
        saved = trie.up(c["gain"][trie.order])
        return pa.record_batch([pa.array(v) for v in (c["conv_id"][trie.order], c["depth"][trie.order], children.astype(np.int64), leaves, saved)], names=["conv_id", "depth", "n_children", "n_leaves", "saved"])

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for x in batches:
            if not x.num_rows:
                continue
            held.append(x)
            size += x.num_rows
            if size < TRIE_NODES:
                continue
            t = pa.Table.from_batches(held)
            tops = (t["top1"].to_numpy(), t["top2"].to_numpy())
            new = np.flatnonzero((np.diff(tops[0]) != 0) | (np.diff(tops[1]) != 0))
            if len(new):  # the last part may go on in the next batch
                yield tries(t.slice(0, int(new[-1]) + 1))
                t = t.slice(int(new[-1]) + 1)
            held, size = t.to_batches(), t.num_rows
        if size:
            yield tries(pa.Table.from_batches(held))

    dealt = nodes.select(*names).repartition("top1", "top2").sortWithinPartitions("top1", "top2")
    return dealt.mapInArrow(run, "conv_id long, depth long, n_children long, n_leaves long, saved long")


def _ends(rows: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of nodes where conversations end: the digest of their ids, ascending. Ids are put in order and into
    pieces over all partitions; then one task goes over a node's pieces, as a digest is made in sequence."""

    @T.releasing
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(0, x.num_rows, PIECE):
                some = x.slice(i, PIECE)
                key = [some.column(c).to_numpy() for c in range(3)]
                edges = np.concatenate([[0], np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1, [some.num_rows]]) if some.num_rows else [0]
                ids = some.column(3).to_pylist()
                out = [(*(int(k[a]) for k in key), ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(edges[:-1], edges[1:])]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())], names=[*NODE, "first", "ids"])

    @T.releasing
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for x in batches:
            out = []
            for *key, ids in zip(*(x.column(c).to_pylist() for c in (0, 1, 2, 4))):
                if key != now:
                    if digest is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], names=[*NODE, "ends_sha256"])
        if digest is not None:
            yield pa.record_batch([pa.array([v]) for v in (*now, digest.hexdigest())], names=[*NODE, "ends_sha256"])

    ranged = rows.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    packed = ranged.mapInArrow(pieces, "depth long, k1 long, k2 long, first long, ids string")
    return packed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def _upper(path: DataFrame, heavy: DataFrame, adds: DataFrame) -> DataFrame:
    """NODE, n_leaves, saved of heavy nodes. adds: conv_id, depth, leaves, gain, on the path of one member each."""
    on = path.join(heavy.select(*NODE), NODE).select("conv_id", *NODE)
    summed = adds.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("gain").alias("gain"))
    laid = on.join(summed, ["conv_id", "depth"], "left").select("conv_id", *NODE, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("leaves", "gain")))
    laid = laid.withColumnsRenamed({"k1": "n1", "k2": "n2"})
    up = _along(laid, {"leaves": F.sum("leaves"), "gain": F.sum("gain")}, False, "laid")
    return up.groupBy("depth", F.col("n1").alias("k1"), F.col("n2").alias("k2")).agg(F.sum("leaves").alias("n_leaves"), F.sum("gain").alias("saved"))


def trie(rows: DataFrame, borrow: tuple[Column, Column] | None = None, heavy_turns: int = HEAVY) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the
    subtree, words of a node's last text for each member but one), ends_sha256."""
    convs, turns = rebuilt(cut(turns_of(rows), "placed"), borrow)
    convs = cut(convs, "convs")
    path = paths(convs, turns)
    nodes = path.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("below").alias("below"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = cut(nodes.withColumn("gain", (F.col("n_convs") - 1) * F.col("words")).withColumn("heavy", F.col("below") > heavy_turns), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("under_heavy"))
    nodes = cut(nodes.join(above, ["depth", "p1", "p2"], "left"), "linked")
    is_top = ~F.col("heavy") & F.coalesce("under_heavy", F.lit(True))

    # the light part of a node: the top that its smallest member's path enters
    tops = nodes.filter(is_top).select(*NODE)
    entered = cut(path.join(tops, NODE).select("conv_id", F.col("k1").alias("top1"), F.col("k2").alias("top2")), "entered")
    light = nodes.filter("not heavy").join(entered, "conv_id").select("top1", "top2", "depth", "conv_id", F.when(is_top, F.lit(None)).otherwise(F.col("parent_conv_id")).alias("parent"), "k1", "gain")
    light = cut(_light(light.withColumn("parent_rep", F.coalesce("parent", F.lit(-1).cast("long")))), "light")
    heavy = nodes.filter("heavy")
    held = nodes.filter("under_heavy").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    heavy = cut(heavy.join(held, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "heavy")
    from_light = light.join(nodes.filter(is_top & (F.col("depth") > 0)).select("conv_id", "depth"), ["conv_id", "depth"]).select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("n_leaves").alias("leaves"), F.col("saved").alias("gain"))
    from_heavy = heavy.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), "gain")
    if heavy.isEmpty():
        merged = light
    else:
        upper = heavy.join(_upper(path, heavy, from_light.union(from_heavy)), NODE).select("conv_id", "depth", "n_children", "n_leaves", "saved")
        merged = light.union(upper)

    last = path.filter("below = 1")
    out = nodes.select(*NODE, "conv_id", "parent_conv_id", "n_convs").join(cut(merged, "merged"), ["conv_id", "depth"]).join(cut(_ends(last), "ends"), NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
