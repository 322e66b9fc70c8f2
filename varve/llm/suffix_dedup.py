"""Repeated passages by a sparse suffix array over words.

A suffix is kept where a minimiser is: the smallest hash of GRAM words among SPAN starts in a row. Every passage of
LEAST words has one at the same place in all its copies, as GRAM + SPAN - 1 is LEAST. Spark drops suffixes whose
first GRAM words occur once. Suffixes that agree in all words up to LEAST on either side are one from there on (the
first stands for them). The others are sorted by their next LEAST words, over all partitions, and each is compared
with its two neighbours, which gives the longest match to the right that it has with any other. From there the
match is extended left: of the passages of LEAST words that begin up to SPAN words before the suffix and end within
the match, those that occur elsewhere are found by their hash. The first occurrence of each (by doc_id, then place)
stays, all later ones are repeats.

Words are compared as they are, by 32-bit hashes each; a passage is 50 of them.

Rows: null or empty texts, and texts of fewer than LEAST words, have no repeats. Rows with the same doc_id and text
are one document. A null doc_id comes before all others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .scratch import cut

LEAST, GRAM = 50, 8
SPAN = LEAST - GRAM + 1
_MAX = np.uint64(2**64 - 1)


def minimisers(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words where a minimiser is, its hash, and the first and last start of the passages of LEAST words whose first
    minimiser it is. first: words before each row."""
    none = np.zeros(0, np.int64)
    if len(hashes) < LEAST:
        return none, np.zeros(0, np.uint64), none, none
    grams = np.minimum(T.ngrams(hashes, GRAM), _MAX - np.uint64(1))
    starts = np.flatnonzero(T.whole(np.diff(first), first, LEAST, len(hashes) - LEAST + 1))
    if not len(starts):
        return none, np.zeros(0, np.uint64), none, none
    place = _first_smallest(grams, SPAN)[starts]
    cut_at = np.flatnonzero(np.diff(place) != 0) + 1
    begin = np.concatenate([[0], cut_at])
    end = np.concatenate([cut_at, [len(starts)]]) - 1
    return place[begin], grams[place[begin]], starts[begin], starts[end]


def _first_smallest(x: np.ndarray, n: int) -> np.ndarray:
    """The place of the smallest (of equal ones, the first) of each n values in a row, by doubling."""
    done, at = 1, np.arange(len(x))
    while done < n:
        k = min(done, n - done)
        a, b = at[:-k], at[k:]
        at = np.where(x[b] < x[a], b, a)
        done += k
    return at


def _spans(hashes: np.ndarray, place: np.ndarray, begin: np.ndarray | int, end: np.ndarray | int, low: int, high: int) -> np.ndarray:
    """The 32-bit hashes of words low to high around each place; 0 outside of the text, which is begin to end."""
    at = place[:, None] + np.arange(low, high)
    inside = (at >= np.reshape(begin, (-1, 1))) & (at < np.reshape(end, (-1, 1)))
    small = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return np.where(inside, small[np.clip(at, 0, max(len(hashes) - 1, 0))], np.uint32(0))


def _around(hashes: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of all words that a passage of LEAST words around each place may have."""
    out = np.full(len(place), 7, np.uint64)
    for column in np.ascontiguousarray(_spans(hashes, place, begin, end, -SPAN + 1, LEAST).T):
        out = T.mix(out * T._STEP + column)
    return out


def suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, sha (hash of the text), place, gram, around, lo, hi: each suffix kept, the hash of its first words and
    of all words around, and the starts of its passages."""

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            data, offsets = T.bytes_of(x.column(2))
            for i, j in T.slices(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = T.words(part, off)
                hashes = T.hash_spans(part, starts, ends)
                place, gram, lo, hi = minimisers(hashes, first)
                if not len(place):
                    continue
                row = np.searchsorted(first, place, "right") - 1
                around = _around(hashes, place, first[row], first[row + 1])
                base, take = first[row], pa.array(row + i)
                yield pa.record_batch([x.column(0).take(take), x.column(1).take(take), pa.array((place - base).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), *(pa.array((v - base).astype(np.int32)) for v in (lo, hi))], names=["doc_id", "sha", "place", "gram", "around", "lo", "hi"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("sha"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, sha long, place int, gram long, around long, lo int, hi int")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted suffixes with the words right and left of them."""
    lists = wanted.groupBy("doc_id", "sha").agg(F.sort_array(F.collect_list(F.struct("place", "lo", "hi"))).alias("places")).withColumnRenamed("doc_id", "d").withColumnRenamed("sha", "s")
    texts = docs.select("doc_id", F.xxhash64("text").alias("sha"), F.col("text").cast("string").alias("text"))
    met = texts.join(lists, texts["doc_id"].eqNullSafe(lists["d"]) & (texts["sha"] == lists["s"])).select("doc_id", "sha", "text", "places")

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            data, offsets = T.bytes_of(x.column(2))
            for d in range(x.num_rows):
                part = data[offsets[d] : offsets[d + 1]]
                starts, ends, _ = T.words(part, np.array([0, len(part)]))
                hashes = T.hash_spans(part, starts, ends)
                places = pa.RecordBatch.from_struct_array(x.column(3)[d].values)
                for k in range(0, len(places), 2000):
                    some = places.slice(k, 2000)
                    place = some.column(0).to_numpy().astype(np.int64)
                    right, left = (_spans(hashes, place, 0, len(hashes), a, b).astype(">u4") for a, b in ((0, LEAST), (-SPAN + 1, 0)))
                    take = pa.array([d] * len(place))
                    yield pa.record_batch([x.column(0).take(take), x.column(1).take(take), *some.columns, pa.array([r.tobytes() for r in right], pa.binary()), pa.array([r.tobytes() for r in left], pa.binary())], names=["doc_id", "sha", "place", "lo", "hi", "right", "left"])

    kind = dict(docs.dtypes)["doc_id"]
    return met.mapInArrow(run, f"doc_id {kind}, sha long, place int, lo int, hi int, right binary, left binary")


def _lcp(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    differ = (one != two) | (one == 0)
    return np.where(differ.any(1), differ.argmax(1), one.shape[1])


def _passages(contexts: DataFrame) -> DataFrame:
    """doc_id, sha, start, passage: the passages that may repeat, by the match with the neighbours in suffix order."""
    kind = dict(contexts.dtypes)["doc_id"]
    order = ["right", "doc_id", "sha", "place"]
    ranged = cut(contexts, "contexts").repartitionByRange(*order).sortWithinPartitions(*order)

    def emit(x: dict, longest: np.ndarray) -> pa.RecordBatch | None:
        words = np.concatenate([x["left"], x["right"]], 1).astype(np.uint64)
        rows, starts, hashes = [], [], []
        for o in range(SPAN):  # passages that begin o words before the suffix
            start = x["place"] - o
            ok = np.flatnonzero((start >= x["lo"]) & (start <= x["hi"]) & (LEAST - o <= longest))
            if len(ok):
                h = np.full(len(ok), 3, np.uint64)
                for k in range(SPAN - 1 - o, SPAN - 1 - o + LEAST):
                    h = T.mix(h * T._STEP + words[ok, k])
                rows.append(ok)
                starts.append(start[ok])
                hashes.append(h)
        if not rows:
            return None
        take = pa.array(np.concatenate(rows))
        return pa.record_batch([x["doc_id"].take(take), x["sha"].take(take), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64))], names=["doc_id", "sha", "start", "passage"])

    def unpack(x: pa.RecordBatch) -> dict:
        n, get = x.num_rows, lambda c: x.column(x.schema.get_field_index(c))
        return {"doc_id": get("doc_id"), "sha": get("sha"), **{c: get(c).to_numpy().astype(np.int64) for c in ("place", "lo", "hi")}, "right": np.frombuffer(b"".join(get("right").to_pylist()), ">u4").reshape(n, LEAST), "left": np.frombuffer(b"".join(get("left").to_pylist()), ">u4").reshape(n, SPAN - 1)}

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row is complete when the row after it is known, so the last one waits for the next batch; a
        # partition's first and last rows may match a row of another partition: they take the whole length
        held: pa.Table | None = None
        before = LEAST
        for x in batches:
            if not x.num_rows:
                continue
            if held is not None:
                x = pa.Table.from_batches([held, x]).combine_chunks().to_batches()[0]
            u = unpack(x)
            n = x.num_rows
            match = _lcp(u["right"][1:], u["right"][:-1])
            longest = np.zeros(n, np.int64)
            longest[1:] = match
            longest[:-1] = np.maximum(longest[:-1], match)
            longest[0] = max(longest[0], before)
            before = int(match[-1]) if n > 1 else before
            held = x.slice(n - 1)
            if n > 1:
                part = {c: v.slice(0, n - 1) if isinstance(v, pa.Array) else v[: n - 1] for c, v in u.items()}
                out = emit(part, longest[: n - 1])
                if out is not None:
                    yield out
        if held is not None:
            out = emit(unpack(held), np.array([LEAST]))
            if out is not None:
                yield out

    return ranged.select("doc_id", "sha", "place", "lo", "hi", "right", "left").mapInArrow(run, f"doc_id {kind}, sha long, start int, passage long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, sha, start, end (words), first_doc_id: spans of passages whose first occurrence is elsewhere (or
    earlier in the same text)."""
    kept = cut(suffixes(docs), "suffixes")
    grams = cut(kept.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "grams")
    kept = cut(kept.join(grams, "gram", "left_semi"), "repeated")
    groups = kept.groupBy("gram", "around").agg(F.min(F.struct("doc_id", "sha", "place", "lo", "hi")).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups, "groups")
    many = cut(groups.filter("n > 1").select("gram", "around", "first"), "many")
    here = F.struct("doc_id", "sha", "place")
    copies = kept.join(many, ["gram", "around"]).filter(here != F.struct("first.doc_id", "first.sha", "first.place"))
    copies = copies.select("doc_id", "sha", F.col("lo").alias("start"), (F.col("hi") + LEAST).alias("end"), F.col("first.doc_id").alias("first_doc_id"))

    forks = groups.groupBy("gram").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1").select("gram")
    wanted = groups.select("gram", "first.*").join(cut(forks, "forks"), "gram", "left_semi")
    found = cut(_passages(_contexts(docs, cut(wanted.drop("gram"), "wanted"))), "passages")
    twice = found.groupBy("passage").agg(F.min(F.struct("doc_id", "sha", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = found.join(cut(twice, "twice"), "passage").filter(F.struct("doc_id", "sha", "start") != F.col("first"))
    later = later.select("doc_id", "sha", "start", (F.col("start") + LEAST).alias("end"), F.col("first.doc_id").alias("first_doc_id"))

    # a text's own spans only, each at most once for each word: overlapping spans of one first occurrence are merged
    return _merged(copies.unionByName(later).distinct())


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of one text and one first occurrence as one: runs in the order of start."""
    of = Window.partitionBy("doc_id", "sha", "first_doc_id").orderBy("start", "end")
    reach = F.max("end").over(of.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("fresh", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(of))
    return runs.groupBy("doc_id", "sha", "first_doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "sha", "start", "end", "first_doc_id")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with later occurrences of repeated passages cut out of their texts, in docs' columns; n_chars follows.
    A text of which nothing stays is dropped. Only texts with spans to cut go through Python."""
    spans = cut(repeated_spans(docs).groupBy("doc_id", "sha").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    same = rows["id"].eqNullSafe(spans["doc_id"]) & (rows["hash"] == spans["sha"])

    @F.pandas_udf("string")
    def without(texts, spans):
        import pandas as pd

        return pd.Series([_without(t, s) for t, s in zip(texts, spans)], dtype=object)

    whole = rows.join(spans, same, "left_anti").select("doc.*")
    left = rows.join(spans, same).select("doc", without(F.col("doc.text"), "spans").alias("left")).filter(F.length("left") > 0)
    changed = {"text": F.col("left"), "n_chars": F.length("left")}
    return whole.union(left.select(*(changed.get(f.name, F.col("doc").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema)))


def _without(text: str | None, spans) -> str | None:
    if spans is None or text is None:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = T.words(data, np.array([0, len(data)]))
    gone = np.zeros(len(starts) + 1, np.int64)
    for s in spans:
        gone[s["start"]] += 1
        gone[s["end"]] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    if gone.all():
        return ""
    out, at = [], 0
    for k in np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2):
        out.append(raw[at : starts[k[0]]])
        at = starts[k[1]] if k[1] < len(starts) else len(raw)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass").strip()
