"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and word beginnings, lower-cased and hashed to 2**BITS features. The machine's
pairwise weights see combinations that a linear sum misses. It is fitted on at most MOST_LABELLED labelled documents,
chosen by a hash of doc_id, and on at most as many different texts of them, chosen by a hash of doc_id and text, however
often a doc_id is repeated; scoring covers every text. Spark counts, over the different texts of that sample, how
often each feature goes with either label, and likewise each pair of words at most NEAR words apart. A feature
enters the machine if it tells the labels apart by itself (LEAST_CHI2) or in a pair with another (LEAST_PAIR_CHI2, among
pairs of LEAST_PAIR texts of label 1 or more), so that an insult made of two harmless words is seen too; there is no
cap on their number.

Rows: null or empty texts have no terms and get the score of the intercept. Labels that are null, or of documents
that aren't there, are left out; where a document has several labels, the largest counts. Repeated rows get the
same score and are learned from once. Without labels of both kinds, every score is the share of label 1 (0 if there are none). An empty
table gives an empty result. Label, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut
from .text import releasing

BITS, BEGINNINGS = 20, (4, 5)
MOST_LABELLED = 20_000
#: LEAST_CHI2 is the limit with the least log-loss over three folds inside the training rows (README).
LEAST_DOCS, LEAST_CHI2 = 3, 12.0
NEAR, LEAST_PAIR, LEAST_PAIR_CHI2 = 4, 6, 40.0
SLOTS = 1 << 22
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 15, 256, 0.05, 1e-4
HELD_OUT_OF = 5
#: Words of which a task keeps the features; others are hashed again. This bounds memory only.
MOST_KNOWN = 100_000


def remainder(doc_id: str | Column, of: int) -> Column:
    """crc32 of doc_id as text, mod `of`; null for null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % of


def hashed(word: str) -> set[int]:
    mask = (1 << BITS) - 1
    out = {zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) & mask}
    for n in BEGINNINGS:
        if len(word) >= n:
            out.add(zlib.crc32(b"%d" % n + word[:n].encode("utf-8", "surrogatepass")) & mask)
    return out


def words_of(text: str) -> list[str]:
    """The words of a text in order, without marks around them."""
    return [w for w in (w.strip(".,;:!?\"'()[]") for w in text.lower().split()) if w]


def pairs_of(text: str, useful: np.ndarray) -> np.ndarray:
    """The distinct pairs of different useful words at most NEAR words apart, both hashes in one number."""
    ids = np.array([zlib.crc32(b"w" + w.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for w in words_of(text)], np.int64)
    found = []
    for gap in range(1, NEAR + 1):
        a, b = ids[:-gap], ids[gap:]
        keep = useful[a] & useful[b] & (a != b)
        found.append((np.minimum(a, b) << BITS | np.maximum(a, b))[keep])
    return np.unique(np.concatenate(found))


@dataclass
class Machine:
    features: np.ndarray  # sorted feature numbers
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scorer(self) -> Callable[[str], float]:
        """The score of one text; places and known words are kept between texts."""
        places = {int(f): k for k, f in enumerate(self.features)}
        known: dict[str, tuple] = {}

        def score(text: str) -> float:
            hits: set[int] = set()
            for w in set(words_of(text)):
                found = known.get(w)
                if found is None:
                    found = tuple(places[f] for f in hashed(w) if f in places)
                    if len(known) < MOST_KNOWN:
                        known[w] = found
                if found:
                    hits.update(found)
            at = sorted(hits)
            v = self.factors[at]
            z = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of x over the stretches between starts, some of which may be empty."""
    total = np.zeros((len(x) + 1, *x.shape[1:]))
    np.cumsum(x, 0, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, features: np.ndarray) -> Machine:
    """rows: places in features of each document. Minibatch steps (Adagrad) on the logistic loss, for the features of the batch only."""
    rate = float(labels.mean()) if len(labels) else 0.0
    n, rng = len(features), np.random.default_rng(5)
    bias = float(np.log((rate + 1e-9) / (1 - rate + 1e-9)))
    if n == 0 or not 0 < rate < 1:
        return Machine(features[:0], float(np.clip(bias, -30, 30)), np.zeros(0), np.zeros((0, FACTORS)))
    p = np.hstack([np.zeros((n, 1)), rng.normal(0, 0.02, (n, FACTORS))])  # weight, then factors
    seen, seen_bias = np.full_like(p, 1e-6), 1e-6
    for _ in range(EPOCHS):
        for pick in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            sizes = np.array([len(rows[r]) for r in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            used, at = np.unique(np.concatenate([rows[r] for r in pick]), return_inverse=True)
            q = p[used]
            x = q[at]
            s = _sums(x, starts)
            z = bias + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(1) - _sums((x[:, 1:] ** 2).sum(1), starts))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            each, s = np.repeat(e, sizes), np.repeat(s, sizes, 0)
            g = DECAY * q
            g[:, 0] += np.bincount(at, each, len(used))
            for k in range(1, FACTORS + 1):
                g[:, k] += np.bincount(at, each * (s[:, k] - x[:, k]), len(used))
            seen[used] += g * g
            p[used] = q - RATE * g / np.sqrt(seen[used])
            seen_bias += e.sum() ** 2
            bias -= RATE * e.sum() / np.sqrt(seen_bias)
    return Machine(features, float(bias), p[:, 0].copy(), p[:, 1:].copy())


def _chi2(n: int, ones: int) -> Column:
    """How far the texts of a row (n of them, `ones` of label 1) are from going with the labels by chance."""
    away = F.col("ones") * n - F.col("n") * ones
    return F.try_divide(away.cast("double") * away * n, (F.col("n") * (n - F.col("n"))).cast("double") * (ones * (n - ones)))


def _telling_pairs(texts: DataFrame, n: int, ones: int, useful: np.ndarray) -> DataFrame:
    """Pairs of words that go with label 1: counted in texts of label 1 first, then, those that are left, in the others.

    The pairs left are sent as SLOTS bits, so that tasks get half a megabyte whatever their number; the join after it is exact.
    """

    def counted(part: DataFrame, slots: np.ndarray | None) -> DataFrame:
        @releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = None if slots is None else np.unpackbits(slots).view(bool)
            allowed = np.unpackbits(useful).view(bool)
            for x in batches:
                for text in x.column(0).to_pylist():
                    pairs = pairs_of(text, allowed)
                    if bits is not None:
                        pairs = pairs[bits[pairs % (SLOTS - 1)]]
                    if len(pairs):
                        yield pa.record_batch([pa.array(pairs)], names=["pair"])

        return part.select("text").mapInArrow(run, "pair long").groupBy("pair").agg(F.count(F.lit(1)).alias("n"))

    toxic = cut(counted(texts.filter("toxic = 1"), None).filter(F.col("n") >= LEAST_PAIR), "toxic-pairs")
    slots = np.zeros(SLOTS, bool)
    slots[toxic.select((F.col("pair") % (SLOTS - 1)).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)] = True
    others = counted(texts.filter("toxic = 0"), np.packbits(slots)).withColumnRenamed("n", "zeros")
    both = toxic.withColumnRenamed("n", "ones").join(others, "pair", "left").withColumn("n", F.col("ones") + F.coalesce("zeros", F.lit(0)))
    return both.filter((_chi2(n, ones) >= LEAST_PAIR_CHI2) & (F.col("ones") * n > F.col("n") * ones)).select("pair")


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """The rows with the smallest `most` values of place, a hash of 64 bits."""
    if rows.count() <= most:
        return rows
    last = rows.select("place").orderBy("place").limit(most).agg(F.max("place")).first()[0]
    return rows.filter(F.col("place") <= last)


def fit(docs: DataFrame, labels: DataFrame, least_chi2: float = LEAST_CHI2, most_labelled: int = MOST_LABELLED) -> Machine:
    """Fit on rows of labels (doc_id, toxic) outside the held-out fold."""
    sample = labels.filter(F.col("toxic").isNotNull() & (remainder("doc_id", HELD_OUT_OF) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)  # 16 bytes a row: 320 kB at most

    @releasing
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = [sorted(set().union(*map(hashed, set(words_of(t))))) for t in x.column(1).to_pylist()]
            yield pa.record_batch([x.column(0), x.column(1), x.column(2), pa.array(sets, pa.list_(pa.int32()))], names=["toxic", "text", "place", "features"])

    labelled = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    each = labelled.groupBy("doc_id", "text").agg(F.max("toxic").alias("toxic")).select("toxic", "text", F.xxhash64("doc_id", "text").alias("place"))
    rows = _bounded(cut(each.mapInArrow(terms, "toxic int, text string, place long, features array<int>"), "labelled"), most_labelled)
    texts = cut(rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.first("features").alias("features")), "labelled-texts")
    n, ones = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = cut(texts.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("ones")), "features")
    useful = np.zeros(1 << BITS, bool)  # a pair in LEAST_PAIR texts of label 1 has no word in fewer
    useful[counts.filter(F.col("ones") >= LEAST_PAIR).select("feature").toPandas()["feature"].to_numpy(np.int64)] = True
    pairs = _telling_pairs(texts, n, ones, np.packbits(useful))
    in_pairs = pairs.select(F.explode(F.array(F.shiftright("pair", BITS), F.col("pair") % (1 << BITS)).cast("array<int>")).alias("feature"))
    alone = counts.filter((F.col("n") >= LEAST_DOCS) & (_chi2(n, ones) >= least_chi2)).select("feature")
    features = np.sort(alone.union(in_pairs).distinct().toPandas()["feature"].to_numpy(np.int64))  # 2**BITS at most

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = (np.asarray(f, np.int64) for f in x.column(1).to_pylist())
            yield pa.record_batch([x.column(0), pa.array([f[np.isin(f, features)].astype(np.int32) for f in sets], pa.list_(pa.int32()))], names=["toxic", "features"])

    picked = rows.select("toxic", "features").mapInArrow(known, "toxic int, features array<int>").toPandas()  # most_labelled rows at most
    at = [np.searchsorted(features, np.asarray(x, np.int64)) for x in picked["features"]]
    order = sorted(range(len(at)), key=lambda k: (at[k].tobytes(), int(picked["toxic"][k])))  # the order of rows isn't Spark's promise
    return fit_machine([at[k] for k in order], picked["toxic"].to_numpy(float)[order], features)


def scorer(machine: Machine):
    """A vectorised function from texts to scores from 0 to 1. Texts become Python strings one at a time."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scored = machine.scorer()
        for texts in releasing(iter)(batches):
            yield pa.array([scored(t.as_py() or "") for t in texts], pa.float64())

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    of = scorer(fit(docs, labels))
    out = docs.select("doc_id", F.coalesce(remainder("doc_id", HELD_OUT_OF) == 0, F.lit(False)).alias("held_out"), of(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the machine doesn't reject, in docs' columns."""
    of = scorer(fit(docs, labels))
    return docs.filter(of(F.col("text").cast("string")) < 0.5)
