"""Class-based n-gram scoring: Brown clustering by exchange, class transitions and word emissions.

Every training word gets a class of its own by likelihood. The SEEDS most frequent words are clustered first: Spark
counts which of them follow each other, and exchange clustering moves them between CLASSES classes while the
likelihood of the class bigrams rises. Then Spark counts for every other word, rare ones too, which classes stand
before and after it, and an exchange step puts it where that likelihood is largest. Texts are turned into word numbers
once and from those into paths of classes; transitions are counted on the paths of all training texts. A text's score
is the sum over tokens of log10 P(class | class before) + log10 P(word | class). Words that are at least one in HEAD
tokens are broadcast (so there are HEAD at most); all other words of a text are joined with the table of words.

Smoothing: transitions are mixed with the classes' own shares; in each class unseen words share one extra count
each way: P(word | class) = (count + 1) / (tokens of the class + words of the class + 1). A word that no training text
has is given to the class with the most words that occur once.

Rows: null or empty texts are the end token alone. Rows without doc_id belong to the training part. Repeated rows
count each for itself. Without training documents all counts are 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import cut
from .toxicity import remainder

SEEDS, CLASSES, SWEEPS = 1024, 48, 12
#: A word is sent to all tasks if it is one in HEAD tokens or more, and not longer than HEAD_BYTES: HEAD words at most.
HEAD, HEAD_BYTES = 1_000_000, 32
#: While seeds are clustered, all other words are one unit with a class of its own, and so is the end token.
UNITS, REST_UNIT, END_UNIT = SEEDS + 2, SEEDS, SEEDS + 1
END_CLASS, REST_CLASS, CONTEXTS = CLASSES, CLASSES + 1, CLASSES + 2
#: Weight of the class bigram against the class's own share.
BIGRAM = 0.98
HELD_OUT_OF, HELD_OUT = 7, 2


class Numbers(dict):
    """From a word that is sent to all tasks to its number; -1 for any other."""

    def __missing__(self, word: bytes) -> int:
        return -1


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # for bytes: A-Z only, and ASCII white space


def _texts(x: pa.RecordBatch, column: int) -> Iterator[bytes | None]:
    return (t.as_py() for t in x.column(column).cast(pa.large_binary()))


def count_words(train: DataFrame) -> DataFrame:
    """word (binary; empty: the end token) and count. Each task adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter = Counter()
        ends = 0

        def out() -> pa.RecordBatch:
            if ends:
                have[b""] += ends
            made = pa.record_batch([pa.array(list(have), pa.binary()), pa.array(list(have.values()), pa.int64())], names=["word", "n"])
            have.clear()
            return made

        for x in batches:
            for text in _texts(x, 0):
                have.update(tokens(text))
                ends += 1
            if len(have) > 500_000:
                yield out()
                ends = 0
        if have or ends:
            yield out()

    return train.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def first_other(head: list | dict) -> int:
    """Numbers below SEEDS are seeds', even where there are fewer words in head."""
    return max(len(head), SEEDS)


def number(docs: DataFrame, head: list[bytes]) -> DataFrame:
    """doc_id, held_out, rid, ids (a 32-bit number for each word: its place in head, or first_other(head) and more for
    the text's other words), others (those words, each once)."""
    sent = docs.sparkSession.sparkContext.broadcast(head)

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, n = Numbers({w: k for k, w in enumerate(sent.value)}), first_other(sent.value)
        for x in batches:
            ids, others = [], []
            for text in _texts(x, 2):
                words = tokens(text)
                row = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                own: dict[bytes, int] = {}
                for at in np.flatnonzero(row < 0).tolist():
                    row[at] = own.setdefault(words[at], n + len(own))
                ids.append(row.astype("<i4").tobytes())
                others.append(list(own))
            yield pa.record_batch([x.column(0), x.column(1), pa.array(ids, pa.binary()), pa.array(others, pa.list_(pa.binary()))], names=["doc_id", "held_out", "ids", "others"])

    kind = dict(docs.dtypes)["doc_id"]
    numbered = docs.select("doc_id", _held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, held_out boolean, ids binary, others array<binary>")
    return cut(numbered.withColumn("rid", F.monotonically_increasing_id()), "numbered")


def _held_out() -> Column:
    return F.coalesce(remainder("doc_id", HELD_OUT_OF) == HELD_OUT, F.lit(False))


def _rows(x: pa.RecordBatch, column: int, kind: str) -> Iterator[np.ndarray]:
    return (np.frombuffer(b.as_py(), kind) for b in x.column(column))


def _pair_counts(rows: DataFrame, column: str, kind: str, states: int, state_of: Callable[[np.ndarray], np.ndarray], end: int) -> DataFrame:
    """cell (states * state before + state; the end comes before the first and after the last) and its count n."""

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(states * states, np.int64)
        for x in batches:
            paths = [np.concatenate([[end], state_of(row), [end]]).astype(np.int64) for row in _rows(x, 0, kind)]
            for k in range(0, len(paths), 1000):
                have += np.bincount(np.concatenate([p[:-1] * states + p[1:] for p in paths[k : k + 1000]]), minlength=len(have))
        at = np.flatnonzero(have)
        for k in range(0, len(at), 100_000):
            yield pa.record_batch([pa.array(at[k : k + 100_000].astype(np.int32)), pa.array(have[at[k : k + 100_000]])], names=["cell", "n"])

    return rows.select(column).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def count_bigrams(train: DataFrame) -> DataFrame:
    """Bigrams of units in the rows of number()."""
    return _pair_counts(train, "ids", "<i4", UNITS, lambda ids: np.where(ids < SEEDS, ids, REST_UNIT), END_UNIT)


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, fixed: int = 1) -> np.ndarray:
    """The class of each unit. counts: a square table of unit bigrams; the last `fixed` units keep a class of their own each.

    Each step takes one unit out of its class and puts it where sum n(a,b) log n(a,b) - sum n(a) log n(a) - sum
    n(b) log n(b) over class bigrams is largest.
    """
    units = len(counts)
    weight = counts.sum(0) + counts.sum(1)
    order = np.argsort(-weight[:-fixed], kind="stable")
    of = np.empty(units, np.int64)
    of[order] = np.arange(units - fixed) % classes
    of[-fixed:] = classes + np.arange(fixed)
    one = np.zeros((units, classes + fixed))
    one[np.arange(units), of] = 1
    right, left = counts @ one, counts.T @ one  # unit by class: after it, before it
    table = one.T @ right
    f = lambda x: x * np.log(np.maximum(x, 1))
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            a, own = of[u], counts[u, u]
            r, c = right[u].copy(), left[u].copy()
            r[a] -= own
            c[a] -= own
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= own
            base = table[:classes]
            rows, cols = f(base + r).sum(1) - f(base).sum(1), f(table[:, :classes].T + c).sum(1) - f(table[:, :classes].T).sum(1)
            diag = np.diagonal(table)[:classes]
            both = f(diag + r[:classes] + c[:classes] + own) - f(diag) - (f(diag + r[:classes]) - f(diag)) - (f(diag + c[:classes]) - f(diag))
            out_n, in_n = table.sum(1)[:classes], table.sum(0)[:classes]
            gain = rows + cols + both - (f(out_n + r.sum() + own) - f(out_n)) - (f(in_n + c.sum() + own) - f(in_n))
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            table[b] += r
            table[:, b] += c
            table[b, b] += own
            if b != a:
                moved += 1
                of[u] = b
                for m, n in ((right, counts[:, u]), (left, counts[u])):
                    m[:, a] -= n
                    m[:, b] += n
        if not moved:
            break
    return of


def seed_classes(bigrams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The class of each seed and the table of class bigrams with REST_CLASS, fitted in one task: UNITS * UNITS cells at
    most, whatever the corpus."""
    turn = np.arange(CONTEXTS)
    turn[[CLASSES, CLASSES + 1]] = REST_CLASS, END_CLASS  # exchange() gives REST_UNIT and END_UNIT their classes in this order

    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros(UNITS * UNITS, np.float64)
        counts[table["cell"].to_numpy()] = table["n"].to_numpy()
        counts = counts.reshape(UNITS, UNITS)
        of = turn[exchange(counts, fixed=2)]
        one = np.zeros((UNITS, CONTEXTS))
        one[np.arange(UNITS), of] = 1
        flat = (one.T @ counts @ one).ravel()
        return pa.table({"k": np.arange(UNITS + len(flat)), "v": np.concatenate([of.astype(float), flat])})

    got = bigrams.groupBy(F.lit(0).alias("all")).applyInArrow(run, "k long, v double").toPandas().sort_values("k")["v"].to_numpy()
    if not len(got):
        return np.arange(SEEDS) % CLASSES, np.zeros((CONTEXTS, CONTEXTS))
    return got[:SEEDS].astype(np.int64), got[UNITS:].reshape(CONTEXTS, CONTEXTS)


_ENTRY = np.dtype([("pair", "<u2"), ("n", "<u4")])


def _entries(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of packed ones, and how many each row has."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(_ENTRY), np.diff(offsets) // _ENTRY.itemsize


def contexts(train: DataFrame, head: list[bytes], seeds: np.ndarray) -> DataFrame:
    """word and entries (pair: CONTEXTS * class before + class after, and how often, packed) of every word that isn't a
    seed, from the rows of number(); several rows for a word."""
    sent = train.sparkSession.sparkContext.broadcast(head)

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, waiting, size = pa.array(sent.value, pa.binary()), [], 0
        base = first_other(words)

        def counted(codes: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
            codes, n = np.unique(codes, return_counts=True)
            word, pair = np.divmod(codes, CONTEXTS * CONTEXTS)
            packed = np.empty(len(codes), _ENTRY)
            packed["pair"], packed["n"] = pair, n
            first = np.flatnonzero(np.diff(word, prepend=-1))
            for k in range(0, len(first), 50_000):
                ends = np.append(first, len(codes))[k : k + 50_001]
                offsets = pa.py_buffer(((ends - ends[0]) * _ENTRY.itemsize).astype(np.int32))
                entries = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(packed[ends[0] : ends[-1]].tobytes())])
                yield pa.record_batch([names.take(pa.array(word[ends[:-1]])), entries], names=["word", "entries"])

        for x in batches:
            others = x.column(1)
            starts = np.asarray(others.offsets)[: x.num_rows] - others.offsets[0].as_py()
            rare = []
            for first, ids in zip(starts.tolist(), _rows(x, 0, "<i4")):
                path = np.full(len(ids) + 2, REST_CLASS)
                path[[0, -1]] = END_CLASS
                seed = ids < SEEDS
                path[1:-1][seed] = seeds[ids[seed]]
                codes = ids.astype(np.int64) * (CONTEXTS * CONTEXTS) + path[:-2] * CONTEXTS + path[2:]
                waiting.append(codes[~seed & (ids < base)])
                rare.append(codes[ids >= base] + (first - base) * (CONTEXTS * CONTEXTS))
                size += len(waiting[-1])
            yield from counted(np.concatenate(rare), others.flatten())
            if size > 3_000_000:
                yield from counted(np.concatenate(waiting), words)
                waiting, size = [], 0
        if waiting:
            yield from counted(np.concatenate(waiting), words)

    return train.select("ids", "others").mapInArrow(run, "word binary, entries binary")


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_classes(row: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray, rows: int, table: np.ndarray) -> np.ndarray:
    """The class of each of `rows` words: an exchange step for each by itself. Entry k says that word row[k] was seen n[k]
    times between the classes before[k] and after[k]; table holds the class bigrams."""
    gain = np.zeros((rows, CLASSES))
    sides = {}
    for side, (neighbour, cells) in {"out": (after, table[:CLASSES]), "in": (before, table[:, :CLASSES].T)}.items():
        key, at = np.unique(row * CONTEXTS + neighbour, return_inverse=True)
        many = np.bincount(at, n, len(key))
        word, c = np.divmod(key, CONTEXTS)
        sides[side] = np.zeros((rows, CONTEXTS))
        sides[side][word, c] = many
        for k in range(0, len(key), 20_000):
            w, old = word[k : k + 20_000], cells[:, c[k : k + 20_000]].T
            more = _f(old + many[k : k + 20_000, None]) - _f(old)
            first = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[first]] += np.add.reduceat(more, first)
        total, sums = np.bincount(row, n, rows)[:, None], cells.sum(1)[None, :]
        gain -= _f(sums + total) - _f(sums)
    d, r, c = np.diagonal(table)[None, :CLASSES], sides["out"][:, :CLASSES], sides["in"][:, :CLASSES]
    w, k = np.nonzero((r > 0) & (c > 0))  # a cell that both sides add to
    d, r, c = np.broadcast_to(d, gain.shape)[w, k], r[w, k], c[w, k]
    gain[w, k] += _f(d + r + c) - _f(d + r) - _f(d + c) + _f(d)
    filled = table[:CLASSES].sum(1) > 0
    if filled.any():  # a class without seeds suits each word best as long as it's alone there, so all would meet in it
        gain[:, ~filled] = -np.inf
    return np.argmax(gain, 1)


def assign(seen: DataFrame, table: np.ndarray) -> DataFrame:
    """word, c (its count) and k (its class) from the rows of contexts(). A word's rows are read one after the other, so
    a task holds the entries of one batch, and of one word those of its different pairs. No word here is a seed, so
    none has more than one in SEEDS tokens."""

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Array | None = None  # the last word so far and its entries: its rows may go on in the next batch
        kept = np.zeros(0, _ENTRY)

        def placed(words: pa.Array, row: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
            pair, n = entries["pair"].astype(np.int64), entries["n"].astype(np.int64)
            of = best_classes(row, pair // CONTEXTS, pair % CONTEXTS, n, len(words), table)
            return pa.record_batch([words, pa.array(np.bincount(row, n, len(words)).astype(np.int64)), pa.array(of.astype(np.int32))], names=["word", "c", "k"])

        for x in batches:
            if not x.num_rows:
                continue
            entries, many = _entries(x.column(1))
            words = pa.concat_arrays([held if held is not None else x.column(0).slice(0, 1), x.column(0)])
            row = np.append(0, np.cumsum(pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)))
            words = words.take(pa.array(np.flatnonzero(np.diff(row, prepend=-1))))
            row, entries = np.repeat(row, np.append(len(kept), many)), np.concatenate([kept, entries])
            last = row == len(words) - 1
            for k in range(0, len(words) - 1, 2000):
                some = (row >= k) & (row < min(k + 2000, len(words) - 1))
                yield placed(words.slice(k, min(2000, len(words) - 1 - k)), row[some] - k, entries[some])
            held = words.slice(len(words) - 1)
            pair, at = np.unique(entries["pair"][last], return_inverse=True)
            kept = np.empty(len(pair), _ENTRY)
            kept["pair"], kept["n"] = pair, np.bincount(at, entries["n"][last], len(pair))
        if held is not None:
            yield placed(held, np.zeros(len(kept), np.int64), kept)

    return seen.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, c long, k int")


OPEN = 255


def _resolved(numbered: DataFrame, lexicon: DataFrame, head: dict[bytes, tuple[int, int]], unseen: int) -> DataFrame:
    """doc_id, held_out, n_words, n_known, logs (sum of log10(count + 1)) and path (a class for each word, as bytes)."""
    words = numbered.select("rid", F.posexplode("others").alias("at", "word"))
    found = words.join(lexicon, "word").groupBy("rid").agg(F.collect_list(F.struct("at", "c", "k")).alias("found"))
    sent = numbered.sparkSession.sparkContext.broadcast(head)
    kind = dict(numbered.dtypes)["doc_id"]

    @T.releasing
    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, classes = np.array([*sent.value.values(), (0, OPEN)], np.int64).T  # the last for all words that aren't in head
        logs, classes, base = np.log10(counts + 1), classes.astype(np.uint8), first_other(sent.value)
        for x in batches:
            out = []
            for ids in _rows(x, 3, "<i4"):
                at = np.minimum(ids, len(logs) - 1)
                rest = ids[ids >= base] - base
                out.append((len(ids), len(ids) - len(rest), float(logs[at].sum()), classes[at].tobytes(), rest.astype("<i4").tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
            yield pa.record_batch([*x.columns[:3], *map(pa.array, zip(*out), kinds), x.column(4)], names=["doc_id", "held_out", "rid", "n_words", "n_known", "logs", "path", "rest", "many"])

    begun = numbered.select("doc_id", "held_out", "rid", "ids", F.size("others").alias("many"))
    begun = begun.mapInArrow(half, f"doc_id {kind}, held_out boolean, rid long, n_words long, n_known long, logs double, path binary, rest binary, many int")

    @T.releasing
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for k, (known, logs, path, rest, many) in enumerate(zip(*(x.column(c).to_pylist() for c in range(3, 8)))):
                if many:
                    path, rest = np.frombuffer(path, np.uint8).copy(), np.frombuffer(rest, "<i4")
                    c, of = np.zeros(many, np.int64), np.full(many, unseen, np.uint8)
                    if x.column(8)[k].is_valid:
                        at, more, kinds = (v.to_numpy() for v in pa.RecordBatch.from_struct_array(x.column(8)[k].values).columns)
                        c[at], of[at] = more, kinds
                    path[path == OPEN] = of[rest]
                    known, logs, path = known + int((c[rest] > 0).sum()), logs + float(np.log10(c[rest] + 1).sum()), path.tobytes()
                out.append((known, logs, path))
            yield pa.record_batch([*x.columns[:3], *map(pa.array, zip(*out), (pa.int64(), pa.float64(), pa.binary()))], names=["doc_id", "held_out", "n_words", "n_known", "logs", "path"])

    rows = begun.join(found, "rid", "left").select("doc_id", "held_out", "n_words", "n_known", "logs", "path", "rest", "many", "found")
    return cut(rows.mapInArrow(fill, f"doc_id {kind}, held_out boolean, n_words long, n_known long, logs double, path binary"), "paths")


@dataclass
class Model:
    numbered: DataFrame  # the rows of number()
    lexicon: DataFrame  # word, c, k of every training word
    head: dict[bytes, int]  # words that are sent to all tasks, the most frequent first, and their counts
    n: int  # training tokens
    v: int  # distinct ones
    ends: int


def fit(docs: DataFrame) -> Model:
    """Count words, number the texts, cluster the seeds and give every other word its class."""
    counts = cut(count_words(docs.filter(~_held_out())), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = counts.filter((F.col("c") * HEAD >= n) & F.length("word").between(1, HEAD_BYTES)).collect()  # HEAD rows at most, as the counts add up to n
    head = {bytes(w): c for w, c in sorted(frequent, key=lambda r: (-r[1], bytes(r[0])))}
    ends = sum(r[0] for r in counts.filter("length(word) = 0").select("c").collect())
    numbered = number(docs, list(head))
    train = numbered.filter(~F.col("held_out"))
    seeds, table = seed_classes(count_bigrams(train))
    rest = assign(contexts(train, list(head), seeds), table)
    known = list(zip(list(head.items())[:SEEDS], seeds.tolist()))
    own = docs.sparkSession.createDataFrame([(bytearray(w), c, k) for (w, c), k in known], "word binary, c long, k int")
    return Model(numbered, cut(rest.union(own), "lexicon"), head, n, v, ends)


def score(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    m = fit(docs)
    n, v, ends = m.n, m.v, m.ends
    per_class = np.zeros((CLASSES + 1, 2))  # tokens and words
    per_class[END_CLASS] = ends, ends > 0
    once = np.zeros(CLASSES, np.int64)
    for k, c, words, ones in m.lexicon.groupBy("k").agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1)).collect():
        per_class[k], once[k] = (c, words), ones
    frequent = (F.col("c") * HEAD >= n) & (F.length("word") <= HEAD_BYTES)
    of = {bytes(w): k for w, k in m.lexicon.filter(frequent).select("word", "k").collect()}  # the words of head
    head = {w: (c, of[w]) for w, c in m.head.items()}
    paths = _resolved(m.numbered, m.lexicon.filter(~frequent), head, int(np.argmax(once)))
    table = np.zeros((CLASSES + 1) ** 2)
    for cell, many in _pair_counts(paths.filter(~F.col("held_out")), "path", "u1", CLASSES + 1, lambda row: row, END_CLASS).collect():  # a cell for each pair of classes
        table[cell] = many
    table = table.reshape(CLASSES + 1, CLASSES + 1)
    share = (per_class[:, 0] + 1) / (per_class[:, 0].sum() + CLASSES + 1)
    rows_sum = table.sum(1, keepdims=True)
    step = np.log10(BIGRAM * np.where(rows_sum > 0, table / np.maximum(rows_sum, 1), share) + (1 - BIGRAM) * share)
    emit = -np.log10(per_class[:, 0] + per_class[:, 1] + 1)
    end_emit, base_each = emit[END_CLASS] + math.log10(ends + 1), -math.log10(n + v + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for row in _rows(x, 5, "u1"):
                path = np.concatenate([[END_CLASS], row, [END_CLASS]]).astype(np.int64)
                out.append(float(step[path[:-1], path[1:]].sum() + emit[row].sum() + end_emit))
            yield pa.record_batch([*x.columns[:5], pa.array(out, pa.float64())], names=["doc_id", "held_out", "n_words", "n_known", "logs", "fixed"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = paths.select("doc_id", "held_out", "n_words", "n_known", "logs", "path").mapInArrow(sums, f"doc_id {kind}, held_out boolean, n_words long, n_known long, logs double, fixed double")
    tokens_of = F.col("n_words") + 1
    out = scored.select(
        "doc_id", "held_out", tokens_of.alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(ends + 1) + tokens_of * base_each).alias("base_score"), (F.col("logs") + F.col("fixed")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
