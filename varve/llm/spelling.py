"""Spelling variants: words that differ by one code point, found by Aho-Corasick automata over halves of words.

One edit leaves one of a word's two halves as it was, at the start or at the end of the other word. Of the half that
was edited, one of its own halves is as it was, too. A word goes to the shard of each of its two halves with either
part of the rest, and is scanned by the shards that can hold a half of a word near it: those of the heads and tails
it would share with words one shorter, as long, and one longer. A shard's automaton holds the halves of its words and
runs over all words sent there; a hit counts at the very start or end only, for words of a fitting length whose other
part agrees, too, and the distance is then verified. A pair that several halves could find is taken by the first of
them alone, so that near words are counted once without bringing pairs together.

Words are runs of Latin letters, lower-cased in A-Z only, counted over whole texts; see `occurrences` for the runs
that lose a code point. Counts are added up per task before they are shuffled, so that frequent words don't meet in
one task. The number of shards follows the number of words.

Rows: null and empty texts have no words. A null doc_id counts as an empty one. Repeated rows count each. Of near words
with equal counts the smallest in code-point order is the form. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import cut

LEAST_LENGTH, LEAST_COUNT, NOISE = 5, 3, 97
#: Rows of one shard, on average; words counted in a task before they are handed on; code points searched at once.
SHARD_ROWS, HELD, STRETCH = 60_000, 200_000, 1 << 20
#: Candidate pairs verified at once, in arrays for words of up to WIDE code points.
PAIRS, WIDE = 1 << 17, 64

RUN = re.compile("[A-Za-zÀ-ÿ]+")
OTHER = re.compile("[^A-Za-zÀ-ÿ]")


def runs_of(text: str) -> Iterator[list[str]]:
    """All runs of a text, lower-cased, stretch by stretch; a stretch ends where no run does."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes lower A-Z alone
    at = 0
    while at < len(text):
        stop = OTHER.search(text, at + STRETCH)
        end = stop.end() if stop else len(text)
        yield RUN.findall(text, at, end)
        at = end


def noisy(run: str, key: int) -> str:
    """The run, less one code point for one key in NOISE. key: the crc32 of `<doc_id>:`."""
    h = crc32(run.encode(), key)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def occurrences(docs: DataFrame) -> DataFrame:
    """word, n: the words of LEAST_LENGTH code points and more, counted in each task."""

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = defaultdict(int)

        def packed() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for x in batches:
            for doc_id, value in zip(x.column(0).to_pylist(), x.column(1)):
                key = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found in runs_of(value.as_py() or ""):
                    for word, n in Counter(found).items():
                        if len(word := noisy(word, key)) >= LEAST_LENGTH:
                            held[word] += n
                    if len(held) >= HELD:
                        yield packed()
        if held:
            yield packed()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "word string, n long")


def keys_of(length: int, size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """How a word of `length` may be found in one of `size` code points: kind, side and code points of the half, and where
    the part of the rest begins and ends in the latter. Of several kinds the first takes a pair."""
    head = length // 2
    tail = length - head
    yield 0, 0, head, head, head + tail // 2
    yield 1, 0, head, size - (tail - tail // 2), size
    yield 2, 1, tail, 0, head // 2
    yield 3, 1, tail, size - tail - (head - head // 2), size - tail


def shards_of(word: str, shards: int) -> Iterator[tuple[int, int]]:
    """shard and kind: where a word is held, and with kind -1 each shard that scans it. Words have LEAST_LENGTH code points
    at least, so that no part that a near word could share is cut off."""
    scanned = set()
    size = len(word)
    for length in (size, size - 1, size + 1):
        for kind, side, half, begin, end in keys_of(length, size):
            shard = crc32(f"{length}:{kind}:{word[size - half :] if side else word[:half]}:{word[begin:end]}".encode()) % shards
            if length == size:
                yield shard, kind
            if shard not in scanned:
                scanned.add(shard)
                yield shard, -1


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of up to WIDE in rows, read from the left and from the right; 0 where there are none, and
    nothing but 0 for longer words."""
    words = [w if len(w) <= WIDE else "" for w in words]
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    left = np.zeros((len(words), int(size.max(initial=0)) + 1), np.uint8)
    right = left.copy()
    left[row, place] = flat
    right[row, size[row] - 1 - place] = flat
    return left, right


def _agreeing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many code points of each row agree before the first that doesn't."""
    differ = one != two
    return np.where(differ.any(1), differ.argmax(1), one.shape[1])


def near_in_shard(words: list[str], kinds: list[int], counts: list[int]) -> dict[str, list]:
    """For each word that is scanned and has near words here: how many, the largest count of one, and that word."""
    automaton, halves = ahocorasick.Automaton(), {}
    held: dict[tuple, list[int]] = defaultdict(list)
    for at, (word, kind) in enumerate(zip(words, kinds)):
        if kind >= 0:
            _, side, half, begin, end = next(k for k in keys_of(len(word), len(word)) if k[0] == kind)
            seg = word[len(word) - half :] if side else word[:half]
            if seg not in halves:
                halves[seg] = len(halves)
                automaton.add_word(seg, (halves[seg], len(seg)))
            held[halves[seg], kind, len(word), word[begin:end]].append(at)
    if not halves:
        return {}
    automaton.make_automaton()
    found: dict[str, list] = {}
    some: list[tuple[int, int, int]] = []
    left, right = _codes(words)

    def verify() -> None:
        u, v, kind = np.array(some, np.int64).T
        size_u, size_v = (np.fromiter((len(words[k]) for k in x), np.int64, len(x)) for x in (u, v))
        most = np.minimum(size_u, size_v)
        lcp, lcs = np.minimum(_agreeing(left[u], left[v]), most), np.minimum(_agreeing(right[u], right[v]), most)
        for k in np.flatnonzero(np.maximum(size_u, size_v) > WIDE).tolist():
            one, two = words[u[k]], words[v[k]]
            lcp[k], lcs[k] = len(commonprefix([one, two])), len(commonprefix([one[::-1], two[::-1]]))
        near = (lcp + lcs >= np.maximum(size_u, size_v) - 1) & ~((size_u == size_v) & (lcp == size_u))
        head, tail = size_v // 2, size_v - size_v // 2
        ways = [lcp >= head + tail // 2, (lcp >= head) & (lcs >= tail - tail // 2), (lcs >= tail) & (lcp >= head // 2), lcs >= tail + head - head // 2]
        first = np.select(ways, [0, 1, 2, 3], -1)
        for k in np.flatnonzero(near & (first == kind)).tolist():
            word, n, other = words[u[k]], counts[v[k]], words[v[k]]
            mine = found.get(word)
            if mine is None:
                found[word] = [1, n, other]
            else:
                mine[0] += 1
                if (-n, other) < (-mine[1], mine[2]):
                    mine[1:] = n, other
        some.clear()

    @lru_cache(1 << 16)
    def fitting(size: int, half: int, side: int) -> list[tuple[int, int, int, int]]:
        """Kind, length of the other word, and the part of this one that must agree."""
        return [(way, length, begin, stop) for length in (size - 1, size, size + 1) for way, at, want, begin, stop in keys_of(length, size) if at == side and want == half]

    for u, (word, kind) in enumerate(zip(words, kinds)):
        if kind >= 0:
            continue
        last = len(word) - 1
        for end, (seg, half) in automaton.iter(word):
            for side in (0,) * (end == half - 1) + (1,) * (end == last):
                for way, length, begin, stop in fitting(last + 1, half, side):
                    for v in held.get((seg, way, length, word[begin:stop]), ()):
                        some.append((u, v, way))
            if len(some) >= PAIRS:
                verify()
    if some:
        verify()
    return found


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (n and word of the near word that is found most): of the words (word, n, without repeats) that
    have near words."""
    shards = max(1, -(-words.count() * 12 // SHARD_ROWS))

    @T.releasing
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(0, x.num_rows, 4000):
                some = x.slice(i, 4000)
                rows = [(shard, kind, n, word) for word, n in zip(*(c.to_pylist() for c in some.columns)) for shard, kind in shards_of(word, shards)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int8(), pa.int64(), pa.string()))], names=["shard", "kind", "n", "word"])

    def search(shard: pa.Table) -> pa.Table:
        found = near_in_shard(*(shard[c].to_pylist() for c in ("word", "kind", "n")))
        n_near, n, other = zip(*found.values()) if found else ((), (), ())
        return pa.table([pa.array(list(found), pa.string()), pa.array(n_near, pa.int64()), pa.array(n, pa.int64()), pa.array(other, pa.string())], names=["word", "n_near", "n", "other"])

    dealt = words.select("word", "n").mapInArrow(deal, "shard int, kind byte, n long, word string")
    found = dealt.groupBy("shard").applyInArrow(search, "word string, n_near long, n long, other string")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("other")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.other").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms from each word of forms (word, form) ends. Each round doubles the steps; as
    a form has at least twice its word's count, a chain is no longer than the count's bits."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word found LEAST_COUNT times and more. A word's form is the near word
    found most, if that is found twice as often as the word or more."""
    words = cut(occurrences(docs).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT), "words")
    near = near_words(words)
    has_form = F.col("best.n") >= 2 * F.col("n")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has_form, F.col("best.word")).alias("form"), F.when(has_form, F.col("best.n")).alias("form_n"))
    known = cut(known, "near")
    out = known.join(roots(known.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
