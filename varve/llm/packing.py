"""Packing of documents into training sequences by Karmarkar-Karp multiway differencing.

Each text is tokenised and ended by id 1. Whole runs of `width` ids fill sequences of their own; what is
left of each document, cut into pieces of CUT ids at most, is packed within its task, GROUP documents at a
time: every piece starts as a partial partition of m windows, the two partial partitions with the largest imbalance are merged with
opposing order until one is left, and m rises by one whenever a window exceeds the capacity. No rows are
shuffled, and a task holds one group of pieces.

Rows: a null text counts as empty, and an empty text is the one id 1. Repeated rows are packed each for
itself. A null doc_id stays null. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import releasing

WIDTH, END = 2048, 1
#: Small pieces balance better: with CUT = WIDTH, windows were up to 5 percent padding, with 512 they are under one.
CUT, GROUP = 512, 1024
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words of which a task keeps the ids; others are tokenised again. This bounds memory only.
MOST_CACHED = 150_000


class WordIds(dict):
    """From a word (bytes without ASCII white space) to its ids as little-endian unsigned 32-bit bytes.

    The tokenizer's own splitting never joins what white space divides, so words can be tokenised alone. Words
    of printable ASCII and the letters of Latin-1, which composition leaves as they are, go straight to the BPE
    model after splitting; all others go through the whole tokenizer.
    """

    _plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
    _split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.seen_as = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = np.array([t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.seen_as))], "<u4").tobytes()
            if len(self.parts) < MOST_CACHED:
                self.parts[part] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self._plain(text) and "<|" not in text:
            ids = b"".join(map(self._part, self._split(text.lower())))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < MOST_CACHED and len(word) < 64:
            self[word] = ids
        return ids


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """m windows of positions in sizes with near-equal sums.

    A partial partition is its windows' sums, less the smallest, with their positions, in falling order;
    windows that are still empty are left out.
    """
    heap = [(-size, k, [(size, [k])]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    at = len(sizes)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        met = max(0, len(one) + len(two) - m)  # windows filled in both: the largest sums of one meet the smallest of the other
        a, b = len(one) - met, len(two) - met
        both = [(x + y, v + w) for (x, v), (y, w) in zip(one[a:], reversed(two[b:]))]
        merged = sorted(one[:a] + two[:b] + both, key=lambda x: -x[0])
        if len(merged) == m and merged[-1][0]:
            low = merged[-1][0]
            merged = [(x - low, w) for x, w in merged]
        heapq.heappush(heap, (-merged[0][0] + (merged[-1][0] if len(merged) == m else 0), at, merged))
        at += 1
    return [w for _, w in heap[0][2]]


def windows(sizes: list[int], width: int = WIDTH) -> list[list[int]]:
    """Windows of at most width; their number rises until none exceeds it."""
    if not sizes:
        return []
    m = -(-sum(sizes) // width)
    while True:
        found = [w for w in difference(sizes, m) if w]
        if max(sum(sizes[k] for k in w) for w in found) <= width:
            return found
        m += 1


def pack(docs: DataFrame, tokenizer: str, width: int = WIDTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    tokenizer: path of a tokenizers file with word-wise BPE that drops white space."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        end, cut = np.array([END], "<u4").tobytes(), min(CUT, width)
        task, made = TaskContext.get().partitionId() << 33, 0
        rows: list[tuple] = []
        rest: list[tuple] = []
        waiting = 0

        def placed() -> None:
            nonlocal made, waiting
            for window in windows([x[2] for x in rest], width):
                offset = 0
                for k in window:
                    rows.append((*rest[k], task + made, offset))
                    offset += rest[k][2]
                made += 1
            rest.clear()
            waiting = 0

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            rows.clear()
            return pa.record_batch([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                ids = b"".join(map(ids_of.__getitem__, (text.as_py() or b"").split())) + end
                n = len(ids) // 4
                full = n - n % width
                for start in range(0, full, width):
                    rows.append((doc, start, width, zlib.crc32(ids[4 * start : 4 * (start + width)]), n, task + made, 0))
                    made += 1
                for start in range(full, n, cut):
                    piece = ids[4 * start : 4 * (start + cut)]
                    rest.append((doc, start, len(piece) // 4, zlib.crc32(piece), n))
                waiting += full < n
                if waiting == GROUP:
                    placed()
                if len(rows) > 10_000:
                    yield flushed()
        if rest:
            placed()
        if rows:
            yield flushed()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
