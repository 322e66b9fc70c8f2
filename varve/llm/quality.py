"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy measure how many
characters lie inside duplicated n-grams and duplicated lines.

Rows: a null or empty text has no words, so it fails the base rule. The rules see whole texts, one row at
a time; repeated rows get the same verdict, an empty table gives an empty result, and columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Most share of a text's word characters inside n-grams that occur twice or more, by n.
MOST_IN_NGRAMS = {5: 0.15, 7: 0.13, 10: 0.10}
#: Most share of characters in lines that occur twice or more.
MOST_IN_LINES = 0.30
LEAST_WORDS, MOST_REPEAT_PERCENT, WINDOW = 50, 50, 3

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_coverage double, " + ", ".join(f"coverage_{n} double" for n in MOST_IN_NGRAMS)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets]


def _covered(hashes: np.ndarray, row: np.ndarray, counts: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Words inside an n-gram that its text has twice or more."""
    covered = np.zeros(len(hashes) + 1, np.int64)
    grams = T.ngrams(hashes, n)
    at = np.flatnonzero(T.whole(counts, first, n, len(grams)))
    if len(at):
        keys = T.mix(grams[at] + T._STEP * row[at].astype(np.uint64))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = at[twice]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + n, -1)
    return np.cumsum(covered[:-1]) > 0


def _lines(text: bytes) -> tuple[int, int]:
    """Lines equal to an earlier one, and characters in lines that occur twice or more; only lines with words."""
    if b"\n" not in text:
        return 0, 0
    lines = Counter(x for x in text.split(b"\n") if x.strip())
    twice = [(x, n) for x, n in lines.items() if n > 1]
    return sum(n - 1 for _, n in twice), sum(n * len(b"".join(x.split()).decode("utf-8", "replace")) for x, n in twice)


def _slice(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, first = T.words(data, offsets)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    lead = np.concatenate([[0], np.cumsum(T.LEAD[data], dtype=np.int64)])
    chars = lead[ends] - lead[starts]
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[first])
    hashes = T.hash_spans(data, starts, ends)
    word_chars = sums(chars)
    share = lambda x: x / np.maximum(word_chars, 1)
    repeat = sums(_covered(hashes, row, counts, first, WINDOW))
    coverage = {n: share(sums(chars * _covered(hashes, row, counts, first, n))) for n in MOST_IN_NGRAMS}
    raw = data.tobytes()
    lines = np.array([_lines(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64).reshape(-1, 2)
    in_lines = share(lines[:, 1])
    failed = (counts < LEAST_WORDS) | (100 * repeat > MOST_REPEAT_PERCENT * counts)
    kept = ~failed & (in_lines <= MOST_IN_LINES)
    for n, most in MOST_IN_NGRAMS.items():
        kept &= coverage[n] <= most
    return [counts, word_chars, np.diff(_per_row(_SYMBOL[data], offsets)), lines[:, 0], repeat, failed, kept, in_lines, *coverage.values()]


def assess(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each row, base_failed and kept."""

    @T.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.bytes_of(batch.column(1))
            for i, j in T.slices(offsets):
                columns = _slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.record_batch([batch.column(0).slice(i, j - i), *map(pa.array, columns)], names=names)

    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", *(x.strip().split()[0] for x in SCHEMA.split(","))]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def drop_poor(docs: DataFrame) -> DataFrame:
    """docs that are kept, in docs' columns: each row by its own text, whatever its id."""

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        data, offsets = T.bytes_of(pa.array(texts, pa.string()))
        kept = [_slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[6] for i, j in T.slices(offsets)]
        return pd.Series(np.concatenate(kept) if kept else np.zeros(0, bool))

    return docs.filter(passes(F.col("text").cast("string")))
