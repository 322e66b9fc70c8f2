from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from varve.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
CLASH = "start long, length string, sequence_id string, offset boolean"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], f"doc_id long, text string, {CLASH}").repartition(3)


def texts(n=60):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeéüñ'ßœ日1½İ-_.,<|>😀ﬁ") for _ in range(rng.randint(1, 9)))
    odd = [None, "", " \n\t ", "<|endoftext|> x<|endoftext|>y", "don't I'LL we've", "é ́x", "a b　c", "x" * 5000, "ΑΣ ΑΣΑ", "\x1c\x85 a", "ª º ¼ ¾"]
    return odd + [rng.choice([" ", "\n", "\t "]).join(word() for _ in range(rng.choice([1, 5, 80, 900]))) for _ in range(n)] + [" ".join(word() for _ in range(9000))]


def test_ids_are_the_tokenizers(spark, tokenizer):
    rows = list(enumerate(texts()))
    pieces = defaultdict(list)
    for r in packing.pack(frame(spark, rows), PATH).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == {d for d, _ in rows}
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4")
        at = 0
        for p in sorted(pieces[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)


def test_sequences_are_gapless_and_full(spark):
    rows = list(enumerate(texts(2000)))
    windows = defaultdict(list)
    for r in packing.pack(frame(spark, rows).coalesce(1), PATH).collect():
        windows[r.sequence_id].append((r.offset, r.length))
    used = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WIDTH
        used += at
    assert used > 0.99 * packing.WIDTH * len(windows)


def test_repeated_rows_nulls_and_an_empty_table(spark):
    got = packing.pack(frame(spark, [(1, "a"), (1, "a"), (None, None)]), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 2), (1, 2)]
    assert packing.pack(frame(spark, []), PATH).collect() == []


def test_windows_never_exceed_and_their_number_rises():
    rng = random.Random(4)
    for n in (1, 2, 3, 50, 500):
        sizes = [rng.randint(1, 100) for _ in range(n)]
        found = packing.windows(sizes, 100)
        assert sorted(k for w in found for k in w) == list(range(n))
        assert max(sum(sizes[k] for k in w) for w in found) <= 100
    assert len(packing.windows([51] * 4, 100)) == 4  # two would do by size alone
    assert packing.windows([], 100) == []


def test_differencing_beats_greedy_order():
    sums = sorted(sum([8, 7, 6, 5, 4][k] for k in w) for w in packing.difference([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]
