"""Each stage of the pipeline on its predecessor's output, against brute force on that same output."""

from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.llm.test_dedup import WORDS, brute_components, brute_repeats

NAMES = ["toxicity", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]


def write(path, rows, labels):
    path.mkdir()
    ids, texts = zip(*rows) if rows else ((), ())
    docs = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * len(ids), pa.string()), "source": pa.array(["s"] * len(ids), pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(docs), path / "documents.parquet")
    d, t = zip(*labels) if labels else ((), ())
    pq.write_table(pa.table({"doc_id": pa.array(d, pa.int64()), "quality": pa.array([1] * len(d), pa.int32()), "toxic": pa.array(t, pa.int32())}), path / "labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    rng = random.Random(8)
    words = ["w%d" % k for k in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, toxic, k = [(0, None), (1, ""), (2, "short")], set(), 3
    for _ in range(250):
        t = text(rng.randint(60, 160))
        if rng.random() < 0.3:
            t[5:5] = ["scoundrel", "martians"]
            toxic.add(k)
        rows.append((k, " ".join(t)))
        k += 1
    clean = [r for r in rows if r[0] not in toxic and r[1]]
    passage = " ".join(text(70))
    for d, t in clean[2:40]:
        rows.append((k, t))
        w = t.split()
        w[7] = "changed%d" % k
        rows.append((k + 1, " ".join(w)))
        rows.append((k + 2, " ".join(text(60)) + "\n" + passage))
        k += 3
    return rows, toxic


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES


def test_stages_against_brute_force(spark, corpus, tmp_path):
    rows, toxic = corpus
    sf = write(tmp_path / "sf", rows, [(d, int(d in toxic)) for d, _ in rows])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    texts = lambda name: sorted((r.doc_id, r.text or "") for r in kept[name])
    left = {d for d, _ in texts("toxicity")}
    assert not left & toxic and left >= {d for d, _ in rows} - toxic
    last = {t: d for d, t in texts("toxicity")}
    assert texts("exact_dedup") == sorted((d, t) for t, d in last.items())
    alone = {d for d, _, _, stays in brute_components(texts("exact_dedup"), 80) if stays}
    assert {d for d, _ in texts("near_dedup")} == alone
    gone = brute_repeats(texts("near_dedup"))
    want = {d: [w for i, w in enumerate(WORDS.findall(t)) if i not in gone.get(d, ())] for d, t in texts("near_dedup")}
    got = dict(texts("suffix_dedup"))
    assert gone and {d: w for d, w in want.items() if w or d not in gone} == {d: WORDS.findall(t) for d, t in got.items()}
    pieces = defaultdict(int)
    for r in kept["packing"]:
        pieces[r.doc_id] += r.length
        assert r.offset + r.length <= 2048
    assert set(pieces) == set(got) and all(pieces[r.doc_id] == r.doc_tokens for r in kept["packing"])


def test_run_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(tmp_path / "sf", [], [])).collect() == []
