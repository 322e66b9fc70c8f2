from __future__ import annotations

import random

from varve.operators import textsearch
from varve.plans import textindex

KIND = "doc long, title string, brand string"


def same(spark, index, docs, queries):
    """The index answers as one that is built anew."""
    rows = spark.createDataFrame([(k, *v) for k, v in docs.items()], KIND)
    whole, stats = textsearch.postings(rows, "doc", ["title", "brand"]), textsearch.statistics(rows, ["title", "brand"])
    assert [round(x or 0, 9) for x in index.statistics().first()] == [round(x or 0, 9) for x in stats.first()]
    for raw in queries:
        got, want = ({r.doc: round(r.bm25, 9) for r in x.collect()} for x in (index.match(raw), textsearch.match(whole, stats, raw)))
        assert got == want, raw


def test_updates_and_removals_answer_as_a_full_rebuild(spark, tmp_path):
    rng, docs = random.Random(3), {}
    index = textindex.TextIndex(spark, str(tmp_path / "index"))
    word = lambda: rng.choice(["rouge", "rouges", "bleu", "télé", "tele", "oled", "sac", "b2"])
    text = lambda: rng.choice([None, "", " ".join(word() for _ in range(rng.randint(1, 6)))])
    same(spark, index, docs, ["rouge"])
    for step in range(7):
        news = {rng.randrange(40): (text(), text()) for _ in range(9)}
        docs |= news
        index.update(spark.createDataFrame([*((k, *v) for k, v in news.items()), (None, "rouge", "x")], KIND), "doc", ["title", "brand"])
        if step % 2:
            gone = [k for k in rng.sample(range(45), 6)]
            docs = {k: v for k, v in docs.items() if k not in gone}
            index.remove(spark.createDataFrame([(k,) for k in gone + gone[:1]], "doc long"))
        if step in (1, 4, 6):
            same(spark, index, docs, ["rouge", "tele ole", "bleu rou"])
    have = index.manifest()
    assert len(have["segments"]) < 7 and sum(s["docs"] for s in have["segments"]) - sum(m["docs"] for m in have["marks"]) == len(docs)


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    index = textindex.TextIndex(spark, str(tmp_path / "index"))
    index.update(spark.createDataFrame([(1, "rouge", None)], KIND), "doc", ["title", "brand"])
    with monkeypatch.context() as m:
        m.setattr(textindex, "put_file", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        try:
            index.update(spark.createDataFrame([(1, "bleu", None)], KIND), "doc", ["title", "brand"])
        except RuntimeError:
            pass
    same(spark, index, {1: ("rouge", None)}, ["rouge", "bleu"])
