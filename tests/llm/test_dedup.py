from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from varve.llm import exact_dedup, near_dedup, suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "digest string, node long, rid long, sig int, kept boolean, start int, places string, first_doc_id long, spans int, doc int, id int, hash int, sha int, `left` int, keep_id int, __spans int, __digest int, `a.b` int"


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnopéà") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def corpus(seed=3):
    rng = random.Random(seed)
    words = vocabulary(rng)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [None, "", " \n\t", "one", "One", "a b c d", "A b c d", text(20_000)]
    base = [text(rng.randint(60, 300)) for _ in range(25)]
    rows += base + base[:6] + base[:3]
    for t in base[:12]:
        w = t.split()
        for edits in (1, 2, 4, 8):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = rng.choice(words)
            rows.append(rng.choice([" ", "\n"]).join(v).upper() if edits == 2 else " ".join(v))
    passage = text(70)
    for _ in range(6):
        rows.append(text(rng.randint(0, 80)) + " " + passage + " " + text(rng.randint(0, 80)))
    rows.append(passage)
    rows.append(passage + " " + text(30) + " " + passage)
    rng.shuffle(rows)
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


def frame(spark, rows):
    extra = (None,) * len(CLASH.split(","))
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {CLASH}").repartition(5)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = WORDS.findall(lower(t))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low[find(i)], d)
    return sorted((d, len(s), low[find(i)], d == low[find(i)]) for i, (d, s) in enumerate(sets))


def test_near_components_match_brute_force(spark):
    rows = corpus()
    got = near_dedup.components(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


@pytest.mark.parametrize(("bottom", "split"), [(512, 1024), (64, 1024), (512, 3)])
def test_near_components_are_found_across_a_mixed_bucket(spark, monkeypatch, bottom, split):
    """Classes that only link to each other, not to their bucket's smallest, are still compared, in several tiles;
    with whole sets, with the smallest hashes of sets that are too large, and split by rare shingles."""
    monkeypatch.setattr(near_dedup, "TILE", 4)
    monkeypatch.setattr(near_dedup, "SPLIT", split)
    monkeypatch.setattr(near_dedup, "BOTTOM", bottom)
    rng = random.Random(9)
    words = vocabulary(rng, 3000)
    shared = [rng.choice(words) for _ in range(300)]
    rows, k = [], 0
    for _ in range(12):  # variants of one text, 0.75 alike; each with a close copy
        v = list(shared)
        at = rng.randrange(260)
        v[at : at + 40] = [rng.choice(words) for _ in range(40)]
        for _ in range(2):
            c = list(v)
            c[rng.randrange(300)] = "x%d" % k
            rows.append((k, " ".join(c)))
            k += 1
    got = near_dedup.components(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_near_edge_cases(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "A B c d e f"), (6, "g h i j k l m")]
    got = sorted(map(tuple, near_dedup.components(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (6, 3, 6, True)], key=repr)
    assert near_dedup.components(frame(spark, rows).filter("false")).collect() == []


def test_connected_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = near_dedup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 150)}


def test_stars_are_done_at_once_and_links_between_components_leave_the_rest(spark, monkeypatch):
    written = []
    monkeypatch.setattr(near_dedup, "cut", lambda df, name, real=near_dedup.cut: written.append(name) or real(df, name))
    pairs = lambda rows: spark.createDataFrame(rows, "a long, b long")
    of = lambda df: {r.node: r.root for r in df.collect()}
    first = [(10 * k, 10 * k + i) for k in range(1, 9) for i in range(1, 9)]
    roots = near_dedup.connected_components(pairs(first))
    assert len(of(roots)) == 72 and written == ["edges"]  # nothing moves: no step, nor one to see that
    more = [(85, 71), (72, 3), (200, 14), (31, 201), (41, 42), (300, 301)]
    got = of(near_dedup.joined_components(roots, pairs(more)))
    assert got == of(near_dedup.connected_components(pairs(first + more))) and got[80] == got[78] == 3 and got[14] == got[200] == 10 and got[38] == got[201] == 30 and got[301] == 300


def test_drop_near_copies_keeps_one_of_each(spark):
    rows = corpus(4)
    docs = frame(spark, rows)
    out = near_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [d for d, _, _, kept in brute_components(rows, 80) if kept]


def test_drop_near_copies_goes_by_rows_that_share_an_id(spark):
    w, u = "a b c d e f g h", "i j k l m n o p"
    docs = frame(spark, [(1, w), (5, w), (5, u), (None, w), (None, u), (6, None), (6, "")])
    left = sorted(((r.doc_id, r.text) for r in near_dedup.drop_near_copies(docs).collect()), key=repr)
    assert left == sorted([(1, w), (5, u), (None, w), (None, u), (6, None), (6, "")], key=repr)


def test_rare_shingles_bring_all_linked_pairs_together_and_no_others_by_what_all_have(spark):
    rng = random.Random(4)
    common = ["c%d" % k for k in range(60)]
    rows = []
    for k in range(60):  # pairs of near copies around a common half
        own = ["x%d" % rng.randrange(10**6) for _ in range(60)]
        rows += [(2 * k, " ".join(common + own)), (2 * k + 1, " ".join(common + own[:-1] + ["y%d" % k]))]
    docs = frame(spark, rows)
    sketched = near_dedup.sketches(docs)
    classes = sketched.selectExpr("doc_id as node", "doc_id as first_doc", "digest")
    large = classes.selectExpr("0 as band", "cast(7 as long) as key", "node", "node as root")
    met = defaultdict(set)
    for r in near_dedup._rare_shingles(large, classes, docs, 85).collect():
        met[r.part].add(r.node)
    assert all(any({2 * k, 2 * k + 1} <= m for m in met.values()) for k in range(60)) and max(map(len, met.values())) == 2


def test_exact_against_brute_force(spark):
    rows = corpus(5)
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    want = sorted((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    assert sorted(map(tuple, exact_dedup.classify(frame(spark, rows)).collect())) == want


def test_exact_with_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 3)
    rows = [(k, "hot") for k in range(400)] + [(1000 + k, f"t{k // 2}") for k in range(100)]
    got = {r.doc_id: r for r in exact_dedup.classify(frame(spark, rows)).collect()}
    assert len(got) == 500 and got[5].keep_id == 399 and got[5].group_size == 400 and got[1000].keep_id == 1001


def test_index_lasts_and_takes_each_text_once(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=3)
    first = exact_dedup.digests(frame(spark, [(1, "a"), (2, "a"), (3, "b"), (None, None)]))
    index.append(first)
    index.append(first)  # as after a failure
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=3)
    batch = exact_dedup.digests(frame(spark, [(9, "b"), (10, "c"), (11, "c")]))
    assert [r.keep_id for r in again.new_entries(batch).collect()] == [11]
    again.append(batch)
    assert sorted((r.keep_id for r in again.entries().collect()), key=str) == [11, 2, 3, None]
    assert {(r.doc_id, r.keep_id) for r in again.resolve(batch).collect()} == {(9, 3), (10, 11), (11, 11)}


def test_index_keeps_its_buckets_whatever_the_session_says(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    texts = [(k, f"t{k}") for k in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        index = exact_dedup.DigestIndex(spark, path)
        index.append(exact_dedup.digests(frame(spark, texts)))
        index.forget()  # as in another session, whose catalogue doesn't have it
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = exact_dedup.DigestIndex(spark, path)
        batch = exact_dedup.digests(frame(spark, texts + [(1000, "new")]))
        assert again.buckets == 3 and [r.keep_id for r in again.new_entries(batch).collect()] == [1000]
        again.append(batch)
        small = again.compacted(f"file://{tmp_path}/compact")
        assert small.entries().count() == again.entries().count() == 501
        files = lambda d: sum(1 for f in (tmp_path / d).glob("part-*") if pq.read_metadata(f).num_rows)
        assert files("compact") == 3 < files("index")
        assert small.new_entries(batch).isEmpty()
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, path, buckets=7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_batch_is_grouped_before_it_is_shuffled(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
    new = index.new_entries(exact_dedup.digests(frame(spark, [(k, "same") for k in range(50)])))
    assert "Aggregate" not in new._jdf.queryExecution().optimizedPlan().toString() and new.count() == 1


def test_drop_copies_with_repeated_rows_and_nulls(spark):
    docs = frame(spark, [(1, "a"), (2, "a"), (2, "a"), (3, None), (None, "b"), (None, "b"), (4, "")])
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(2, "a"), (None, "b"), (4, "")], key=str)
    assert exact_dedup.classify(docs.filter("false")).collect() == []


def brute_repeats(rows, n=50):
    """Words of each document inside a passage of n words that has occurred before, by (doc_id, place)."""
    first, gone = {}, defaultdict(set)
    for d, t in sorted({(d, t or "") for d, t in rows}):
        w = WORDS.findall(t)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if first.setdefault(key, (d, i)) != (d, i):
                gone[d].update(range(i, i + n))
    return dict(gone)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = defaultdict(set)
    for r in suffix_dedup.repeated_spans(frame(spark, rows)).collect():
        got[r.doc_id].update(range(r.start, r.end))
    assert dict(got) == brute_repeats(rows)


def test_repeats_where_neighbours_differ_on_the_left(spark):
    """The longest match to the right and the match to the left can be with different texts."""
    rng = random.Random(1)
    w = ["w%d" % i for i in range(400)]
    new = lambda n: ["n%d" % rng.randrange(10**9) for _ in range(n)]
    rows = [(k, " ".join(x)) for k, x in enumerate([w[100:200], new(30) + w[120:190] + new(30), w[60:155] + new(20), new(5) + w[140:195] + new(9), w[100:149] + new(60), new(20) + w[110:160] * 2 + new(3)])]
    got = defaultdict(set)
    for r in suffix_dedup.repeated_spans(frame(spark, rows)).collect():
        got[r.doc_id].update(range(r.start, r.end))
    assert dict(got) == brute_repeats(rows)


def test_drop_repeats_leaves_first_occurrences(spark):
    rows = corpus(6)
    docs = frame(spark, rows).selectExpr("*", "cast(length(text) as long) as n_chars")
    out = suffix_dedup.drop_repeats(docs)
    assert out.columns == docs.columns
    gone, got = brute_repeats(rows), {r.doc_id: r for r in out.collect()}
    for d, t in rows:
        w = WORDS.findall(t or "")
        left = [x for i, x in enumerate(w) if i not in gone.get(d, ())]
        if d in gone and not left:
            assert d not in got
        elif d in gone:
            assert WORDS.findall(got[d].text) == left and got[d].n_chars == len(got[d].text)
        else:
            assert got[d].text == t
    assert suffix_dedup.drop_repeats(docs.filter("false")).collect() == []
