from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.llm import jaccard_join, prefix_trie, spelling

from .test_dedup import WORDS, corpus, lower

CLASH = "key long, node long, digest string, pivot long, root int, shingles string, n long, word string, best int, k1 long, depth int, heavy int, block int, words string, `a.b` int"


def frame(spark, rows, schema):
    extra = (None,) * len(CLASH.split(","))
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{schema}, {CLASH}").repartition(5)


def components(rows, percent):
    def shingles(t):
        w = WORDS.findall(lower(t))
        return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets, root = [(d, shingles(t)) for d, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and sets[i][0] is not None and sets[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = d if low.get(find(i)) is None else min(low[find(i)], d)
    return sorted(((d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("percent", [90, 75])
def test_join_matches_brute_force(spark, percent):
    rows = corpus() + [(None, "a b c d"), (None, None)]
    rows += [(20_000, rows[9][1]), (20_000, "another text under one id"), rows[3]]
    got = jaccard_join.components(frame(spark, rows, "doc_id long, text string"), percent).collect()
    assert sorted(map(tuple, got), key=str) == components(rows, percent)


def test_hashes_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_name", lambda seed: F.pmod(F.xxhash64("digest", F.lit(seed)), F.lit(40 if seed < 2 else 1 << 40)))
    rows = corpus(5)
    got = jaccard_join.components(frame(spark, rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == components(rows, 90)


@pytest.mark.parametrize("gathered", [True, False])
def test_tiles_join_components(spark, monkeypatch, gathered):
    """Open members of overlapping buckets, in small blocks: the same components as all pairs within buckets give."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 3)
    rng = random.Random(8)
    sets, bucket = {}, {}
    for g in range(10):
        base = [rng.randrange(1 << 64) for _ in range(60)]
        for v in range(6):
            sets[10 * g + v] = set(base) ^ set(rng.sample(base, v)) | {rng.randrange(1 << 64)}
    for k in range(25):
        bucket[k] = rng.sample(sorted(sets), 9)
    links = {(a, b) for m in bucket.values() for a in m for b in m if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    open_ = spark.createDataFrame([(k, v, v, len(sets[v])) for k, m in bucket.items() for v in m], "key long, node long, root long, n_shingles long")
    table = spark.createDataFrame([(v, np.array(sorted(s), np.uint64).view(np.int64).tolist()) for v, s in sets.items()], "node long, shingles array<long>")
    got = {tuple(r) for r in jaccard_join._tiled(jaccard_join._gathered(open_) if gathered else open_, table, 90).collect()}

    def parts(edges):
        label = {v: v for v in sets}
        for a, b in edges:
            old, new = label[a], label[b]
            label = {v: new if x == old else x for v, x in label.items()}
        return {frozenset(v for v in sets if label[v] == x) for x in set(label.values())}

    if gathered:  # clusters may bring more members together
        assert all(100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) for a, b in got)
        assert all(any(p <= q for q in parts(got)) for p in parts(links))
    else:
        assert got <= links and parts(got) == parts(links) and len(parts(links)) < 55


@pytest.mark.parametrize("percent", [90, 70])
def test_sets_that_link_share_a_signature(percent):
    rng = random.Random(percent)
    for _ in range(1500):
        a = rng.sample(range(1 << 62), rng.randint(1, 150))
        b = set(a)
        for _ in range(rng.randint(0, max(1, len(a) // 5))):
            if rng.random() < 0.5 and len(b) > 1:
                b.remove(rng.choice(sorted(b)))
            else:
                b.add(rng.randrange(1 << 62))
        common = len(set(a) & b)
        one, two = (np.unique(np.array(sorted(x), np.uint64)) for x in (a, b))
        if set(a) != b and 100 * common >= percent * (len(one) + len(two) - common):
            assert len(np.intersect1d(jaccard_join.signatures(one, percent), jaccard_join.signatures(two, percent)))


def trie(rows, borrow):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    said = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    again = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4 if borrow else 0
        again[c] = (said.get(c - c % 20, [])[:h] if borrow else []) + said[c][h:]
    members, children, out = defaultdict(list), defaultdict(list), {}
    for c, t in again.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves = sum(out[x][5] for x in children[k]) or 1
        saved = sum(out[x][6] for x in children[k]) + ((len(members[k]) - 1) * len(WORDS.findall(k[-1][1])) if k else 0)
        ends = ",".join(str(c) for c in sorted(members[k]) if len(again[c]) == len(k))
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


def talks(seed=5):
    rng, rows = random.Random(seed), []
    for i in range(150):
        c = i * 3 if i % 7 else i
        for t in range(rng.choice([1, 1, 2, 3, 4, 7, 30])):
            # rows with equal turns are alike, so that their order can't matter
            rows.append((c, t, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(["a b", "c", "", None, "x\ty  z", "a b"])))
    rows += [(c, None, "system", "all") for c in range(0, 60, 4)] + [(None, 1, "user", "a")]
    return list({r[:2]: r for r in rows}.values()) + [(6, 50_000, "user", "a b")] * 3


@pytest.mark.parametrize(("heavy", "block"), [(10**9, 1024), (200, 1024), (20, 4)])
def test_trie_matches_brute_force(spark, monkeypatch, heavy, block):
    """Everything light, some upper levels, and many heavy nodes with paths cut into small blocks and small tries."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "TRIE_NODES", 50 if block == 4 else 100_000)
    monkeypatch.setattr(prefix_trie, "PIECE", 7 if block == 4 else 20_000)
    c, rows = F.col("conv_id"), talks()
    turns = frame(spark, rows, "conv_id long, turn long, role string, text string")
    borrow = (c - c % 20, F.crc32(c.cast("string")) % 4)
    for way in (borrow, None) if block == 4 else (borrow,):
        assert sorted(map(tuple, prefix_trie.trie(turns, way, heavy).collect())) == trie(rows, way is not None)


def test_louds_of_a_forest():
    """Two tries: 0-(1-(3), 2) and 5-(6)."""
    part, depth = np.array([0, 0, 0, 0, 9, 9]), np.array([2, 1, 2, 3, 4, 5])
    node, parent, label = np.array([1, 0, 2, 3, 5, 6]), np.array([0, -1, 0, 1, -1, 5]), np.array([7, 0, 8, 9, 0, 4])
    got = prefix_trie.louds(part, depth, node, parent, label)
    assert node[got.order].tolist() == [0, 5, 1, 2, 6, 3]
    assert got.bits.tolist() == [1, 1, 0, 1, 0, 1, 0, 0, 0, 0]
    assert got.children.tolist() == [2, 1, 1, 0, 0, 0]
    assert got.up(np.ones(6, np.int64)).tolist() == [4, 2, 2, 1, 1, 1]


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    form, n_near = {}, {}
    for w in n:
        found = [(-n[v], v) for v in n if v != w and near(v, w)]
        n_near[w] = len(found)
        if found and -min(found)[0] >= 2 * n[w]:
            form[w] = min(found)[1]

    def last(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), last(w), n[w], n_near[w], n[form[w]] if w in form else -1) for w in n)


def test_spelling_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_ROWS", 500)
    rng, rows = random.Random(2), []
    words = ["".join(rng.choice("abeé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["q" * 90 + "u" * 20, "ÀÉ" * 3, "×÷×÷×"]
    for w in list(words):
        i = rng.randrange(len(w))
        words += [w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "zz" + w[i + 1 :]]
    for d in range(300):
        rows.append((d if d % 50 else None, rng.choice([" ", "\n", "-1", "Ā"]).join(rng.choice([w, w.upper()]) for w in rng.choices(words[:80], k=20) + rng.choices(words, k=20))))
    rows += [(1, None), (2, ""), (3, " 12 "), rows[0], rows[0], (7, "abeab " * 30_000)]
    got = spelling.variants(frame(spark, rows, "doc_id long, text string")).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got) == spelled(rows)


def test_stretches_end_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 7)
    text = "abc defghi, J" + "k" * 30 + " é" * 9
    assert [r for some in spelling.runs_of(text) for r in some] == re.findall("[a-zà-ÿ]+", text.lower())


def test_a_pair_is_found_once_over_shards():
    rng = random.Random(3)
    for k in (1, 3, 17):
        words = {"".join(rng.choice("ab") for _ in range(rng.choice([5, 6, 7, 8, 70, 71]))): rng.randint(3, 9) for _ in range(200)}
        shards, found = defaultdict(list), {}
        for w in words:
            for s, kind in spelling.shards_of(w, k):
                shards[s].append((w, kind, words[w]))
        for rows in shards.values():
            for w, (c, n, other) in spelling.near_in_shard(*map(list, zip(*rows))).items():
                had = found.get(w, (0, 0, ""))
                found[w] = (had[0] + c, *max((had[1:], (n, other)), key=lambda x: x[0]))
        assert {w: f[:2] for w, f in found.items()} == {w: (len(x), max(x)) for w in words if (x := [words[v] for v in words if v != w and near(v, w)])}


def test_empty_tables(spark):
    docs, turns = frame(spark, [], "doc_id long, text string"), frame(spark, [], "conv_id long, turn long, role string, text string")
    assert [x.count() for x in (jaccard_join.components(docs), prefix_trie.trie(turns), spelling.variants(docs))] == [0, 0, 0]
