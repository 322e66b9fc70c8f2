from __future__ import annotations

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from varve.llm import brown_lm, chat, licenses, pieces, quality, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, rows, more=("score string", "words long", "kept string", "rid string", "line string", "ids string")):
    return spark.createDataFrame([(*r, *(None for _ in more)) for r in rows], f"doc_id long, text string, {', '.join(more)}").repartition(4)


def some_texts(seed=1, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéß日") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    pick = lambda: words[min(int(rng.expovariate(0.03)), 299)]
    out = [None, "", " \n\n\t", "a", "A b\x0bc\x0cd\x1ce", "x" * 3000, "# * & <|> $ %"]
    for _ in range(n):
        lines = [" ".join(pick() for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 12))]
        lines += [lines[0]] * rng.choice([0, 0, 3])
        out.append("\n".join(lines))
    return out + [" ".join(pick() for _ in range(20_000))]


# quality


def brute_quality(t):
    t = t or ""
    w = WORDS.findall(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), failed


def brute_coverage(t, n):
    w = WORDS.findall(t or "")
    grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    inside = {j for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
    return sum(len(w[j]) for j in inside) / max(1, sum(map(len, w)))


def test_quality_matches_brute_force(spark):
    rows = list(enumerate(some_texts())) + [(1, "")]
    got = quality.assess(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(brute_quality(t))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in texts[r.doc_id]
        assert not (r.base_failed and r.kept)
    by = {r.doc_id: r for r in got}
    for d, t in rows[:40]:
        if d != 1:
            assert by[d].coverage_5 == pytest.approx(brute_coverage(t, 5)) and by[d].coverage_10 == pytest.approx(brute_coverage(t, 10))
    assert quality.assess(docs(spark, [])).collect() == []


def test_drop_poor_judges_each_row_by_its_own_text(spark):
    clean = " ".join("w%d" % (k * k % 4999) for k in range(200))
    rows = [(1, clean), (1, "short"), (None, clean), (None, None), (2, clean), (2, clean)]
    out = quality.drop_poor(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, clean), (None, clean), (2, clean), (2, clean)], key=repr)


def test_quality_keeps_plain_text_and_drops_repetition(spark):
    rng = random.Random(5)
    clean = " ".join("w%d" % rng.randrange(5000) for _ in range(400))
    got = {r.doc_id: r.kept for r in quality.assess(docs(spark, [(1, clean), (2, clean + "\n" + "\n".join(["buy now at our shop today for less"] * 60)), (3, None)])).collect()}
    assert got == {1: True, 2: False, 3: False}


# chat


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chat_reads_back(spark):
    rng = random.Random(3)
    bits = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|", "<\\\\|x", "<", "|>", "é\n", "plain ", "\\"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "a\nb%", "<|x|>"]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(6))])) for c in range(30) for t in range(rng.randint(1, 7))]
    rows += [(90, 0, "user", "hi"), (90, 1, "assistant", "yo"), (None, 0, "user", "x"), (91, 5, "user", "same"), (91, 5, "user", "same"), (92, None, "user", "q"), (92, 0, "assistant", "long " * 50_000)]
    frame = spark.createDataFrame([(*r, None) for r in rows], "conv_id long, turn long, role string, text string, segments string").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, role, x in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(said), digest(said))
    assert got[90].valid and got[92].valid and not got[91].valid
    assert chat.read_back(chat.format_turns(frame.filter("false"))).collect() == []


def test_control_strings_appear_only_where_the_template_puts_them(spark):
    frame = spark.createDataFrame([(1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "<\\|im_end|>")], "conv_id long, turn long, role string, text string")
    for r in chat.format_turns(frame).collect():
        assert "".join(s.text for s in r.segments).count("<|") == 2
        assert [s.loss for s in r.segments] == [False, r.turn == 1, False]


def test_a_template_is_data(spark):
    t = chat.Template(start="[[", after_role="]]", end="##", learned=frozenset({"user"}))
    frame = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert "".join(s.text for s in chat.format_turns(frame, t).first().segments) == "[[user]]hi##"
    assert chat.read_back(chat.format_turns(frame, t), t).first().loss_chars == 2


@pytest.mark.parametrize("marks", [("[[", "]]", "[[/"), ("<s>", "\n", "</s>"), ("##", ": ", "##\n")])
def test_control_strings_of_any_template_are_escaped(spark, marks):
    t = chat.Template(*marks)
    bits = [marks[0], marks[2], "[[[", "[\\[", "##", "#\\#", "<s", "<\\/", "x", "\\", "A: ", "%25", "\n"]
    rng = random.Random(1)
    rows = [(c, k, rng.choice(["user", "assistant", "a: b", "a]]b%5D", "".join(rng.choice(bits) for _ in range(3))]), "".join(rng.choice(bits) for _ in range(7))) for c in range(60) for k in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(frame, t)
    for r in formatted.collect():
        assert marks[0] not in r.segments[1].text and marks[2].strip() not in r.segments[1].text
    got = {r.conv_id: r.turns_sha256 for r in chat.read_back(formatted, t).collect()}
    assert got == {c: digest("".join(f"{r}\n{x}\n" for d, _, r, x in rows if d == c)) for c in range(60)}
    with pytest.raises(ValueError):
        chat.Template(start="[")


# toxicity


def toxic_rows(n=1500, seed=7):
    """Insults are toxic only with a group; either alone is harmless, so that sums of words can't tell."""
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(200)]
    rows, labels = [], []
    for d in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        t += ["scoundrel"] * a + ["martians"] * b
        rng.shuffle(t)
        rows.append((d, " ".join(t)))
        labels.append((d, int(a and b)))
    return rows, labels


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels)
    order = s.argsort()
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_toxicity_learns_pairs_and_never_sees_held_out_labels(spark):
    rows, labels = toxic_rows()
    kind = "doc_id long, toxic int"
    got = toxicity.score(docs(spark, rows), spark.createDataFrame(labels, kind)).collect()
    y = dict(labels)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    assert auc([r.score for r in held], [y[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.93
    flipped = [(d, 1 - v if zlib.crc32(str(d).encode()) % 5 == 0 else v) for d, v in labels]
    again = toxicity.score(docs(spark, rows), spark.createDataFrame(flipped, kind)).collect()
    assert {r.doc_id: round(r.score, 9) for r in got} == {r.doc_id: round(r.score, 9) for r in again}


def test_toxicity_edges(spark):
    rows, labels = toxic_rows(300)
    kind = "doc_id long, toxic int"
    extra = [(9000, None), (9001, ""), (9001, ""), (9002, "scoundrel martians " * 20_000), (None, "x")]
    given = spark.createDataFrame([*labels, (9003, 1), (5, None), (5, 0)], kind)
    got = toxicity.score(docs(spark, rows + extra), given).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (9000, 9001)}) == 1
    none = toxicity.score(docs(spark, rows[:9]), given.filter("false")).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.score(docs(spark, []), given).collect() == []
    kept = toxicity.drop_toxic(docs(spark, rows), given)
    assert kept.columns == docs(spark, rows).columns and 0 < kept.count() < len(rows)


def test_toxicity_learns_from_a_bounded_number_of_texts(spark, monkeypatch):
    """One doc_id on thousands of rows, with equal or different texts, puts no more than the bound on the driver."""
    fitted = []
    whole = toxicity.fit_machine
    monkeypatch.setattr(toxicity, "fit_machine", lambda rows, labels, features: fitted.append(len(rows)) or whole(rows, labels, features))
    label_of = {k: k % 2 for k in range(1, 80) if zlib.crc32(str(k).encode()) % toxicity.HELD_OUT_OF}
    given = spark.createDataFrame(list(label_of.items()), "doc_id long, toxic int")
    few = [(k, "vile cur" if v else "kind friend") for k, v in label_of.items()]
    crowd = next(iter(label_of))
    machine = toxicity.fit(docs(spark, few), given)
    again = toxicity.fit(docs(spark, few + [few[0]] * 3000), given)
    assert fitted == [len(label_of)] * 2 and np.array_equal(machine.weights, again.weights)
    toxicity.fit(docs(spark, few + [(crowd, f"other {n}") for n in range(3000)]), given, most_labelled=100)
    assert fitted[-1] == 100


def test_toxicity_sees_pairs_of_which_neither_word_tells_anything_alone(spark):
    rng, rows, labels = random.Random(3), [], []
    for d in range(1200):
        t = [rng.choice(["w%d" % k for k in range(200)]) for _ in range(30)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        t[10:10] = ["tall"] * a + ["neighbours"] * b + ["idiot"] * (not a and not b)
        rows.append((d, " ".join(t)))
        labels.append((d, int(a == b)))
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    y = dict(labels)
    held = [r for r in toxicity.score(docs(spark, rows), given).collect() if r.held_out]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.97


def test_toxicity_takes_the_terms_that_brute_force_takes(spark):
    rows, labels = toxic_rows(900)
    rows = rows + rows[:300]  # equal texts count once
    machine = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    y = {t: labels[d][1] for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 0}
    n, ones = len(y), sum(y.values())
    chi2 = lambda k, of: (of * n - k * ones) ** 2 * n / (k * (n - k) * ones * (n - ones)) if k < n else 0
    single, pair = Counter(), Counter()
    single1, pair1 = Counter(), Counter()
    number = lambda w: zlib.crc32(b"w" + w.encode()) % 2**toxicity.BITS
    for t, v in y.items():
        w = t.split()
        terms = set().union(*map(toxicity.hashed, w))
        near = {tuple(sorted((number(w[i]), number(w[j])))) for i in range(len(w)) for j in range(i + 1, min(len(w), i + toxicity.NEAR + 1)) if w[i] != w[j]}
        single.update(terms)
        pair.update(near)
        if v:
            single1.update(terms)
            pair1.update(near)
    want = {f for f, k in single.items() if k >= toxicity.LEAST_DOCS and chi2(k, single1[f]) >= toxicity.LEAST_CHI2}
    for p, k in pair1.items():
        if k >= toxicity.LEAST_PAIR and k * n > pair[p] * ones and chi2(pair[p], k) >= toxicity.LEAST_PAIR_CHI2:
            want |= set(p)
    assert set(machine.features.tolist()) == want


def test_toxicity_score_is_the_sum_over_all_pairs_of_terms(spark):
    rows, labels = toxic_rows(400)
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(docs(spark, rows), given)
    place = {int(f): k for k, f in enumerate(machine.features)}
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, rows), given).collect()}
    for d, t in rows[:150]:
        at = sorted({place[f] for w in set(t.split()) for f in toxicity.hashed(w) if f in place})
        z = machine.bias + sum(machine.weights[i] for i in at)
        z += sum(float(machine.factors[i] @ machine.factors[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        assert got[d] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


# language model


def brute_base(rows):
    low = lambda t: WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not held(d) for w in low(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(low(t)), sum(c[w] > 0 for w in low(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in low(t))) for d, t in rows]


@pytest.mark.parametrize("head", [1_000_000, 20])
def test_lm_base_score_matches_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(brown_lm, "HEAD", head)
    rows = list(enumerate(some_texts(3))) + [(1, ""), (None, "a b")]
    got = sorted(brown_lm.score(docs(spark, rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    want = sorted(brute_base(rows), key=lambda r: (r[0] is None, r[0], r[2]))
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert r.base_score == pytest.approx(w[5], abs=1e-6) and r.score < 0 and r.perplexity > 1


def test_lm_beats_the_base_where_words_follow_classes(spark):
    rng = random.Random(6)
    nouns, verbs, rest = (["%s%d" % (c, k) for k in range(150)] for c in "nvr")
    rows = [(d, " ".join(w for _ in range(60) for w in (rng.choice(nouns), rng.choice(verbs), rng.choice(rest)))) for d in range(150)]
    held = [r for r in brown_lm.score(docs(spark, rows)).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.25  # log10 3 = 0.48 is all that order tells


def lm_words(t):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize(("head", "seeds"), [(1_000_000, 1024), (100, 20), (30, 8)])
def test_lm_score_matches_brute_force(spark, monkeypatch, head, seeds):
    """The score from the classes that the operator gave, by plain loops; words in and out of what is broadcast."""
    for name, value in {"HEAD": head, "SEEDS": seeds, "UNITS": seeds + 2, "REST_UNIT": seeds, "END_UNIT": seeds + 1}.items():
        monkeypatch.setattr(brown_lm, name, value)
    rows = list(enumerate(some_texts(5))) + [(2, "new never seen"), (None, "a b")]
    frame = docs(spark, rows)
    lexicon = {r.word.decode(): (r.c, r.k) for r in brown_lm.fit(frame).lexicon.collect()}
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = [lm_words(t) for d, t in rows if not held(d)]
    assert {w: c for w, (c, _) in lexicon.items()} == Counter(w for t in train for w in t)
    once = Counter(k for c, k in lexicon.values() if c == 1)
    unseen = min(range(brown_lm.CLASSES), key=lambda k: (-once[k], k))
    of = lambda w: brown_lm.END_CLASS if w is None else lexicon[w][1] if w in lexicon else unseen
    cells, tokens_in, words_in = Counter(), Counter(), Counter(k for _, k in lexicon.values())
    words_in[brown_lm.END_CLASS] = 1
    for t in train:
        for a, b in zip([None, *t], [*t, None]):
            cells[of(a), of(b)] += 1
            tokens_in[of(b)] += 1
    total, before = sum(tokens_in.values()), Counter()
    for (a, _), n in cells.items():
        before[a] += n

    def brute(t):
        out = 0.0
        for a, b in zip([None, *t], [*t, None]):
            share = (tokens_in[of(b)] + 1) / (total + brown_lm.CLASSES + 1)
            step = cells[of(a), of(b)] / before[of(a)] if before[of(a)] else share
            c = len(train) if b is None else lexicon.get(b, (0, 0))[0]
            out += math.log10(0.98 * step + 0.02 * share) + math.log10((c + 1) / (tokens_in[of(b)] + words_in[of(b)] + 1))
        return out

    want = sorted((round(brute(lm_words(t)), 6), -1 if d is None else d) for d, t in rows)
    got = sorted((round(r.score, 6), -1 if r.doc_id is None else r.doc_id) for r in brown_lm.score(frame).collect())
    assert [d for _, d in got] == [d for _, d in want] and [x for x, _ in got] == pytest.approx([x for x, _ in want], abs=2e-6)


def test_lm_words_go_where_the_likelihood_is_largest():
    rng = np.random.default_rng(3)
    size = brown_lm.CONTEXTS
    table = rng.integers(0, 40, (size, size)).astype(float)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    likelihood = lambda x: f(x) - f(x.sum(0)) - f(x.sum(1))
    row = np.repeat(np.arange(30), rng.integers(1, 6, 30))
    before, after, n = rng.integers(0, size, len(row)), rng.integers(0, size, len(row)), rng.integers(1, 9, len(row))
    after[:20] = before[:20]
    got = brown_lm.best_classes(row, before, after, n, 30, table)
    for w in range(30):
        values = []
        for k in range(brown_lm.CLASSES):
            x = table.copy()
            for b, a, m in zip(before[row == w], after[row == w], n[row == w]):
                x[b, k] += m
                x[k, a] += m
            values.append(likelihood(x))
        assert values[got[w]] == pytest.approx(max(values), abs=1e-6)


def test_lm_rare_words_share_the_class_of_words_in_like_places(spark, monkeypatch):
    """Words that are too rare for a seed, whatever their letters, are told apart by their neighbours."""
    for name, value in {"SEEDS": 20, "UNITS": 22, "REST_UNIT": 20, "END_UNIT": 21, "HEAD": 40}.items():
        monkeypatch.setattr(brown_lm, name, value)
    rng = random.Random(2)
    often = {c: ["%s%d" % (c, k) for k in range(6)] for c in "nvr"}
    word = lambda c, k: "%s%d" % (rng.choice("xyz"), 3 * rng.randrange(40) + k) if rng.random() < 0.2 else rng.choice(often[c])
    rows = [(d, " ".join(w for _ in range(40) for w in (word("n", 0), word("v", 1), word("r", 2)))) for d in range(120)]
    kinds = defaultdict(Counter)
    for r in brown_lm.fit(docs(spark, rows)).lexicon.collect():
        if r.word.decode()[0] in "xyz":
            kinds[r.k][int(r.word.decode()[1:]) % 3] += r.c
    assert sum(max(c.values()) for c in kinds.values()) > 0.9 * sum(c.total() for c in kinds.values())


def test_lm_without_training_or_rows(spark):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    r = brown_lm.score(docs(spark, [(held, "a b")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == 0
    assert brown_lm.score(docs(spark, [])).collect() == []


def test_exchange_ends_where_no_unit_gains_by_moving():
    rng = np.random.default_rng(1)
    counts = np.zeros((21, 21))
    for a in range(10):
        for b in range(10, 20):
            counts[a, b], counts[b, a] = rng.integers(5, 30, 2)

    def likelihood(of):
        one = np.eye(3)[of]
        table = one.T @ counts @ one
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(table) - f(table.sum(0)) - f(table.sum(1))

    start = np.append(np.arange(20) % 2, 2)
    of = brown_lm.exchange(counts, classes=2)
    assert likelihood(of) >= likelihood(start) and of[-1] == 2
    for u in range(20):  # no unit gains by moving alone
        moved = of.copy()
        moved[u] = 1 - moved[u]
        assert likelihood(moved) <= likelihood(of) + 0.1


# pieces


def test_pieces_round_trip_and_chunks_match_whole(spark):
    texts = some_texts(8, 40) + ["a" * 400, "日本語" * 300, " " * 500, "  lead and  double  ", "▁under", "é😀" * 200, "word " * 900]
    frame = docs(spark, list(enumerate(texts)) + [(0, "again")])
    whole = pieces.encode(frame, MODEL, chunk=1 << 20).collect()
    ids = defaultdict(list)
    for r in whole:
        ids[r.doc_id].append(list(r.ids))
    parts = defaultdict(lambda: defaultdict(list))
    cut = pieces.encode(frame, MODEL, chunk=64)
    for r in cut.collect():
        parts[r.doc_id][r.rid].append((r.k, list(r.ids)))
    p = pieces.pieces_of(MODEL)
    for d, t in enumerate(texts):
        joined = [[i for _, x in sorted(v) for i in x] for v in parts[d].values()]
        want = (t or "").encode()
        assert any(p.decode(j)[1:] == want for j in joined)
        value = lambda seq: int(p.score_of[seq].sum()) if seq else 0
        assert {value(j) for j in joined} == {value(i) for i in ids[d]}  # as good as the best segmentation of the whole
        if max(map(len, re.findall(" *[^ ]+| +", " " + (t or "")))) <= 64:
            assert sorted(joined) == sorted(ids[d])  # and the same one
    assert all(r.exact for r in pieces.round_trip(cut).collect())
    assert sorted((r.doc_id, r.text) for r in pieces.decode(cut, MODEL).collect()) == sorted([(d, t or "") for d, t in enumerate(texts)] + [(0, "again")])
    assert pieces.encode(docs(spark, []), MODEL).collect() == []


def test_segmentations_by_enumeration():
    p = pieces.Pieces(MODEL)

    def every(t):  # all segmentations: lengths of pieces, with bytes for characters that have none
        if not t:
            yield (), 0
        for n in range(1, len(t) + 1):
            own = p.pieces[t[:n]][1] if t[:n] in p.pieces else pieces.BYTE_SCORE * len(t[0].encode()) if n == 1 else None
            if own is not None:
                yield from (((n, *more), own + value) for more, value in every(t[n:]))

    rng = random.Random(4)
    for _ in range(400):
        t = "".join(rng.choice(["a", "b", "aa", "ab", "é", "er", "日", "x"]) for _ in range(rng.randint(1, 6)))
        best = max(value for _, value in every(t))
        lengths = min(x for x, value in every(t) if value == best)  # ties: the shortest first piece
        at, want = 0, []
        for n in lengths:
            want += [p.pieces[t[at : at + n]][0]] if t[at : at + n] in p.pieces else [p.bytes[b] for b in t[at : at + n].encode()]
            at += n
        assert np.frombuffer(p[t], "<i4").tolist() == want


def test_segmentations_are_the_best():
    p = pieces.Pieces(MODEL)
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["the", "tion", "ing", "é", "日", " ", "er", "x", "\n"]) for _ in range(rng.randint(1, 12)))
        whole, _ = p.best(t, [0], len(t))
        assert int(p.score_of[np.frombuffer(p.encode(t), "<i4")].sum()) == whole[-1]


# licences


def brute_cosine(line, template, df, n):
    term = lambda t: Counter(x for x in re.split(r"[^\w]+|_", t.lower()) if x)
    idf = lambda t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1
    a, b = ({t: c * idf(t) for t, c in term(x).items()} for x in (line, template))
    dot = sum(a[t] * b[t] for t in a if t in b)
    return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def files(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, path string, text string, license string, term string").repartition(3)


def test_licences_are_found_by_cosine_and_inherited_from_the_nearest_directory(spark):
    rows = [
        (1, "a/LICENSE-1", "x y\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "a/b/doc-2", "nothing here"), (3, "a/b/LICENSE-3", "All rights reserved."), (4, "a/b/c/d/doc-4", None),
        (5, "z/doc-5", "plain words about rights and public things"), (6, "a/doc-6", "// Permission is hereby granted, free of charge, under the MIT License."), (7, None, "All rights reserved."), (8, "top", ""), (8, "top", ""), (9, None, None),
        (10, "a/bc/doc-10", ""),
    ]
    f = files(spark, rows)
    got = {(r.doc_id): r for r in licenses.inherit(f, licenses.scan(f), F.col("path").rlike("/LICENSE-[0-9]+$")).collect()}
    assert {k: got[k].license for k in got} == {1: "Apache-2.0", 2: "Proprietary", 3: "Proprietary", 4: "Proprietary", 5: None, 6: "MIT", 7: "Proprietary", 8: None, 9: None, 10: "Apache-2.0"}
    assert got[4].from_path == "a/b/LICENSE-3" and got[4].inherited and not got[1].inherited and got[2].cosine is None
    term = lambda t: {x for x in re.split(r"[^\w]+|_", t.lower()) if x}
    vocabulary = set().union(*map(term, licenses.TEMPLATES.values()))
    df = Counter(t for _, _, text in rows for t in set().union(set(), *(term(line) & vocabulary for line in (text or "").split("\n") if re.search("(?i)licen|permi|rights|public|subject|domain|spdx", line) and len(term(line) & vocabulary) >= 2)))
    want = brute_cosine("// Permission is hereby granted, free of charge, under the MIT License.", licenses.TEMPLATES["MIT"], df, len(rows))
    assert got[6].cosine == pytest.approx(want, abs=1e-6)
    assert licenses.scan(files(spark, [])).collect() == []


def licence_df(texts):
    return Counter(t for text in texts for t in {x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x})


def test_licence_headers_without_keywords_and_wrapped_ones_are_found(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification,"
    wrapped = "x = 1\n\n// This work\n// is licensed under\n// the GNU General\n// Public\n// License, version\n// 3.\n//\ncode follows here and runs"
    texts = [f"some code\n{bsd}\nare permitted provided that the conditions are met", wrapped, "This work is\nlicensed under the\nGNU General Public\nLicense, version 3.", "plain words"]
    got = {r.doc_id: r for r in licenses.scan(files(spark, [(k, f"a/{k}", t) for k, t in enumerate(texts)])).collect()}
    assert {k: r.license for k, r in got.items()} == {0: "BSD-3-Clause", 1: "GPL-3.0", 2: "GPL-3.0"}
    df = licence_df(texts)
    blocks = [b for b in (texts[0], *texts[0].split("\n"))]
    assert got[0].cosine == pytest.approx(max(brute_cosine(b, licenses.TEMPLATES["BSD-3-Clause"], df, len(texts)) for b in blocks), abs=1e-6)
    own = licenses.scan(files(spark, [(0, "a/0", "You may share this freely")]), {"own": "You may share this freely"}).collect()
    assert [r.license for r in own] == ["own"]


def test_licence_terms_are_weighted_by_the_texts_that_have_them(spark):
    line = "Please note that this work is licensed under the GNU General Public License, version 3."
    texts = [line] * 20 + ["please note that it rains"] * 180 + ["note\nnote that"] * 100
    got = licenses.scan(files(spark, [(k, f"a/{k}", t) for k, t in enumerate(texts)])).collect()
    want = brute_cosine(line, licenses.TEMPLATES["GPL-3.0"], licence_df(texts), len(texts))
    assert {r.doc_id for r in got} == set(range(20)) and all(r.cosine == pytest.approx(want, abs=1e-6) for r in got)


def test_wrapped_headers_are_told_apart_whatever_follows_them(spark):
    wrap = lambda text, width: "\n".join("# " + x for x in textwrap.wrap(text, width))
    code = "\n".join(f"value_{k} = load(path, {k}) + other_{k % 7}" for k in range(40))
    gpl = "# This work is licensed\n# under the GNU General\n# Public License, version 3."
    headed = {name: f"first line of code\n{wrap(text, 76)}\n{code}" for name, text in licenses.HEADERS.items()}
    narrow = {name: f"{wrap(text, 30)}\n{code}" for name, text in licenses.HEADERS.items()}
    for others in (30, 1500):
        texts = [gpl + "\n" + code, gpl.replace("General", "Lesser General") + "\n" + code, *headed.values(), *narrow.values()] + [f"import x{k % 50}\nprint(the_{k % 9} of the software, {k})\nreturn a copy of it" for k in range(others)]
        got = {r.doc_id: r.license for r in licenses.scan(files(spark, [(k, f"a/{k}", t) for k, t in enumerate(texts)])).collect()}
        assert got == dict(enumerate(["GPL-3.0", "LGPL-3.0", *headed, *narrow]))


def test_licence_scan_equals_comparing_everything(spark):
    rng = random.Random(4)
    words = [w for t in licenses.TEMPLATES.values() for w in re.findall(r"\w+", t)] + ["code", "rain", "x1", "sun"] * 12
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) if rng.random() < 0.8 else rng.choice(list(licenses.TEMPLATES.values())) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    df = licence_df(texts)
    want = {}
    for k, t in enumerate(texts):
        lines = [x for x in t.split("\n") if re.search(r"\w", x)]
        runs = ["\n".join(lines[a:b]) for a in range(len(lines)) for b in range(a + 2, len(lines) + 1)]
        units = [u for u in (*lines, *runs, *re.split(r"\n[\W_]*\n", t), t) if re.search(r"\w", u)]
        c, name = min(((-round(brute_cosine(u, v, df, len(texts)), 9), name) for u in units for name, v in licenses.notices()), default=(0, ""))
        if -c >= 0.6:
            want[k] = (name, pytest.approx(-c, abs=1e-6))
    assert 20 < len(want) < 150
    assert {r.doc_id: (r.license, r.cosine) for r in licenses.scan(files(spark, [(k, f"a/{k}", t) for k, t in enumerate(texts)])).collect()} == want
