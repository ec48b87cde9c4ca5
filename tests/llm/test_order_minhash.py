import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from railloom.llm import alignment, order_minhash
from railloom.llm.common import join_with_hot
from railloom.llm.word_hashes import word_hashes
from railloom.workspace import Workspace


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def alter(words, n, rng):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        what = rng.random()
        if what < 0.5:
            words[i] = f"new{rng.random()}"
        elif what < 0.75 and len(words) > 1:
            del words[i]
        else:
            words.insert(i, f"more{rng.random()}")
    return words


def test_words_are_told_apart_alike_in_any_company():
    texts = ["a b  a\tab ba", "", " \n ", "ab", "é\x1c ü x\x0by", "漢 " * 200_000, "z" * 600_000 + " q", "b"]
    alone = [next(iter(word_hashes([t]))) for t in texts]
    assert all((x == y).all() for x, y in zip(alone, word_hashes(texts), strict=True))
    assert [len(x) for x in alone] == [5, 0, 0, 1, 4, 200_000, 2, 1]
    assert alone[0][0] == alone[0][2] and alone[0][3] == alone[3][0] and alone[0][1] == alone[7][0]
    assert len({int(h) for x in (alone[0], alone[4], alone[6]) for h in x}) == 4 + 4 + 2
    assert list(word_hashes([])) == []


@pytest.mark.parametrize("similarity", [0.8, 0.5, 0.95])
def test_alignment_matches_plain_dynamic_programming(similarity):
    rng = random.Random(4)
    pairs, want = [], []
    for _ in range(300):
        a = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 60))]
        b = alter(a, rng.randint(0, 25), rng) if rng.random() < 0.8 else [rng.choice("abcdefghij") for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.1:
            b = b[::-1]
        pairs.append(tuple(np.array([hash(x) & (2**64 - 1) for x in s], np.uint64) for s in (a, b)))
        longest = max(len(a), len(b))
        want.append(edits(a, b) <= int((1 - similarity) * longest + 1e-9))
    assert alignment.similar(pairs, similarity).tolist() == want
    assert alignment.similar([], similarity).tolist() == []


def test_long_pairs_end_soon():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 300_000).astype(np.uint64)
    b = a.copy()
    b[rng.choice(len(b), 40, replace=False)] = 7
    began = time.perf_counter()
    assert alignment.similar([(a, b), (a, a[::-1].copy()), (a, a[: len(a) * 9 // 10])], 0.8).tolist() == [True, False, True]
    assert time.perf_counter() - began < 60


def test_sketch_keeps_order_and_occurrence():
    a = np.arange(50, dtype=np.uint64)
    one = lambda w, k=3: order_minhash.sketch_group([w], k, 40)[0]
    assert (one(a) == one(a.copy())).all() and not (one(a, 1) == one(a[::-1].copy(), 1)).any()
    once, twice = np.zeros(1, np.uint64), np.zeros(2, np.uint64)
    assert len(np.unique(order_minhash.kmers([np.zeros(40, np.uint64)], 3)[0])) == 38
    assert (one(once) != one(twice)).all()
    long = np.arange(order_minhash.GROUP_WORDS + 9, dtype=np.uint64)
    together = order_minhash.sketches([a, long, once, a[:0], a[:36]])
    assert all((x == y[0]).all() for x, y in zip(together, ([w] and order_minhash.sketches([w]) for w in (a, long, once, a[:0], a[:36])), strict=True))
    # a text near the border of the families has the keys of both
    assert [len(x) for x in together] == [32, 32, 32, 0, 64]


def test_more_sketches_for_less_similarity():
    assert [order_minhash.sketches_for(s, 3) for s in (1, 0.9, 0.8, 0.7)] == [1, 10, 32, 90]  # log(0.02) over log(1 - j * j)


@pytest.mark.parametrize("band", [(5, 20), (20, 100), (100, 700)])
def test_recall_against_all_pairs(spark, band):
    # texts of frequent and rare words; edits of all kinds, from none to just beyond the threshold
    rng = random.Random(band[0])
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 50_000}"
    texts = []
    for _ in range(220):
        base = [word() for _ in range(rng.randint(*band))]
        texts.append(base)
        edited = list(base)
        for _ in range(int(rng.uniform(0.02, 0.24) * len(base) + 0.5)):
            i, what = rng.randrange(len(edited)), rng.random()
            if what < 0.6:
                edited[i] = word()
            elif what < 0.8 and len(edited) > 1:
                del edited[i]
            else:
                edited.insert(i, word())
        texts.append(edited)
    words = list(word_hashes([" ".join(t) for t in texts]))
    every = [(i, j) for i in range(len(words)) for j in range(i) if abs(len(words[i]) - len(words[j])) <= 0.2 * max(len(words[i]), len(words[j]))]
    linked = [p for p, good in zip(every, alignment.similar([(words[i], words[j]) for i, j in every], 0.8)) if good]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string"), Workspace(spark, "t4")).collect()}
    found, all_ = [0] * 3, [0] * 3
    for i, j in linked:
        longest = max(len(words[i]), len(words[j]))
        share = 1 - edits(texts[i], texts[j]) / longest
        at = 0 if share < 0.85 else 1 if share < 0.9 else 2
        all_[at] += 1
        found[at] += got[i] == got[j]
    assert min(all_) >= 10 and all(f >= 0.9 * n for f, n in zip(found, all_)), (found, all_)
    # and nothing hangs together that links do not join
    up = list(range(len(texts)))
    root = lambda x: x if up[x] == x else root(up[x])
    for i, j in linked:
        up[max(root(i), root(j))] = min(root(i), root(j))
    assert all(root(i) == root(c) for i, c in got.items())


def test_followers_of_two_leaders_meet(spark):
    # a ~ x ~ y ~ b: only the last pair's other members are led
    base = [f"c{i}" for i in range(200)]
    x = base[:100] + [f"x{i}" for i in range(15)] + base[115:]
    rows = [(0, base), (1, x[:20] + [f"a{i}" for i in range(30)] + x[50:]), (2, x), (3, x[:150] + [f"y{i}" for i in range(35)] + x[185:])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {r.class_id for r in order_minhash.near_duplicates(docs, Workspace(spark, "t4")).collect()} == {0}


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, groups = [], []
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 150, 400]))]
        for c in range(rng.choice([1, 1, 2, 5])):
            texts.append(" ".join(alter(base, int(len(base) * 0.02), rng) if c else base))
            groups.append(g)
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for g in range(100, 125):  # a passage that many documents share does not make them copies
        texts.append(" ".join([*(rng.choice(vocabulary) for _ in range(40)), *passage]))
        groups.append(g)
    base = [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(150):  # a large group
        texts.append(" ".join(alter(base, 1, rng)) + rng.choice(["", "\n", " "]))
        groups.append(200)
    texts += ["x " * 30_000, "x " * 29_990, None, None, "", " \t"]
    groups += [300, 300, 301, 301, 301, 301]
    return texts, groups


def test_groups_on_planted_copies(spark):
    rng = random.Random(8)
    texts, groups = corpus(rng)
    ids = rng.sample(range(10_000), len(texts))
    rows = [(i, t, "x", g) for i, t, g in zip(ids, texts, groups)]
    rows += [(rows[0][0], rows[0][1], "x", groups[0]), (None, texts[0], "x", groups[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, leader int").repartition(6)
    got = order_minhash.near_duplicates(docs, Workspace(spark, "t4"), keep=("leader",)).collect()
    assert sorted((str(r.doc_id), r.leader) for r in got) == sorted((str(r[0]), r[3]) for r in rows)
    smallest = {}
    for i, _, _, g in rows:
        if i is not None:
            smallest[g] = min(i, smallest.get(g, i))
    assert all(r.class_id == smallest[r.leader] for r in got)
    kept = [r for r in got if r.kept]
    assert sorted(r.leader for r in kept) == sorted(set(groups)) and all(r.doc_id == r.class_id for r in kept)


def test_every_shared_bucket_is_worked_off(spark):
    # chained variants: each is similar to its neighbours only
    rng = random.Random(1)
    words = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words)))
        for j in range(i * 15, i * 15 + 12):
            words[j] = f"n{i}_{j}"
    rng.shuffle(rows)
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t4")).collect()
    assert {r.class_id for r in got} == {0}


def test_similar_texts_that_share_only_large_buckets_meet(spark, monkeypatch):
    # all that a pair has in common, many other texts have too, which are similar to none
    monkeypatch.setattr(order_minhash, "SMALL", 8)
    rows, want = [], {}
    for g in range(4):
        passage = [f"p{g}_{i}" for i in range(80)]
        own = [[*passage, *(f"u{g}_{i}_{j}" for j in range(26))] for i in range(60)]
        own[30:30] = [[*passage, *(f"{c}{g}_{j}" for j in range(20))] for c in "ab"]
        for w in own:
            want[len(rows)] = len(rows) - 1 if w[-1] == f"b{g}_19" else len(rows)
            rows.append((len(rows), " ".join(w)))
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t4")).collect()
    assert {r.doc_id: r.class_id for r in got} == want


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("similarity", [0.6, 0.8])
def test_open_pairs_leave_no_similar_pair_out(spark, monkeypatch, similarity, split):
    if split:  # by further words wherever two groups meet
        monkeypatch.setattr(order_minhash, "LESSER", 0)
        monkeypatch.setattr(order_minhash, "WORTH", 0)
    rng = random.Random(6)
    texts = []
    for _ in range(40):  # few words, so that nearly all texts meet
        base = [rng.choice("abcdefghijklmnop") for _ in range(rng.choice([1, 3, 5, 9, 20, 45]))]
        texts += [base, *(alter(base, rng.randint(0, len(base) // 3), rng) for _ in range(3))]
    words = list(word_hashes([" ".join(t) for t in texts]))
    group = [i % 7 if i < 30 else i for i in range(len(texts))]
    every = [(i, j) for j in range(len(texts)) for i in range(j) if group[i] != group[j]]
    want = {p for p, good in zip(every, alignment.similar([(words[i], words[j]) for i, j in every], similarity)) if good and len(words[p[0]]) and len(words[p[1]])}
    groups = spark.createDataFrame(list(enumerate(group)), "node long, group long")
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts) if t], "node long, text string")
    got = [tuple(r) for r in order_minhash._open_pairs(docs, lambda d: d.join(groups, "node"), Workspace(spark, "t4"), similarity).select("a", "b").collect()]
    assert len(want) > 40 and want <= {(min(p), max(p)) for p in got} <= set(every)


def test_a_passage_in_many_texts_makes_few_pairs(spark):
    # two fifths of each text are one passage: three words in a row meet everywhere, the rarest words hardly
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([*(f"v{rng.randrange(40_000)}" for _ in range(60)), *passage])) for i in range(600)]
    rows.append((600, rows[7][1].replace(" ", " more ", 12)))
    docs = spark.createDataFrame(rows, "node long, text string")
    got = order_minhash._open_pairs(docs, lambda d: d.withColumn("group", F.col("node")), Workspace(spark, "t4"), 0.8).collect()
    assert (7, 600) in {(min(r), max(r)) for r in got} and len(got) < 10 * len(rows)


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.9])
def test_k_mers_in_common_are_a_lower_bound(similarity):
    rng = random.Random(3)
    for k in (1, 2, 3):
        for _ in range(400):
            a = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 60))]
            b = alter(a, rng.randint(0, int(0.5 * len(a)) + 1), rng)
            if not b or edits(a, b) > (1 - similarity) * max(len(a), len(b)) + 1e-9:
                continue
            (x, y), _ = zip(*(order_minhash.kmers([next(iter(word_hashes([" ".join(w)])))], k) for w in (a, b)))
            both = len(set(x.tolist()) & set(y.tolist()))
            assert both >= max(order_minhash.in_common(len(w), k, similarity) for w in (a, b))


def test_columns_of_any_name_pass_by(spark):
    names = ["kept", "class_id", "group", "rep", "__node", "__id", "__text", "n", "a.b"]
    docs = spark.createDataFrame([(i, "one two three four five six" if i % 2 else None, *range(i, i + len(names))) for i in range(6)], ["doc_id", "text", *names])
    got = order_minhash.keep_one_of_each(docs, Workspace(spark, "t4"))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id in (0, 1))
    decided = order_minhash.near_duplicates(docs, Workspace(spark, "t4"), keep=docs.columns)
    assert {(r.doc_id, r.class_id, r.kept) for r in decided.collect()} == {(i, i % 2, i < 2) for i in range(6)}


def test_hot_and_other_keys_join_alike(spark, monkeypatch):
    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(2, 1), (3, 2), (None, 3)], "k int, x int")
    right = spark.createDataFrame([(1, 3000, "a"), (2, 1, "b"), (4, 0, "c")], "k int, n long, y string")
    got = join_with_hot(left, right, "k", "n").groupBy("k", "y").count().collect()
    assert sorted(map(tuple, got)) == [(1, "a", 3000), (2, "b", 1)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert order_minhash.near_duplicates(docs, Workspace(spark, "t4")).collect() == []
