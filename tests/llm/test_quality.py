import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from railloom.llm import quality
from railloom.llm.quality import CLASSES, ORDER, codes
from railloom.workspace import Workspace


def discounts(n1, n2, n3, n4):
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    return tuple(min(float(k), max(0.1 * k, k - (k + 1) * y * high / low)) if low and y else 0.5 * k for k, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1))


class Plain:
    """The same model in plain loops."""

    def __init__(self, trusted):
        grams = Counter(c for t in trusted for c in codes([t])[0].tolist())
        self.counts = {ORDER: grams}
        for n in range(ORDER - 1, 0, -1):
            self.counts[n] = Counter(c % CLASSES**n for c in self.counts[n + 1])
        self.parts = {}
        for n, own in self.counts.items():
            of = Counter(own.values())
            self.parts[n] = (discounts(of[1], of[2], of[3], of[4]), defaultdict(list))
            for code, c in own.items():
                self.parts[n][1][code // CLASSES].append(c)

    def p(self, code, n=ORDER):
        if n == 0:
            return 1 / CLASSES
        d, contexts = self.parts[n]
        own = contexts.get(code // CLASSES)
        if not own:
            return self.p(code % CLASSES ** (n - 1), n - 1)
        c = self.counts[n].get(code, 0)
        off = lambda c: 0 if not c else d[min(c, 3) - 1]
        return (c - off(c)) / sum(own) + sum(map(off, own)) / sum(own) * self.p(code % CLASSES ** (n - 1), n - 1)

    def nats(self, text):
        found = codes([text])[0].tolist()
        return -sum(math.log(self.p(c)) for c in found) / len(found)


def make(n=120, seed=2):
    random.seed(seed)
    words = ["the", "and", "river", "stone", "walking", "Énorme", "über", "time", "of", "light."]
    rows, labels = [], []
    for i in range(n):
        junk = i % 6 == 5
        text = " ".join(random.choice(["%%", "|", "XQ", "!!", "zzq"]) if junk else random.choice(words) for _ in range(random.randint(3, 60)))
        rows.append((i, text, ("en", "fr", None)[i % 3], i, "x"))
        if i % 2 == 1 or i % 7 == 0:
            labels.append((i, 0 if junk else 1, 1 if i == 9 else 0))
    labels += [(3, 0, 0), (21, 1, None), (None, 1, 0), (5000, 1, 0)]
    rows += [(900, None, "en", 1, "x"), (901, "", "fr", 1, "x"), (902, "%% ## " * 20_000, "en", 1, "x"), (903, "漢字 б\U0001f600\x00", "xx", 1, "x"), (1, rows[1][1], "fr", 1, "x"), (None, "the river", "en", 1, "x")]
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, most int, perplexity string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("entries", [quality.SHARD_ENTRIES, 700])
def test_judgement_matches_plain_loops(spark, monkeypatch, entries):
    monkeypatch.setattr(quality, "SHARD_ENTRIES", entries)
    rows, labels = make(260)
    docs, marks = frames(spark, rows, labels)
    got = quality.classify(docs, marks, Workspace(spark, "t9"), quantile=0.9, low_quantile=0.05, min_trusted=4).collect()
    marked = defaultdict(list)
    for i, q, t in labels:
        marked[i].append((q, t or 0))
    good = {i for i, own in marked.items() if min(q for q, _ in own) == 1 and max(t for _, t in own) == 0 and i is not None}
    half = {r.t: r.h for r in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(2)).alias("h")).collect()}
    trusted = [r for r in rows if r[0] in good and r[1]]
    sizes = Counter((r[2], half[r[1]]) for r in trusted)
    own = {lang for lang in {r[2] for r in rows} if min(sizes[lang, 0], sizes[lang, 1]) >= 4}
    assert own == {"en", "fr"}  # the others are judged by the pooled models
    models = {(lang, h): Plain([r[1] for r in trusted if r[2] == lang and half[r[1]] == h]) for lang in own for h in (0, 1)}
    models |= {("*", h): Plain([r[1] for r in trusted if half[r[1]] == h]) for h in (0, 1)}
    cls = lambda lang: lang if lang in own else "*"
    nats = lambda text, lang: models[cls(lang), 1 - half[text]].nats(text)
    want = {}
    for i, text, lang, *_ in rows:
        want[str(i), lang, text or ""] = math.exp(nats(text, lang)) if text else None
    cuts = {}
    for c in {cls(r[2]) for r in rows}:
        steps = sorted(math.ceil(models[c, 1 - half[r[1]]].nats(r[1]) * quality.STEPS) for r in trusted if c in ("*", r[2]))
        cuts[c] = steps[math.ceil(0.05 * len(steps)) - 1], steps[math.ceil(0.9 * len(steps)) - 1]
    assert len(got) == len(rows)
    for r in got:
        expected = want[str(r.doc_id), r.lang, r.text or ""]
        assert r.perplexity == (None if expected is None else pytest.approx(expected, rel=1e-4))
        low, most = cuts[cls(r.lang)]
        assert math.log(r.threshold) * quality.STEPS == pytest.approx(most, abs=1.5) and math.log(r.low) * quality.STEPS == pytest.approx(low - 1, abs=1.5)
        assert r.kept == (r.perplexity is None or r.low * (1 - 1e-9) < r.perplexity <= r.threshold * (1 + 1e-9))


def test_junk_goes_and_prose_stays(spark):
    rows, labels = make(600, 4)
    docs, marks = frames(spark, rows, labels)
    kept = quality.keep_good(docs, marks, Workspace(spark, "t9"))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    junk, prose = {i for i in range(600) if i % 6 == 5}, {i for i in range(600) if i % 6 != 5}
    assert len(ids & junk) <= 5 and len(ids & prose) >= 0.95 * len(prose)
    assert {900, 901} <= ids and 902 not in ids


def test_labelled_documents_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id: r.kept for r in quality.classify(docs, labels, Workspace(spark, "t9"), with_docs=False).collect()}
    marks = [r for r in labels.collect() if r.doc_id in kept]
    share = lambda rows: np.mean([kept[r.doc_id] for r in rows])
    assert share([r for r in marks if r.quality == 1]) >= 0.96
    assert share([r for r in marks if r.quality == 0]) <= 0.12


def test_nothing_trusted_or_no_documents(spark):
    rows, _ = make(10)
    docs, marks = frames(spark, rows, [])
    got = quality.classify(docs, marks, Workspace(spark, "t9"))
    assert got.where("kept").count() == len(rows)
    docs, marks = frames(spark, [], [(1, 1, 0)])
    assert quality.classify(docs, marks, Workspace(spark, "t9")).collect() == []


def test_probabilities_sum_to_one():
    rows, _ = make(40)
    model = Plain([r[1] or "" for r in rows])
    for context in list(model.parts[ORDER][1])[:20]:
        assert sum(model.p(context * CLASSES + w) for w in range(CLASSES)) == pytest.approx(1, abs=1e-6)


def test_codes_of_odd_characters():
    found, lengths = codes(["", "a\u0fffé", "漢\U0001f600\ud800"], lead=1)
    assert lengths.tolist() == [0, 3, 3] and len(found) == 9 and (found[[0, 1, 5]] == 0).all()
    assert found[2] == ord("a") + 1 and (found >= 0).all() and all(0 < c % CLASSES for c in found[[2, 3, 4, 6, 7, 8]].tolist())
    assert codes(["abcdef"])[0][-1] == codes(["bcdef"])[0][-1] != codes(["cbdef"])[0][-1]
