import hashlib
import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from railloom.llm import line_dedup
from railloom.workspace import Workspace

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=40, min_docs=5):
    docs = defaultdict(set)
    order = lambda i: (i is not None, i)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= min_chars:
                docs[key].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        lost = []
        for p, line in enumerate(lines):
            key = line.strip(SPACE).translate(LOWER)
            if len(docs.get(key, ())) >= min_docs and max(docs[key], key=order) != i:
                lost.append(p)
        kept = "\n".join(x for p, x in enumerate(lines) if p not in lost)
        runs, keep = [0], True
        for p in range(len(lines)):
            if (p not in lost) != keep:
                keep = not keep
                runs.append(0)
            runs[-1] += 1
        runs += [0] * (len(runs) % 2 == 0 and lost[-1:] == [len(lines) - 1])
        out.append((str(i), len(lines), len(lost), hashlib.sha256(kept.encode()).hexdigest(), runs))
    return sorted(out)


def got(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos string, h1 int").repartition(parts)
    made = line_dedup.drop_lines(docs, Workspace(spark, "t10"))
    assert set(docs.columns) <= set(made.columns)
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.sha, r.keep_runs) for r in made.withColumn("sha", F.sha2("text", 256)).collect())


def make_rows():
    random.seed(11)
    shared = ["Shared Line number %d that is long enough to be counted ÉÀ" % i for i in range(12)]
    rows = []
    for i in range(60):
        lines = [f"own line of document {i} at {j} that nobody else has at all" for j in range(random.randint(0, 3))]
        lines += [random.choice([" ", "\t", ""]) + random.choice([s, s.upper() if "É" not in s else s.swapcase().replace("éà", "ÉÀ")]) + "\r" for s in random.sample(shared, random.randint(0, 4))]
        lines += ["a hot line that every document in this small table holds, more than once"] * random.randint(1, 3)
        random.shuffle(lines)
        rows.append((i, "\n".join(lines), "x", 1))
    rows += [(100, None, "x", 1), (101, "", "x", 1), (102, "\n\n", "x", 1), (103, "y" * 50_000, "x", 1), (None, rows[0][1], "x", 1), (5, rows[5][1], "x", 1), (6, "other text under a used id\n" + shared[0], "x", 1)]
    return rows


def test_matches_brute_force(spark):
    rows = make_rows()
    assert got(spark, rows) == brute(rows)


def test_hot_way_counts_alike(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SAMPLE_ONE_IN", 1)
    monkeypatch.setattr(line_dedup, "COMMON_SHARE", 1e-9)
    rows = make_rows()
    assert got(spark, rows, 1) == brute(rows)


def test_empty_table(spark):
    assert got(spark, [], 1) == []


def test_many_lost_lines_take_time_in_proportion(spark):
    text = "\n".join(f"line number {i} that is long enough to be counted as shared" for i in range(64_000))
    rows = [(i, text + "\nown line" if i % 2 else "own line\n" + text) for i in range(5)]
    began = time.perf_counter()
    made = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t10")).collect()
    assert time.perf_counter() - began < 60
    assert {r.doc_id: (r.n_dropped, r.text if r.doc_id < 4 else len(r.text)) for r in made} == {i: (64_000, "own line") if i < 4 else (0, len(rows[4][1])) for i in range(5)}


def test_columns_of_any_name_pass_by(spark):
    names = ["n_lines", "n_dropped", "keep_runs", "__id", "__lost", "lost", "text_hash", "pos", "a.b"]
    docs = spark.createDataFrame([(i, "a line that six documents of this table hold, of course" if i else "own", *range(i, i + len(names))) for i in range(7)], ["doc_id", "text", *names])
    got = line_dedup.without_shared_lines(docs, Workspace(spark, "t10"))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted((r[0], r[1] if r[0] in (0, 6) else "", *r[2:]) for r in docs.collect())
    made = line_dedup.drop_lines(docs, Workspace(spark, "t10")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.keep_runs, r.lost) for r in made) == [(i, 1, int(0 < i < 6), [0, 1, 0] if 0 < i < 6 else [1], i + 5) for i in range(7)]
