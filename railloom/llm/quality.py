"""Quality classifier: perplexity under interpolated modified Kneser-Ney models of trusted text.

Each language has a model of its own, over characters: a character is predicted from the four before
it. Characters stand for themselves up to U+0FFF and by a hash of 12 bits beyond, so five of them are
an exact 60-bit code, and the table of n-grams grows with the corpus.

Trusted text is cut into two halves by a hash of the text. A document is judged by the model of the
half that it is not in, trusted documents among them, so that thresholds hold for unseen text.
A document is rejected if its perplexity is above what ``quantile`` of the trusted documents of its
language have, or below what ``low_quantile`` of them have, as text that repeats itself may be. A
language of fewer than ``MIN_TRUSTED`` trusted documents in either half is judged by the models and
quantiles of all trusted text.

Counts are summed in the tasks, dealt out by n-gram, and joined with the counts of their contexts and
suffixes. The log probability of a character is a sum over its n-grams,

    log P = log(1 / classes) + sum over k of [log gamma_k(context) + correction_k(n-gram)]

where correction_k = log p_k - log gamma_k - log p_(k-1) of a seen n-gram and 0 of others. So a
document's score is a join of its n-grams with a table of weights, summed up, and the join can go shard
by shard: weights are dealt into shards of at most about ``SHARD_ENTRIES``, each shard is broadcast by
itself, and a document's score is the sum of what the shards give it. Each shard is one more pass over
the texts, so choose its size by the memory of the executors.

All text counts, whole. Null and empty texts have no perplexity and are kept, as is everything when
nothing is trusted. A null language is a language. Of labels that contradict each other the worse one
holds. Repeated rows are judged alike. Columns of the input may have any names. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from railloom.llm.common import arrow_schema, mix64, text_groups, to_batch, whole_text
from railloom.workspace import Workspace

ORDER, BITS = 5, 12
CLASSES = 1 << BITS
#: Shares of trusted documents of a language that its thresholds keep below the upper, and lose below the lower one.
QUANTILE, LOW_QUANTILE = 0.995, 0.002
#: Trusted documents that a language needs in each half for models of its own.
MIN_TRUSTED = 20
#: Steps of the histogram of nats per character that quantiles are read from.
STEPS = 4096
#: Characters counted together, and looked up together.
COUNT_CHARS, SCORE_CHARS = 1 << 22, 1 << 19
#: Weights of a shard, about 10 bytes each on the way, packed, and 22 to 43 in the lookup table that a worker makes of them.
SHARD_ENTRIES = 1 << 22
#: Languages up to which a row for each is broadcast; more are joined by merging.
BROADCAST_LANGUAGES = 10_000
#: A code says its order above the 60 bits of its characters.
TAG = BITS * ORDER


def _class(points: np.ndarray) -> np.ndarray:
    """The class of each code point, 1 at least; 0 stands before a text."""
    out = points.astype(np.int64) + 1
    far = np.flatnonzero(out >= CLASSES)
    if len(far):
        out[far] = (1 + mix64(points[far].astype(np.uint64)) % np.uint64(CLASSES - 1)).astype(np.int64)
    return out


def codes(texts: list[str], lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For all characters of all texts the code of the n-gram that ends there, and each text's length.

    With ``lead``, each text also has the place before its first character, whose code is 0.
    """
    before = "\x00" * (ORDER - 1)
    points = np.frombuffer((before + before.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    classes = _class(points)
    starts = np.concatenate([[0], np.cumsum(lengths + ORDER - 1)[:-1]]).astype(np.int64)
    pads = (starts[:, None] + np.arange(ORDER - 1)).ravel()
    classes[pads] = 0
    out = classes.copy()
    for back in range(1, ORDER):
        out[back:] |= classes[:-back] << np.int64(BITS * back)
    real = np.ones(len(points), bool)
    real[(starts[:, None] + np.arange(ORDER - 1 - lead)).ravel()] = False
    if lead:
        out[starts + ORDER - 2] = 0
    return out[real], lengths


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(m, code, c) of all n-grams of (m, text), summed within tasks and then over them. ``m`` tells models apart."""
    schema = arrow_schema("m long, code long, c long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[str]] = {}
        sizes: dict[int, int] = {}

        def flush(m: int) -> pa.RecordBatch:
            found, c = np.unique(codes(held.pop(m))[0], return_counts=True)
            sizes.pop(m)
            return to_batch({"m": np.full(len(found), m), "code": found, "c": c}, schema)

        for batch in batches:
            for m, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held.setdefault(m, []).append(text)
                    sizes[m] = sizes.get(m, 0) + len(text)
                    if sizes[m] >= COUNT_CHARS or sum(sizes.values()) >= 4 * COUNT_CHARS:
                        yield flush(max(sizes, key=sizes.get))
        for m in list(held):
            yield flush(m)

    return texts.select("m", "text").mapInArrow(run, "m long, code long, c long").groupBy("m", "code").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(m, d1, d2, d3): modified Kneser-Ney discounts from counts of counts, kept sensible where these are missing."""
    n = [F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    of = counts.groupBy("m").agg(*n)
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0)
    made = []
    for k in (1, 2, 3):
        low, high = F.col(f"n{k}"), F.col(f"n{k + 1}")
        d = F.least(F.lit(float(k)), F.greatest(F.lit(0.1 * k), k - (k + 1) * F.col("y") * high / F.greatest(low, F.lit(1.0))))
        made.append(F.when((low > 0) & (F.col("y") > 0), d).otherwise(0.5 * k).alias(f"d{k}"))
    return of.withColumn("y", y).select("m", *made)


def train(counts: DataFrame, workspace: Workspace) -> DataFrame:
    """(m, code, corr, lgam): the weights of all n-grams and contexts of all orders, codes tagged with their order.

    Counts of a level are joined, dealt out by model and n-gram, with the totals of their contexts and
    with the probabilities of their suffixes one level down. A context has at most ``CLASSES`` n-grams.
    """
    tables = {ORDER: workspace.table(counts, f"counts_{ORDER}")}
    for n in range(ORDER - 1, 0, -1):
        # lower orders count the characters that an n-gram has been seen after
        lower = tables[n + 1].groupBy("m", F.col("code").bitwiseAND((1 << BITS * n) - 1).alias("code")).agg(F.count("*").alias("c"))
        tables[n] = workspace.table(lower, f"counts_{n}")
    parts, below = [], None
    for n in range(1, ORDER + 1):
        c = F.col("c")
        off = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = tables[n].join(_discounts(tables[n]), "m").withColumn("off", off).withColumn("context", F.shiftright("code", BITS))
        # whole numbers are summed, so that reruns agree to the last bit
        kinds = [F.count(F.when(F.least(c, F.lit(3)) == k, 1)).alias(f"of{k}") for k in (1, 2, 3)]
        contexts = seen.groupBy("m", "context", "d1", "d2", "d3").agg(F.sum("c").alias("total"), *kinds)
        offs = F.col("of1") * F.col("d1") + F.col("of2") * F.col("d2") + F.col("of3") * F.col("d3")
        contexts = contexts.select("m", "context", "total", F.log(offs / F.col("total")).alias("lgam"))
        contexts = workspace.table(contexts, f"contexts_{n}")
        joined = seen.join(contexts, ["m", "context"]).withColumn("suffix", F.col("code").bitwiseAND((1 << BITS * (n - 1)) - 1))
        joined = joined.withColumn("lower", F.lit(float(-np.log(CLASSES)))) if below is None else joined.join(below, ["m", "suffix"])
        lp = F.log((c - F.col("off")) / F.col("total") + F.exp(F.col("lgam") + F.col("lower")))
        probs = joined.select("m", "code", lp.alias("lp"), (lp - F.col("lgam") - F.col("lower")).alias("corr"))
        probs = workspace.table(probs, f"probs_{n}")
        below = probs.select("m", F.col("code").alias("suffix"), F.col("lp").alias("lower"))
        tag = lambda code, order: (F.col(code) + (order << TAG)).alias("code")
        parts.append(probs.select("m", tag("code", n), "corr", F.lit(0.0).alias("lgam")))
        parts.append(contexts.select("m", tag("context", n - 1), F.lit(0.0).alias("corr"), "lgam"))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return workspace.table(made.groupBy("m", "code").agg(F.sum("corr").alias("corr"), F.sum("lgam").alias("lgam")), "weights")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All weights of a task as one compressed row, by model and code."""
    table = pa.Table.from_batches(batches, pa.schema([("m", pa.int64()), ("code", pa.int64()), ("corr", pa.float64()), ("lgam", pa.float64())]))
    if table.num_rows:
        m, code, corr, lgam = (table.column(c).to_numpy() for c in table.column_names)
        order = np.lexsort((code, m))
        raw = b"".join([np.diff(m[order], prepend=0).tobytes(), np.diff(code[order], prepend=0).tobytes(), corr[order].astype("<f4").tobytes(), lgam[order].astype("<f4").tobytes()])
        yield to_batch({"n": [len(m)], "payload": [zstandard.ZstdCompressor(level=3).compress(raw)]}, pa.schema([("n", pa.int64()), ("payload", pa.binary())]))


class Shard:
    """Weights of one shard behind a table of hashes, which is made once in each worker; packed until then."""

    def __init__(self, parts: list[tuple[int, bytes]], whole: bool):
        self.parts, self.whole = parts, whole
        self._slots: np.ndarray | None = None

    def __getstate__(self) -> dict:
        if self.parts is None:
            raise ValueError("a shard travels before it is used")
        return {"parts": self.parts, "whole": self.whole, "_slots": None}

    def _unpacked(self) -> tuple[np.ndarray, ...]:
        cols: tuple[list, ...] = ([], [], [], [])
        for n, payload in self.parts:
            raw = zstandard.ZstdDecompressor().decompress(payload)
            cols[0].append(np.cumsum(np.frombuffer(raw, "<i8", n)))
            cols[1].append(np.cumsum(np.frombuffer(raw, "<i8", n, 8 * n)))
            cols[2].append(np.frombuffer(raw, "<f4", n, 16 * n))
            cols[3].append(np.frombuffer(raw, "<f4", n, 20 * n))
        return tuple(np.concatenate([np.zeros(0, kind), *c]) for c, kind in zip(cols, (np.int64, np.int64, np.float32, np.float32), strict=True))

    @staticmethod
    def _key(m: np.ndarray | int, code: np.ndarray) -> np.ndarray:
        """Never 0, which marks a free slot."""
        return mix64(np.asarray(code).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(m).astype(np.int64).view(np.uint64)) | np.uint64(1)

    def _build(self) -> None:
        m, code, corr, lgam = self._unpacked()
        keys = self._key(m, code)
        self._shift = np.uint64(64 - max(4, (4 * len(keys) // 3).bit_length()))
        home = (keys >> self._shift).astype(np.int64)
        order = np.argsort(home, kind="stable")
        at = np.maximum.accumulate(home[order] - np.arange(len(keys))) + np.arange(len(keys)) if len(keys) else home
        self._reach = int((at - home[order]).max(initial=0)) + 1
        size = int(max(at.max(initial=0), 1 << int(64 - self._shift))) + self._reach + 2
        slots = np.zeros(size, np.uint64)
        values = np.zeros((size, 2), np.float32)
        slots[at], values[at, 0], values[at, 1] = keys[order], corr[order], lgam[order]
        self._slots, self._values, self.parts = slots, values, None

    def find(self, m: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where codes are known, and (corr, lgam) of all, 0 of unknown ones."""
        if self._slots is None:
            self._build()
        keys = self._key(m, code)
        at = (keys >> self._shift).astype(np.int64)
        got = self._slots[at]
        known = got == keys
        values = self._values[at] * known[:, None]
        left = np.flatnonzero(~known & (got != 0))
        for _ in range(self._reach):
            if not len(left):
                break
            at[left] += 1
            got = self._slots[at[left]]
            hit = got == keys[left]
            found = left[hit]
            known[found], values[found] = True, self._values[at[found]]
            left = left[~hit & (got != 0)]
        return known, values

    def sums(self, m: int, texts: list[str]) -> np.ndarray:
        """What this shard gives to the log probability of each text, but for the uniform part."""
        found, lengths = codes(texts, lead=1)
        first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        # each distinct code is looked up once
        order = np.argsort(found)
        ranked = found[order]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        distinct = ranked[fresh]
        which = np.empty(len(found), np.int64)
        which[order] = np.cumsum(fresh) - 1
        corr, lgam = np.zeros(len(distinct)), np.zeros(len(distinct))
        left = np.arange(len(distinct))
        for n in range(1, ORDER + 1):
            known, values = self.find(m, (distinct[left] & ((1 << BITS * n) - 1)) | (n << TAG))
            corr[left] += values[:, 0]
            if n < ORDER:
                lgam[left] += values[:, 1]
            if self.whole:  # what is unknown is part of nothing longer that is known
                left = left[known]
        score, after = corr[which], lgam[which]
        score[first] = 0  # before a text there is no character
        after[first + lengths] = 0  # what stands last is nothing's context
        _, empty = self.find(m, np.array([0], np.int64))
        return np.add.reduceat(score + after, first) + lengths * float(empty[0, 1])


def _shards(weights: DataFrame) -> Iterator[Shard]:
    """The weights, one bounded shard after the other."""
    number = max(1, -(-weights.count() // SHARD_ENTRIES))
    for i in range(number):
        own = weights if number == 1 else weights.where(F.pmod(F.xxhash64("m", "code"), F.lit(number)) == i)
        packed = own.select("m", "code", "corr", "lgam").mapInArrow(_pack, "n long, payload binary").collect()
        yield Shard([(r.n, bytes(r.payload)) for r in packed], number == 1)


def _with_sums(docs: DataFrame, shard: Shard, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``__sum``, from its columns __m and __text; null for empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(shard)
    kind = StructType([*(docs.schema[c] for c in keep), StructField("__sum", DoubleType())])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            models, texts = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()
            sums: list[float | None] = [None] * len(texts)
            of: dict[int, list[int]] = {}
            for i, (m, text) in enumerate(zip(models, texts, strict=True)):
                if text:
                    of.setdefault(m, []).append(i)
            for m, index in of.items():
                some = [texts[i] for i in index]
                for a, b in text_groups(some, SCORE_CHARS):
                    for i, x in zip(index[a:b], own.sums(m, some[a:b]), strict=True):
                        sums[i] = float(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(schema[i].type) for i in range(len(keep))), pa.array(sums, pa.float64())], schema=schema)

    return docs.select(*keep, "__m", "__text").mapInArrow(run, kind)


def with_nats(docs: DataFrame, shards: list[Shard], keep: list[str], workspace: Workspace, name: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``__nats``, nats per character, from its columns __m and __text."""
    nats = lambda total, size: F.lit(float(np.log(CLASSES))) - total / size
    size = F.char_length("__text")
    if len(shards) == 1:
        made = _with_sums(docs.withColumn("__size", size), shards[0], [*keep, "__size"])
        return made.select(*keep, nats(F.col("__sum"), F.col("__size")).alias("__nats"))
    # Rows alike in model and text have the same sums; two hashes and the length stand for the text.
    key = ["__m", "__h1", "__h2", "__size"]
    keyed = docs.withColumns({"__h1": F.xxhash64("__text"), "__h2": F.xxhash64(F.lit(1), "__text"), "__size": size})
    total = None
    for i, shard in enumerate(shards):
        own = workspace.table(_with_sums(keyed, shard, key).where("__sum IS NOT NULL").dropDuplicates(key), f"{name}_{i}")
        total = own if total is None else total.unionByName(own)
    total = total.groupBy(*key).agg(F.sum("__sum").alias("__sum"))
    return keyed.join(total, key, "left").select(*keep, nats(F.col("__sum"), F.col("__size")).alias("__nats"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of documents labelled good and not toxic by all their labels."""
    worst = labels.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.min(F.col("quality")).alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t"))
    return worst.where((F.col("q") == 1) & (F.col("t") == 0)).select("__id")


def thresholds(scores: DataFrame, quantile: float, low_quantile: float) -> DataFrame:
    """(__class, __low, __most): the histogram steps that hold the quantiles of each class; from (__class, __nats)."""
    steps = scores.where("__nats IS NOT NULL").groupBy("__class", F.ceil(F.col("__nats") * STEPS).alias("step")).count()
    total = Window.partitionBy("__class")
    ranked = steps.withColumn("upto", F.sum("count").over(total.orderBy("step"))).withColumn("of", F.sum("count").over(total))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("of"), F.col("step")))
    return ranked.groupBy("__class").agg(at(low_quantile).alias("__low"), at(quantile).alias("__most"))


def _class_of(lang: Column) -> Column:
    """What stands for a language: a string even of null, which no language equals."""
    return F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), lang.cast("string")))


POOLED = "*"


def _judge(
    docs: DataFrame, labels: DataFrame, workspace: Workspace, quantile: float, low_quantile: float, min_trusted: int, id_col: str, text_col: str, lang_col: str, keep: list[str],
) -> DataFrame:
    """The columns ``keep`` as __c0, __c1 ..., with __perplexity, __low, __threshold and __kept."""
    trusted = workspace.table(trusted_ids(labels, id_col), "trusted")
    text = whole_text(text_col)
    fold = F.pmod(F.xxhash64(text), F.lit(2))
    named = docs.select(
        *(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(keep)), F.col(f"`{id_col}`").alias("__id"),
        text.alias("__text"), fold.alias("__fold"), _class_of(F.col(f"`{lang_col}`")).alias("__lang"),
    )
    good = named.select("__id", "__text", "__fold", "__lang").join(trusted, "__id", "left_semi").where("__text <> ''")
    halves = good.groupBy("__lang").agg(*(F.count(F.when(F.col("__fold") == f, 1)).alias(f"n{f}") for f in (0, 1)))
    own = workspace.table(halves.where(F.least("n0", "n1") >= min_trusted).select("__lang", F.col("__lang").alias("__class")), "languages")
    few = own.count() <= BROADCAST_LANGUAGES

    def classed(rows: DataFrame) -> DataFrame:
        joined = rows.join(F.broadcast(own) if few else own.hint("merge"), "__lang", "left")
        return joined.withColumn("__class", F.coalesce("__class", F.lit(POOLED)))

    model = lambda cls, half: F.xxhash64(cls, half).alias("m")
    pooled = not named.select("__lang").distinct().join(own, "__lang", "left_anti").isEmpty()
    mine = classed(good).where(F.col("__class") != POOLED)
    texts = mine.select(model(F.col("__class"), F.col("__fold")), F.col("__text").alias("text"))
    judged = mine
    if pooled:
        texts = texts.unionByName(good.select(model(F.lit(POOLED), F.col("__fold")), F.col("__text").alias("text")))
        judged = judged.unionByName(good.withColumn("__class", F.lit(POOLED)), allowMissingColumns=True)
    weights = train(count_ngrams(texts), workspace)
    if weights.isEmpty():
        nothing = F.lit(None).cast("double")
        return named.select(*(f"__c{i}" for i in range(len(keep))), nothing.alias("__perplexity"), nothing.alias("__low"), nothing.alias("__threshold"), F.lit(True).alias("__kept"))
    shards = list(_shards(weights)) if weights.count() <= SHARD_ENTRIES else _LazyShards(weights)
    # a document is judged by the other half
    other = model(F.col("__class"), 1 - F.col("__fold")).alias("__m")
    scores = with_nats(judged.withColumn("__m", other), shards, ["__class"], workspace, "trusted_sums")
    cuts = workspace.table(thresholds(workspace.table(scores, "trusted_nats"), quantile, low_quantile), "thresholds")  # a row per class
    columns = [f"__c{i}" for i in range(len(keep))]
    scored = with_nats(classed(named).withColumn("__m", other), shards, [*columns, "__class"], workspace, "sums")
    joined = scored.join(F.broadcast(cuts) if few else cuts.hint("merge"), "__class", "left")
    step = F.ceil(F.col("__nats") * STEPS)
    within = (step <= F.col("__most")) & (step >= F.col("__low"))
    return joined.select(
        *columns, F.exp("__nats").alias("__perplexity"), F.exp((F.col("__low") - 1) / STEPS).alias("__low"),
        F.exp(F.col("__most") / STEPS).alias("__threshold"), F.coalesce(within, F.lit(True)).alias("__kept"),
    )


class _LazyShards:
    """Shards that come to the driver one at a time, as often as they are gone through."""

    def __init__(self, weights: DataFrame):
        self.weights, self.number = weights, -(-weights.count() // SHARD_ENTRIES)

    def __len__(self) -> int:
        return self.number

    def __iter__(self) -> Iterator[Shard]:
        return _shards(self.weights)


def classify(
    docs: DataFrame, labels: DataFrame, workspace: Workspace, quantile: float = QUANTILE, low_quantile: float = LOW_QUANTILE, min_trusted: int = MIN_TRUSTED,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_docs: bool = True,
) -> DataFrame:
    """``docs`` (or, without ``with_docs``, their ids alone) with perplexity, low, threshold and kept.

    ``labels`` has ``id_col``, quality and toxic: what is labelled good is the trusted text.
    Columns of ``docs`` by those four names are replaced.
    """
    names = ("perplexity", "low", "threshold", "kept")
    keep = [c for c in docs.columns if c not in names] if with_docs else [id_col]
    made = _judge(docs, labels, workspace, quantile, low_quantile, min_trusted, id_col, text_col, lang_col, keep)
    return made.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)), *(F.col(f"__{c}").alias(c) for c in names))


def keep_good(
    docs: DataFrame, labels: DataFrame, workspace: Workspace, quantile: float = QUANTILE, low_quantile: float = LOW_QUANTILE, min_trusted: int = MIN_TRUSTED,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The documents that the classifier keeps, with their own columns and no others."""
    made = _judge(docs, labels, workspace, quantile, low_quantile, min_trusted, id_col, text_col, lang_col, docs.columns)
    return made.where("__kept").select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))
