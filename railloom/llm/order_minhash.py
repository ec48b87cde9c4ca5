"""MinHash near-dedup by Order MinHash.

A sketch of a document keeps, under one seeded order, the two smallest of its k-mers of words, each
labelled with its occurrence number, and lists them in text order. Two documents share a sketch the
more likely the fewer edits lead from one to the other. Documents that share one of their sketches
are candidates, and a banded alignment of their words decides: near-duplicates have an edit
similarity, 1 - edits / longer length, of at least ``similarity``. The k-mers only find candidates;
they are shorter than five words, as edits of a fifth of the words leave few longer ones whole. The
number of sketches follows from the similarity, so that a pair that just reaches it shares one with
a probability of 1 - ``MISS``. Texts of up to ``SHORT`` words are sketched by k-mers of two words;
those near the border, which may be similar to texts on either side of it, in both ways.

Copies with the same words collapse into one representative first. Pairs whose lengths alone rule
them out are never formed. Then:

1. Within a bucket, its smallest document leads: all others are aligned with it.
2. In buckets of up to ``SMALL`` documents, all pairs that do not hang together yet are aligned.
3. Documents of larger buckets meet again in buckets of those that share ``AGREE`` neighbouring
   sketches. In these, documents that hang together with no leader yet are led by further ones of
   their own, more at a time in each round, which are aligned with the whole bucket but what they
   already hang together with. ``ROUNDS`` rounds join most of what belongs together and leave the
   next step less to do.
4. What is still open between documents of larger buckets is settled exactly. Similar documents have
   all but a fifth of their words in common, so that one of each one's rarest words, a fifth and one
   more, is among the other's. Documents that meet by the first word they have in common, with enough
   words left behind it, and do not hang together yet are aligned. A bucket of a word in which too
   many meet is split by the next word in common, which the same count bounds.

One passage that many documents share lands them in one large bucket by chance of one sketch, hardly
of several, and its words are not among the rarest of theirs, so that their number is not squared
unless the passage is most of them. No two similar documents that share a bucket, however large, are
left apart.

Groups are the connected components. Decisions are made on ids; the columns asked for join them last,
by a unique row number. Documents without words, null and empty texts among them, are copies of each
other. Documents of fewer words than k have one k-mer of all their words. Repeated rows are copies:
one of them stays. Of a group the row with the smallest id stays, a null id last. An empty table gives
no rows. Columns of the input may have any names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from railloom.llm.alignment import similar
from railloom.llm.common import arrow_schema, join_with_hot, mix64, text_groups, to_batch
from railloom.llm.graph import connected_components
from railloom.llm.word_hashes import word_hashes
from railloom.workspace import Workspace

K, SHORT_K, SHORT, SIMILARITY = 3, 2, 40, 0.8
#: Probability that a pair just at the similarity shares no sketch; k-mers kept in a sketch.
MISS, SAMPLED = 0.02, 2
#: Largest bucket all of whose open pairs are aligned.
SMALL = 64
#: Neighbouring sketches that all agree in the buckets of further rounds.
AGREE = 6
#: k-mers put under all orders together; bits that hold a k-mer's place, in longer documents more.
GROUP_WORDS, PLACE_BITS = 1 << 16, 24
#: Buckets of common words are split by a further one where more than so many documents are outside
#: their largest group and so many pairs to a row that the split makes are saved; words in a key at most.
LESSER, WORTH, LEVELS = 64, 4, 3
#: Common words before the key's that are remembered, so that a pair comes up once.
SKIPPED = 32
#: Parts that the pairs of one leader are dealt over.
PARTS = 64
#: Rounds of further leaders, which only spare work: what they leave open is settled after them.
ROUNDS = 1
#: Further leaders of a bucket grow by this factor from round to round.
GROWTH = 4
#: Bytes of text aligned at once.
ALIGN_BYTES = 1 << 23
_END = np.uint64((1 << 64) - 1)


def sketches_for(similarity: float, k: int) -> int:
    """Sketches that a pair just at ``similarity``, its edits spread at random, needs to share one."""
    whole = similarity**k
    agree = (whole / (2 - whole)) ** SAMPLED
    return 1 if agree >= 1 else math.ceil(math.log(MISS) / math.log(1 - agree))


def kmers(docs: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers of documents, in text order, and how many each has."""
    padded = [w if len(w) >= k else np.concatenate([w, np.ones(k - len(w), np.uint64)]) for w in docs]
    sizes = np.array([len(w) for w in padded])
    counts = sizes - k + 1
    owner = np.repeat(np.arange(len(docs)), counts)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(np.cumsum(sizes) - sizes, counts)
    words = np.concatenate(padded)
    made = np.ones(len(first), np.uint64)
    for j in range(k):
        made = made * np.uint64(0x100000001B3) + words[first + j]
    made = mix64(made + np.repeat(np.minimum([len(w) for w in docs], k).astype(np.uint64), counts))
    # equal k-mers of one document stand together, in text order
    told = mix64(made + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(told, kind="stable")
    ranked = told[order]
    place = np.arange(len(told))
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    occurrence = np.empty(len(told), np.uint64)
    occurrence[order] = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return mix64(made + occurrence * np.uint64(0xD1B54A32D192ED03)), counts


def sketch_group(docs: list[np.ndarray], k: int, sketches: int) -> np.ndarray:
    """Keys (document, sketch): the hash of the ``SAMPLED`` smallest k-mers in text order."""
    grams, counts = kmers(docs, k)
    starts = np.cumsum(counts) - counts
    bits = np.uint64(max(PLACE_BITS, int(counts.max()).bit_length()))  # longer documents come alone
    places = (np.arange(len(grams)) - np.repeat(starts, counts)).astype(np.uint64)
    high, low = ~((np.uint64(1) << bits) - np.uint64(1)), (np.uint64(1) << bits) - np.uint64(1)
    out = np.empty((len(docs), sketches), np.uint64)
    for i, seed in enumerate(mix64(np.arange(1, sketches + 1, dtype=np.uint64) + np.uint64(k << 32))):
        ranks = ((grams ^ seed) * (seed | np.uint64(1))) & high | places
        chosen = np.empty((SAMPLED, len(docs)), np.int64)
        for n in range(SAMPLED):
            least = np.minimum.reduceat(ranks, starts)
            # a document of fewer k-mers repeats its first
            chosen[n] = np.where(least == _END, chosen[0], (least & low).astype(np.int64)) if n else (least & low).astype(np.int64)
            ranks[ranks == np.repeat(least, counts)] = _END
        chosen.sort(axis=0)
        key = np.full(len(docs), seed)  # a key belongs to its sketch
        for at in chosen:
            key = mix64(key * np.uint64(31) + grams[starts + at])
        out[:, i] = key
    return out.view(np.int64)


def sketches(docs: list[np.ndarray], similarity: float = SIMILARITY) -> list[np.ndarray]:
    """The keys of each document; of none that has no words."""
    out = [np.zeros(0, np.int64) for _ in docs]
    long_from = int(similarity * (SHORT + 1))
    families = ((SHORT_K, 2 * sketches_for(similarity, SHORT_K), lambda n: 0 < n <= SHORT), (K, sketches_for(similarity, K), lambda n: n >= max(1, long_from)))
    for k, number, takes in families:
        held: list[int] = []
        mine = [i for i, w in enumerate(docs) if takes(len(w))]
        for at, i in enumerate(mine):
            held.append(i)
            following = len(docs[mine[at + 1]]) if at + 1 < len(mine) else 0
            if at + 1 == len(mine) or sum(len(docs[j]) for j in held) + following > GROUP_WORDS:
                for j, keys in zip(held, sketch_group([docs[j] for j in held], k, number), strict=True):
                    out[j] = np.concatenate([out[j], keys])
                held = []
    return out


def _sketched(docs: DataFrame, similarity: float) -> DataFrame:
    """The rows with a digest and the number of their words, and their keys; other columns ride along."""
    kind = StructType([*docs.schema.fields, StructField("__digest", BinaryType()), StructField("__words", LongType()), StructField("__keys", ArrayType(LongType()))])
    schema = to_arrow_schema(kind)
    at = docs.columns.index("__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = list(word_hashes([t or "" for t in batch.column(at).to_pylist()]))
            made = [
                pa.array([hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in words], pa.binary()),
                pa.array([len(w) for w in words], pa.int64()), pa.array(sketches(words, similarity), pa.list_(pa.int64())),
            ]
            own = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*own, *made], schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, kind)


def _may(a: Column, b: Column, similarity: float) -> Column:
    """Whether texts of these numbers of words can be similar at all."""
    return F.abs(a - b) <= F.floor(F.lit(1 - similarity) * F.greatest(a, b) + F.lit(1e-9))


def in_common(words: int, k: int, similarity: float) -> int:
    """k-mers that a document of so many words has in common with every similar one, at least."""
    more = np.arange(math.floor(words * (1 - similarity) / similarity) + 2)
    edits = np.floor((1 - similarity) * (words + more) + 1e-9)
    # a word replaced or deleted ends k k-mers, one inserted one less; a longer document needs insertions
    ended = np.where(edits >= more, k * edits - more, 0).max()
    return max(0, words - k + 1) - int(ended)


def _ranked(texts: DataFrame, workspace: Workspace, similarity: float) -> DataFrame:
    """(node, words, least, list): each document's occurrence-labelled words but those that no other has, the rarest
    first, and how many it has in common with every similar one."""
    kind = "node long, words long, least long, word long"
    schema = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, told = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in text_groups([t or "" for t in told]):
                made, counts = kmers(list(word_hashes([t or "" for t in told[start:end]])), 1)
                least = [in_common(n, 1, similarity) for n in counts.tolist()]
                yield to_batch({"node": np.repeat(nodes[start:end], counts), "words": np.repeat(counts, counts), "least": np.repeat(least, counts), "word": made.view(np.int64)}, schema)

    words = workspace.table(texts.select("node", "text").mapInArrow(run, kind), "words")
    common = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    ranked = words.join(common.hint("merge"), "word").groupBy("node", "words", "least").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("list"))
    return workspace.table(ranked.select("node", "words", "least", F.col("list.word").alias("list")), "ranked")


def _open_pairs(texts: DataFrame, grouped: Callable[[DataFrame], DataFrame], workspace: Workspace, similarity: float) -> DataFrame:
    """Pairs (a, b) that may be similar and do not hang together, none that is similar left out; ``grouped`` adds ``group``."""
    ranked = _ranked(texts, workspace, similarity)
    allowed = lambda words: F.floor(F.lit(1 - similarity) * words + F.lit(1e-9))
    held = F.size("list").cast("long")
    # all but the last ``least`` of the words that it holds can be without a partner: the next one in common is among ``room``
    room = F.least(F.col("held") - F.col("least") - F.col("at") + F.col("told") + 1, F.col("held") - F.col("at")).alias("room")
    state = ranked.select("node", "words", held.alias("held"), "least", "list", F.lit(0).alias("told"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("key"), F.array().cast("array<long>").alias("skipped"))
    own, found = ["node", "words", "held", "least"], None
    for level in range(1, LEVELS + 1):
        following = F.posexplode(F.slice("list", F.col("at").cast("int") + 1, F.col("room").cast("int"))).alias("on", "word")
        met = state.select("*", room).where("room > 0").select("*", following)
        before = F.concat("skipped", F.slice("list", F.greatest(F.lit(0), F.col("on") - SKIPPED) + F.col("at").cast("int") + 1, F.least(F.col("on"), F.lit(SKIPPED))))
        met = met.select(*own, F.lit(level).alias("told"), (F.col("at") + F.col("on") + 1).alias("at"), F.xxhash64("key", "word").alias("key"), F.slice(F.reverse(before), 1, SKIPPED).alias("skipped"))
        met = grouped(met).select("*", room)
        sizes = met.groupBy("key", "group").agg(F.count("*").alias("size"), F.sum("room").alias("room"))
        sizes = sizes.groupBy("key").agg(F.sum("size").alias("size"), F.sum("room").alias("rooms"), F.max(F.struct("size", "group")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
        lesser = F.col("size") - F.col("most.size")
        split = (lesser > LESSER) & (lesser * F.col("size") > F.col("rooms") * WORTH) & F.lit(level < LEVELS)
        met = workspace.table(met.join(sizes.select("key", F.col("most.group").alias("largest"), split.alias("split")), "key"), f"open_{level}")
        # of two groups at least one is not the largest; where a bucket is split, those ask that may have no further word in common
        whole = F.col("least") <= F.col("told")
        side = met.select("key", "node", "words", (F.col("held") - F.col("at")).alias("left"), "group", "skipped", F.when(F.col("split"), whole).otherwise(F.col("group") != F.col("largest")).alias("asks"))
        asking = side.where("asks").select("key", *(F.col(c).alias(f"{c}_a") for c in ("node", "words", "left", "group", "skipped")))
        longer = F.greatest("words", "words_a")
        # a pair meets by the first words that it has in common, and enough must be left behind them
        once = (F.col("group") != F.col("group_a")) & (~F.col("asks") | (F.col("node_a") < F.col("node"))) & ~F.arrays_overlap("skipped", "skipped_a")
        pairs = asking.join(side, "key").where(once & (F.least("left", "left_a") + level >= longer - allowed(longer)))
        pairs = workspace.table(pairs.select(F.col("node_a").alias("a"), F.col("node").alias("b")), f"open_pairs_{level}")
        found = pairs if found is None else found.unionByName(pairs)
        if not met.agg(F.max("split")).first()[0]:
            break
        state = met.where(F.col("split") & ~whole).select(*own, "told", "at", "key", F.reverse("skipped").alias("skipped")).join(ranked.select("node", "list").hint("merge"), "node")
    return found


def _buckets(keyed: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """``keyed`` (key, node, words) with n, leader and leader_words, for keys that more than one node has; the smallest node leads."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "words")).alias("lead")).where("n > 1")
    shared = shared.select("key", "n", F.col("lead.node").alias("leader"), F.col("lead.words").alias("leader_words"))
    return workspace.table(keyed.join(shared, "key"), name)


def _align(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar. ``texts`` has node and text."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    # Pairs grow with the input as texts do: neither is ever broadcast. A leader's pairs are dealt
    # out over parts, so that no leader gathers all that it is aligned with.
    parted = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int"))
    with_b = parted.join(side("b").hint("merge"), "b")
    with_a = parted.select("a", "part").distinct().join(side("a").hint("merge"), "a")
    rows = with_b.join(with_a.hint("merge"), ["a", "part"]).select("a", "b", "text_a", "text_b")
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            group = np.cumsum(sizes) // ALIGN_BYTES
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                a, b, text_a, text_b = (c.to_pylist() for c in batch.slice(start, end - start).columns)
                own = dict(zip([*a, *b], [*text_a, *text_b], strict=True))
                words = dict(zip(own, word_hashes([t or "" for t in own.values()]), strict=True))
                good = similar([(words[x], words[y]) for x, y in zip(a, b, strict=True)], similarity)
                yield to_batch({"a": [x for x, g in zip(a, good, strict=True) if g], "b": [y for y, g in zip(b, good, strict=True) if g]}, schema)

    return rows.mapInArrow(run, "a long, b long")


def _components(reps: DataFrame, texts: DataFrame, workspace: Workspace, similarity: float) -> DataFrame:
    """(node, component) of the representatives that links join; ``reps``: node, words, keys."""
    ends = [F.col("a"), F.col("b")]
    members = _buckets(reps.select("node", "words", F.explode("keys").alias("key")), workspace, "members")

    # 1. Each bucket's leader with all others.
    led = members.where((F.col("node") != F.col("leader")) & _may(F.col("words"), F.col("leader_words"), similarity))
    pairs = workspace.table(led.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs_0")
    links = workspace.table(_align(pairs, texts, similarity), "links_0")
    components = connected_components(links, workspace, "c0")

    def grouped(state: DataFrame) -> DataFrame:
        return state.join(components, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")

    def aligned(new: DataFrame, name: str) -> None:
        nonlocal pairs, links, components
        new = new.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        new = workspace.table(new, f"pairs_{name}")
        found = workspace.table(_align(new, texts, similarity), f"links_{name}")
        pairs = pairs.unionByName(new)
        if not found.isEmpty():
            links = links.unionByName(found)
            components = connected_components(links, workspace, f"c{name}")

    # 2. In small buckets, everything that does not hang together yet.
    small = workspace.table(grouped(members.where(F.col("n") <= SMALL).select("key", "node", "words")), "small")
    open_ = small.groupBy("key").agg((F.min("group") < F.max("group")).alias("open")).where("open").select("key")
    small = small.join(open_, "key", "left_semi")
    other = small.select("key", F.col("node").alias("b"), F.col("words").alias("words_b"), F.col("group").alias("group_b"))
    met = small.withColumnRenamed("node", "a").join(other, "key").where((F.col("a") < F.col("b")) & (F.col("group") != F.col("group_b")))
    aligned(met.where(_may(F.col("words"), F.col("words_b"), similarity)), "1")

    # 3. In large ones, where several sketches agree: among those that hang together with no leader of their bucket yet.
    crowded = members.where(F.col("n") > SMALL).select("node").distinct()
    steps = F.when(F.size("keys") >= AGREE, F.sequence(F.lit(1), F.size("keys") - AGREE + 1)).otherwise(F.array().cast("array<int>"))
    agree = F.transform(steps, lambda i: F.xxhash64(F.slice("keys", i, AGREE)))
    again = _buckets(reps.join(crowded, "node", "left_semi").select("node", "words", F.explode(agree).alias("key")), workspace, "agreeing")
    state = again.select("key", "node", "words", F.lit(False).alias("led"))
    round_, most = 1, 1
    while round_ <= ROUNDS:
        round_ += 1
        marked = grouped(state)
        led = marked.where("led").select("key", "group").distinct().withColumn("reached", F.lit(True))
        open_ = marked.join(led, ["key", "group"], "left")
        # a bucket all of whose documents are reached is done
        left = open_.where("reached IS NULL").select("key").distinct()
        state = workspace.table(open_.join(left, "key", "left_semi"), f"state_{round_}")
        if state.isEmpty():
            break
        rank = F.row_number().over(Window.partitionBy("key").orderBy("node"))
        leaders = state.where("reached IS NULL").withColumn("r", rank).where(F.col("r") <= most)
        leaders = workspace.table(leaders.select("key", F.col("node").alias("a"), F.col("words").alias("words_a"), F.col("group").alias("group_a")), f"leaders_{round_}")
        new = leaders.join(state.select("key", F.col("node").alias("b"), "words", "group"), "key")
        aligned(new.where((F.col("group") != F.col("group_a")) & _may(F.col("words"), F.col("words_a"), similarity)), str(round_))
        now = leaders.select("key", F.col("a").alias("node"), F.lit(True).alias("now"))
        state = state.join(now, ["key", "node"], "left").select("key", "node", "words", (F.col("led") | F.coalesce("now", F.lit(False))).alias("led"))
        most *= GROWTH

    # 4. What is still open between documents of large buckets: those that their rarest words join.
    crowded = workspace.table(crowded, "crowded")
    if crowded.isEmpty():
        return components
    aligned(_open_pairs(texts.join(crowded, "node", "left_semi"), grouped, workspace, similarity), "rest")
    return components


def _decided(docs: DataFrame, workspace: Workspace, similarity: float, id_col: str, text_col: str, keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The stored rows (__node, __id, and the columns of ``keep`` as __k0, __k1 ...) and (__node, __class, __kept)."""
    own = [c for c in keep if c != text_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), *(F.col(f"`{c}`").alias(f"__k{keep.index(c)}") for c in own))
    made = _sketched(rows, similarity).withColumn("__node", F.monotonically_increasing_id())
    rows = workspace.table(made, "sketched")  # written, the node numbers stay as they are

    # Copies: one node for each sequence of words.
    copies = workspace.table(rows.groupBy("__digest").agg(F.min("__node").alias("rep"), F.count("*").alias("n")), "copies")
    reps = rows.where("__words > 0").select("__digest", F.col("__node").alias("rep"), "__words", "__keys").join(copies, ["__digest", "rep"], "left_semi")
    reps = workspace.table(reps.select(F.col("rep").alias("node"), F.col("__words").alias("words"), F.col("__keys").alias("keys")), "reps")
    components = _components(reps, rows.select(F.col("__node").alias("node"), F.col("__text").alias("text")), workspace, similarity)

    groups = copies.join(components, F.col("rep") == F.col("node"), "left").select("__digest", "n", F.coalesce("component", "rep").alias("group"))
    groups = workspace.table(groups, "groups")
    named = workspace.table(join_with_hot(rows.select("__digest", "__id", "__node"), groups, "__digest", "n").select("__id", "__node", "group"), "named")
    first = F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__node")))
    firsts = named.groupBy("group").agg(first.alias("f"), F.count("*").alias("n"))
    firsts = workspace.table(firsts.select("group", "n", F.col("f.__id").alias("__class"), F.col("f.__node").alias("__first")), "firsts")
    decided = join_with_hot(named, firsts, "group", "n").select("__node", "__class", (F.col("__node") == F.col("__first")).alias("__kept"))
    if text_col in keep:
        rows = rows.withColumn(f"__k{keep.index(text_col)}", F.col("__text"))
    return rows, decided


def near_duplicates(
    docs: DataFrame, workspace: Workspace, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: ``id_col``, class_id (the smallest id of its group), kept, and the columns of ``keep`` but those by these names."""
    keep = [c for c in keep if c not in (id_col, "class_id", "kept")]
    rows, decided = _decided(docs, workspace, similarity, id_col, text_col, keep)
    out = rows.select("__node", "__id", *(f"__k{i}" for i in range(len(keep)))).join(decided, "__node")
    return out.select(F.col("__id").alias(id_col), F.col("__class").alias("class_id"), F.col("__kept").alias("kept"), *(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)))


def keep_one_of_each(docs: DataFrame, workspace: Workspace, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row that stays of each group, with its own columns and no others."""
    rows, decided = _decided(docs, workspace, similarity, id_col, text_col, docs.columns)
    stays = decided.where("__kept").select("__node")
    return rows.join(stays, "__node").select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(docs.columns)))
