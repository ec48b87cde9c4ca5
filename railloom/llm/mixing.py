"""Mixing sources to target weights by capped water-filling.

Each source asks for its share of the wanted size by weight. A source whose share is above what
its documents give at the most epochs is clamped there, and the excess goes to the others in
proportion to their weights, until no share is above its cap. A source then repeats every document
a whole number of times, and a seeded sample of its documents once more for the rest.

The sample takes documents in the order of a seeded hash while they fit, passes over the one that
does not and goes on with those that still can, and at last takes the one remaining document whose
size is nearest to what is missing, if that comes nearer to the target. A source that is still off,
as one of few documents may be, tries its largest documents first, then other seeded orders, and keeps the
best. Every choice is a comparison
with a few numbers per source, so no source gathers in one task.

Null texts have size 0, and so do empty ones. A null source is a source, last in order. A source
of size 0 has target 0. Columns of the input may have any names. Repeated rows are documents of their own. Reruns agree whatever the
partitioning: among rows alike in everything that counts, which is taken changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railloom.llm.common import arrow_schema, whole_text
from railloom.workspace import Workspace

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash ranges of a source, 2 to this power at least, whose sizes are summed before its cut is looked for within one
#: of them; and the documents of a source that a range is to hold at most.
BIN_BITS, BIN_ROWS = 12, 100_000
#: Sources up to which a row for each is broadcast; more meet their documents by a sort-merge join.
BROADCAST_SOURCES = 10_000
#: A source is near enough when this share of its target is missing; further rounds only refine.
NEAR, ROUNDS = 0.002, 6
#: A source that misses its target by more than this share, as one of few documents may, tries other orders.
CLOSE, TRIES = 0.01, 6
_PLACE = "struct<__hash: bigint, __row: bigint>"
_ROUND = f"most: bigint, from_bin: int, after: {_PLACE}, cut_bin: int, last: {_PLACE}"


def word_count(text: str | Column = "text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most_epochs: float) -> list[float]:
    """Targets of all sources: shares of ``total`` by weight, none above ``most_epochs`` times its size."""
    caps = [most_epochs * s for s in sizes]
    targets = [0.0] * len(sizes)
    active = [i for i in range(len(sizes)) if caps[i] > 0]
    left = min(total, math.fsum(caps))
    while active:
        weight = math.fsum(weights[i] for i in active)
        share = {i: left * weights[i] / weight for i in active}
        full = {i for i in active if share[i] >= caps[i]}
        if not full:
            for i in active:
                targets[i] = share[i]
            break
        for i in full:
            targets[i] = caps[i]
        left = max(0.0, left - math.fsum(caps[i] for i in full))
        active = [i for i in active if i not in full]
    return targets


def _mixed(
    docs: DataFrame, workspace: Workspace, weigh: Callable[[int], float], share: float = 1.5, most_epochs: float = 2.0, seed: int = 3,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = (),
) -> DataFrame:
    """__id, size, source_size, target, repeats, taken, and the columns of ``keep`` as __k0, __k1 ..."""
    spark = docs.sparkSession
    sized = docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__source"), word_count(F.col(f"`{text_col}`")).alias("__size"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))).alias("__hash"), *(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)),
    )
    # The row number only tells rows apart that are alike; written, it stays as it is.
    sized = workspace.table(sized.withColumn("__row", F.monotonically_increasing_id()), "sized")

    sources = sized.groupBy("__source").agg(F.sum("__size").alias("size"), F.count("*").alias("n")).collect()
    sources.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    sizes = [r[1] for r in sources]
    bits = max(BIN_BITS, (max((r[2] for r in sources), default=0) // BIN_ROWS).bit_length())
    targets = water_fill(sizes, [weigh(i) for i in range(len(sizes))], share * sum(sizes), most_epochs)
    # Whole repetitions; a sample has to add the words that are then missing.
    whole = [min(int(t // s), int(most_epochs)) if s else 0 for t, s in zip(targets, sizes, strict=True)]
    state_schema = (
        f"__source {sized.schema['__source'].dataType.simpleString()}, source_size long, target double, whole int, goal double, "
        f"try int, one long, rounds array<struct<{_ROUND}>>, now struct<{_ROUND}>"
    )

    def by_source(rows: list[dict], how: str = "inner") -> DataFrame:
        """Documents with what is known of their source; ``rows`` has one per source, no more."""
        right = spark.createDataFrame(pa.Table.from_pylist(rows, arrow_schema(state_schema))).withColumnRenamed("__source", "__s")
        right = F.broadcast(right) if len(rows) <= BROADCAST_SOURCES else right.hint("merge")
        found = sized.join(right, sized["__source"].eqNullSafe(right["__s"]), how).drop("__s")
        # the second try takes large documents first, and those alike in size by their hash
        large = F.greatest(F.lit(0.0), 1 - F.log(F.col("__size") + 1.0) / math.log(2.0**40))
        by_size = F.shiftleft((large * (1 << 30)).cast("long"), 32) + F.pmod("__hash", F.lit(1 << 32))
        order = F.when(F.col("try") == 1, by_size).otherwise(F.xxhash64(F.col("try"), F.col("__hash")))
        return found.withColumn("bin", F.shiftrightunsigned(order, 64 - bits).cast("int")).withColumn("place", F.struct(order.alias("__hash"), F.col("__row")))

    best = [
        {"__source": r[0], "source_size": s, "target": t, "whole": w, "goal": t - w * s, "try": 0, "one": None, "rounds": [], "now": None}
        for r, s, t, w in zip(sources, sizes, targets, whole, strict=True)
    ]
    off = [x["goal"] for x in best]
    for attempt in range(TRIES):
        again = [i for i, x in enumerate(best) if off[i] >= 1 and off[i] > (CLOSE if attempt else NEAR) * x["target"]]
        if not again:
            break
        made = _fill([best[i] | {"try": attempt, "one": None, "rounds": []} for i in again], by_source)
        for i, (x, missing) in zip(again, made, strict=True):
            if missing < off[i]:
                best[i], off[i] = x, missing
    repeats = F.col("whole") + (_sampled() | F.coalesce(F.col("one") == F.col("__row"), F.lit(False))).cast("int")
    return by_source(best, "left").select(
        "__id", F.col("__size").alias("size"), "source_size", "target", repeats.alias("repeats"),
        (F.col("__size") * repeats).alias("taken"), *(f"__k{i}" for i in range(len(keep))),
    )


def mix(
    docs: DataFrame, workspace: Workspace, weigh: Callable[[int], float], share: float = 1.5, most_epochs: float = 2.0, seed: int = 3,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = (),
) -> DataFrame:
    """Decide how often the mix takes each document.

    ``weigh`` gives the weight of the n-th source by code point, null last; ``share`` is the wanted
    size over the size of all documents. Returns one row per input row: ``id_col``, size,
    source_size, target (of its source), repeats, taken (size * repeats) and the columns of ``keep``
    but those by these names.

    The driver holds a row per source. Documents pass it by.
    """
    out = ("size", "source_size", "target", "repeats", "taken")
    keep = [c for c in keep if c not in (id_col, *out)]
    made = _mixed(docs, workspace, weigh, share, most_epochs, seed, id_col, text_col, source_col, keep)
    return made.select(F.col("__id").alias(id_col), *out, *(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)))


def repeated(
    docs: DataFrame, workspace: Workspace, weigh: Callable[[int], float], share: float = 1.5, most_epochs: float = 2.0, seed: int = 3,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns and no others."""
    made = _mixed(docs, workspace, weigh, share, most_epochs, seed, id_col, text_col, source_col, docs.columns)
    made = made.withColumn("__n", F.explode(F.array_repeat(F.lit(1), F.col("repeats"))))
    return made.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(docs.columns)))


def _fill(state: list[dict], by_source: Callable[..., DataFrame]) -> list[tuple[dict, float]]:
    """One try for each source of ``state``: the rounds and the one document more, and the words missing then."""
    state = [x | {"now": {"most": x["source_size"], "from_bin": 0, "after": None, "cut_bin": 0, "last": None}} for x in state]
    gaps = [x["goal"] for x in state]
    for _ in range(ROUNDS):
        open_ = [i for i, x in enumerate(state) if x["now"]["most"] >= 1 and gaps[i] > NEAR * x["target"]]
        if not open_:
            break
        found = {r[0]: r for r in _cuts(by_source([state[i] | {"goal": gaps[i]} for i in open_])).collect()}
        for i in open_:
            x, r = state[i], found.get(state[i]["__source"])
            if r is None:  # nothing is left that fits
                x["now"] = x["now"] | {"most": -1}
                continue
            now = x["now"] | {"cut_bin": r.cut_bin, "last": r.last and r.last.asDict()}
            x["rounds"] = [*x["rounds"], now]
            gaps[i] -= r.got
            after = now["last"] or (now["after"] if r.cut_bin == now["from_bin"] else None)
            x["now"] = {"most": math.floor(gaps[i]), "from_bin": r.cut_bin, "after": after, "cut_bin": 0, "last": None}
    away = F.abs(F.col("goal") - F.col("__size"))
    left = by_source([x | {"goal": gap} for x, gap in zip(state, gaps, strict=True)]).where(~_sampled() & (away < F.col("goal")))
    nearest = left.groupBy("__source").agg(F.min(F.struct(away.alias("away"), "place")).alias("one"))
    ones = {r[0]: r.one for r in nearest.collect()}
    out = []
    for x, gap in zip(state, gaps, strict=True):
        one = ones.get(x["__source"])
        out.append((x | {"one": one.place["__row"]}, one.away) if one else (x, gap))
    return out


def _sampled() -> Column:
    """Whether one of its source's rounds takes a row."""
    def takes(r: Column) -> Column:
        low = (F.col("bin") > r["from_bin"]) | ((F.col("bin") == r["from_bin"]) & (r["after"].isNull() | (F.col("place") > r["after"])))
        high = (F.col("bin") < r["cut_bin"]) | ((F.col("bin") == r["cut_bin"]) & r["last"].isNotNull() & (F.col("place") <= r["last"]))
        return (F.col("__size") <= r["most"]) & low & high

    return F.exists("rounds", takes)


def _cuts(sized: DataFrame) -> DataFrame:
    """Per source, how far its documents fit the goal in hash order: cut_bin, last place within it, words got."""
    now = F.col("now")
    may = sized.where((F.col("__size") <= now["most"]) & ((F.col("bin") > now["from_bin"]) | ((F.col("bin") == now["from_bin"]) & (now["after"].isNull() | (F.col("place") > now["after"])))))
    bins = may.groupBy("__source", "bin").agg(F.sum("__size").alias("n"), F.first("goal").alias("goal"))
    bins = bins.withColumn("before", F.sum("n").over(Window.partitionBy("__source").orderBy("bin")) - F.col("n"))
    over = F.min(F.when(F.col("before") + F.col("n") > F.col("goal"), F.struct("bin", "before")))
    cuts = bins.groupBy("__source").agg(F.coalesce(over, F.struct((F.max("bin") + 1).alias("bin"), F.sum("n").alias("before"))).alias("cut"))
    cuts = cuts.select(F.col("__source").alias("__s"), F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before"))
    # a row per source on the right; within one hash range, a source's documents are few
    at_cut = may.join(F.broadcast(cuts), F.col("__source").eqNullSafe(F.col("__s")) & (F.col("bin") == F.col("cut_bin")))
    upto = F.col("before") + F.sum("__size").over(Window.partitionBy("__source").orderBy("place"))
    fits = at_cut.withColumn("upto", upto).where(F.col("upto") <= F.col("goal")).groupBy(F.col("__source").alias("__f")).agg(F.max("place").alias("last"), F.max("upto").alias("got"))
    return cuts.join(fits, F.col("__s").eqNullSafe(F.col("__f")), "left").select("__s", "cut_bin", "last", F.coalesce("got", "before").alias("got"))
