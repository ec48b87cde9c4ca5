"""Line dedup across documents, in DataFrame functions alone.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. Of a key of at
least ``min_chars`` code points that stands in at least ``min_docs`` documents, all lines go but
those in the largest document id. What is returned is not text but, for each document that loses
lines, which of its lines stay, as run lengths.

Hashes of keys are dealt out by range and sorted by document and position within them, so the
first occurrence of each hash and the number of its documents come out of one pass over the sorted
run. A hash so common that it would weigh on one range is found in a sample of the lines
beforehand; its documents are counted with map-side combining and its holder is broadcast. The
sample only chooses the way: either way counts every line.

Null and empty texts are one empty line. Repeated rows of one document id are one document; a null
id is a document below all others. An empty table gives no rows. Columns of the input may have any
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railloom.llm.common import ASCII_SPACE, whole_text
from railloom.workspace import Workspace

MIN_CHARS, MIN_DOCS = 40, 5
#: One line in so many is looked at for common hashes.
SAMPLE_ONE_IN = 64
#: A hash with more than this share of a range's sampled lines is common; at most ranges / share are.
COMMON_SHARE = 0.25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The key that lines are compared by."""
    bare = F.btrim(line, F.lit(ASCII_SPACE))
    # lower() also folds letters beyond ASCII; where there are none it is the quicker way
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each line long enough: doc_id, text_hash, pos, and two hashes of the key."""
    lines = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("text_hash"),
        F.posexplode(split_lines(whole_text(text_col))).alias("pos", "line"),
    ).where(F.char_length("line") >= min_chars)
    keys = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    # 96 bits: two different keys meet in neither table of any size
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


def lost_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """The rows of ``lines``, a written table, that go."""
    spark = lines.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    looked_at = lines.where(F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SAMPLE_ONE_IN)) == 0)
    counts = looked_at.groupBy("h1", "h2").count()
    limit = max(8.0, COMMON_SHARE * looked_at.count() / ranges)
    common = counts.where(F.col("count") > limit).select("h1", "h2")  # fewer than ranges / share rows

    # Common hashes: partial counts and the largest id meet, not the lines.
    of_common = lines.join(F.broadcast(common), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "doc_id").count()
    order = F.struct("doc_id")  # as a struct, a null id counts and comes first
    holders = of_common.groupBy("h1", "h2").agg(F.max(order).alias("holder"), F.count("*").alias("n_docs"))
    hot = lines.join(F.broadcast(holders), ["h1", "h2"])
    hot_lost = hot.where((F.col("n_docs") >= min_docs) & (order != F.col("holder")))

    rest = lines.join(F.broadcast(common), ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2")
    run = Window.partitionBy("h1", "h2")
    nth = F.dense_rank().over(run.orderBy(F.col("doc_id").desc_nulls_last()))
    ranked = rest.withColumn("nth", nth).withColumn("n_docs", F.max("nth").over(run))
    cold_lost = ranked.where((F.col("n_docs") >= min_docs) & (F.col("nth") > 1))
    return hot_lost.select("doc_id", "text_hash", "pos").unionByName(cold_lost.select("doc_id", "text_hash", "pos"))


def _run_lengths(n_lines: Column, lost: Column) -> tuple[Column, Column]:
    """Lengths of the runs of kept lines, and of the lost ones that follow each, from sorted lost positions.

    Every array is an argument of a function over arrays, never looked up in from within one, so the
    work is in proportion to the lines.
    """
    rest = F.greatest(F.size(lost) - 1, F.lit(0))
    before = F.concat(F.array(F.lit(-2)), F.slice(lost, F.lit(1), rest))
    after = F.concat(F.slice(lost, F.lit(2), rest), F.array(F.lit(-2)))
    some = lambda x: F.filter(x, lambda y: y.isNotNull())
    begins = some(F.zip_with(lost, F.slice(before, F.lit(1), F.size(lost)), lambda x, p: F.when(x != p + 1, x)))
    ends = some(F.zip_with(lost, F.slice(after, F.lit(1), F.size(lost)), lambda x, q: F.when(q != x + 1, x + 1)))
    kept = F.zip_with(F.concat(begins, F.array(n_lines)), F.concat(F.array(F.lit(0)), ends), lambda b, e: b - e)
    return kept, F.concat(F.zip_with(ends, begins, lambda e, b: e - b), F.array(F.lit(0)))


def keep_runs(n_lines: Column, lost: Column) -> Column:
    """Run lengths of lines kept, lost, kept ... from the sorted positions that are lost."""
    kept, gone = _run_lengths(n_lines, lost)
    runs = F.flatten(F.zip_with(kept, gone, lambda k, g: F.array(k, g)))
    return F.slice(runs, F.lit(1), F.size(runs) - 1)


def _kept_lines(text: Column, n_lines: Column, lost: Column) -> Column:
    """The lines that stay, joined again."""
    kept, gone = _run_lengths(n_lines, lost)
    stays = F.flatten(F.zip_with(kept, gone, lambda k, g: F.concat(F.array_repeat(F.lit(True), k), F.array_repeat(F.lit(False), g))))
    lines = F.zip_with(split_lines(text), stays, lambda line, stay: F.when(stay, line))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def keep_bitmaps(docs: DataFrame, workspace: Workspace, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that loses lines: doc_id, text_hash and lost, the sorted positions that go.

    The text hash tells rows of one id apart. ``keep_runs`` turns positions into the run lengths
    of a keep bitmap.
    """
    lines = workspace.table(hashed_lines(docs, min_chars, id_col, text_col), "lines")
    return lost_lines(lines, min_docs).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("lost"))


def _without(docs: DataFrame, workspace: Workspace, min_chars: int, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``docs`` as __c0, __c1 ..., with __kept (the text that stays), __n and __lost."""
    named = docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)))
    own_id, own_text = (f"__c{docs.columns.index(c)}" for c in (id_col, text_col))
    maps = keep_bitmaps(named, workspace, min_chars, min_docs, own_id, own_text)
    maps = maps.select(F.struct(F.col("doc_id")).alias("__id"), F.col("text_hash").alias("__hash"), F.col("lost").alias("__lost"))
    text = whole_text(own_text)
    keyed = named.withColumn("__id", F.struct(F.col(own_id).alias("doc_id"))).withColumn("__hash", F.xxhash64(text))
    joined = keyed.join(maps, ["__id", "__hash"], "left")
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    joined = joined.withColumns({"__n": n_lines, "__lost": F.coalesce(F.col("__lost"), F.array().cast("array<int>"))})
    return joined.withColumn("__kept", F.when(F.size("__lost") == 0, text).otherwise(_kept_lines(text, F.col("__n"), F.col("__lost"))))


def drop_lines(docs: DataFrame, workspace: Workspace, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that stays, and the columns n_lines, n_dropped and keep_runs, which replace any by these names.

    A null text becomes the empty one.
    """
    made = _without(docs, workspace, min_chars, min_docs, id_col, text_col)
    out = {"n_lines": F.col("__n").cast("long"), "n_dropped": F.size("__lost").cast("long"), "keep_runs": keep_runs(F.col("__n"), F.col("__lost"))}
    own = [F.col("__kept" if c == text_col else f"__c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in out]
    return made.select(*own, *(x.alias(c) for c, x in out.items()))


def without_shared_lines(docs: DataFrame, workspace: Workspace, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that stays, all other columns as they are."""
    made = _without(docs, workspace, min_chars, min_docs, id_col, text_col)
    return made.select(*(F.col("__kept" if c == text_col else f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))
