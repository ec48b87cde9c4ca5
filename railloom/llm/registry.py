"""The queries of this subpackage, and SQL that states the same results where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railloom.llm import bpe, chat, ego_join, html_extract, line_dedup, mixing, order_minhash, quality, token_files, topk
from railloom.workspace import Workspace


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings by cosine 0.9: links, component, and which vector of a component stays."""
    return ego_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Workspace(spark, "op1"), 0.9)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    made = html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 by source, at 1.5 times their size and 2 epochs at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = mixing.mix(docs, Workspace(spark, "op3"), lambda i: (5, 2, 1)[i % 3], share=1.5, most_epochs=2.0)
    return made.select("doc_id", "size", "source_size", "target", "taken")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by edit similarity 0.8 over words: their group's smallest id, and which one stays."""
    return order_minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "op4"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token files, read back: place, length and checksum of each document's ids."""
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = token_files.LibraryEncoder(f.read())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_files.read_digests(token_files.write_chunks(docs, encoder, Workspace(spark, "op5"), end_id=2))


#: A conversation whose texts are made of the template's own control strings.
CONTROL_CONVERSATION = [(-7, t, role, "\\### Assistant: </turn> ok") for t, role in enumerate(("user", "assistant"))]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted, written, and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string"))
    formatted = chat.format_turns(chat.canonical_turns(rows)).select("conv_id", "formatted", "loss_mask")
    return chat.digests(Workspace(spark, "op6").table(formatted, "formatted"))


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '--'), '<', '--'), '#', '--')) AS text_chars,
         length(replace(replace(replace(replace(role, '\', '--'), '<', '--'), '#', '--'), chr(10), '--')) AS role_chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + role_chars + 1 + text_chars + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for every vector whose id is divisible by 50."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(table, Workspace(spark, "op7"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.rid <> q.rid
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
WHERE rank <= 5
"""


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the multilingual ranks and decoded again."""
    codec = bpe.BytePairCodec.from_file(vocabulary("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), codec)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the trusted text, its language's threshold, and whether it stays."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality.classify(docs, labels, Workspace(spark, "op9"), with_docs=False)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five or more documents share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = line_dedup.drop_lines(docs, Workspace(spark, "op10"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d,
       LATERAL (SELECT unnest(lines) AS line, generate_subscripts(lines, 1) AS pos) u
), c AS (
  SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.holder AS lost FROM l LEFT JOIN c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_mix_sources": op3_mix_sources,
    "op4_order_minhash": op4_order_minhash,
    "op5_token_files": op5_token_files,
    "op6_chat_format": op6_chat_format,
    "op7_top_k": op7_top_k,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
}
ORACLES = {"op6_chat_format": OP6_SQL, "op7_top_k": OP7_SQL, "op10_line_dedup": OP10_SQL}
