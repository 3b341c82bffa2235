"""One registered query for each operator, with production settings, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import audit, bpe, chat, chunks, leaks, lines, near, nearest, pieces, quality, repeats, search, shards
from tradewind.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 40
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted turn by turn, and one more whose texts look like marks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema)
    template = chat.MarkedTurns()
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(more), template), template)


def op2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunks that an earlier place in the corpus has."""
    return chunks.dedupe_chunks(table(spark, sf_dir, "documents"), keep_text=False)


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law `rows`: shard sizes differ by one row at most."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = shards.feistel_shards(rows, SHARDS, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that an earlier place in the corpus has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.drop_repeated_lines(docs.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long")))
    sha = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return kept.select(
        "doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.col("removed_lines").alias("n_removed"), sha.alias("kept_sha256")
    )


OP4_SQL = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
each AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM split),
pair AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS body FROM each),
placed AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k FROM pair WHERE length(body) > {lines.LEAST_CHARS}
),
gone AS (SELECT doc_id, i FROM placed WHERE k > 1 UNION SELECT doc_id, i + 1 FROM placed WHERE k > 1),
marked AS (SELECT e.doc_id, e.line, e.i, g.i IS NOT NULL AS gone FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i),
done AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""


def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the edits between them."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the class of near duplicates that it belongs to."""
    return near.class_ids(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that a string of 200 bytes covers which starts anywhere else too."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by a model that never saw the held-out fifth's labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by the multi-language ranks, decoded again."""
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=False)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = f"""
WITH term AS (
  SELECT doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)
),
item AS (
  SELECT item_id, t, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark)
  GROUP BY item_id, t
),
total AS (SELECT count(DISTINCT row) AS n_docs, count(*) AS n_terms FROM term),
long AS (
  SELECT row, 75 + CAST(25 * count(*) * max(n_docs) // max(n_terms) AS BIGINT) AS m FROM term CROSS JOIN total GROUP BY row
),
tf AS (SELECT row, doc_id, t, count(*) AS tf FROM term WHERE t IN (SELECT t FROM item) GROUP BY row, doc_id, t),
weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf CROSS JOIN total GROUP BY t
),
scored AS (
  SELECT item_id, row, tf.doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM tf JOIN long USING (row) JOIN weight USING (t) JOIN item USING (t)
  GROUP BY item_id, row, tf.doc_id
),
ranked AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {search.TOP}
"""


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, for every language, order and step."""
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Failures are judged per document, and every order is walked over all documents with one failure pattern.
OP12_SQL = f"""
WITH text AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
),
judged AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < {audit.MIN_WORDS} THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < {audit.MIN_DISTINCT_PERCENT} * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {audit.MAX_CAPITAL_PERCENT} * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '{audit.ODD_CHARACTERS}') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM text
),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
pattern AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, fails
),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
walked AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails,
    contains(fails, f) AS own, translate(fails, before, '') <> fails AS earlier
  FROM pattern CROSS JOIN steps
),
counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT own AND NOT earlier THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN own AND earlier THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN own AND NOT earlier THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN own AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM walked GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids with the end id, decoded again."""
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), keep_ids=False)


OPERATORS = (
    op1_chat,
    op2_chunks,
    op3_shards,
    op4_lines,
    op5_leaks,
    op6_nearest,
    op7_near,
    op8_repeats,
    op9_quality,
    op10_byte_bpe,
    op11_search,
    op12_audit,
    op13_pieces,
)


def all_queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


def all_statements() -> dict[str, str]:
    """DuckDB statements of those queries that SQL can express on whole tables."""
    return {"op4_lines": OP4_SQL, "op11_search": OP11_SQL, "op12_audit": OP12_SQL}
