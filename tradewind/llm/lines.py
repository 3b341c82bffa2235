"""Line deduplication by content-defined chunks of lines, in column expressions only.

A hash that rolls over the hashes of each two neighbouring lines chooses the chunks: a chunk ends between two lines whose rolling hash
the corpus has only once. Chunks are thus the longest runs of lines that may repeat, at any place in a text and of two lines or
more; inserting a line moves the ends next to it and no others. Then the bytes of the chunks are compared, pair of neighbouring
lines by pair: a pair stays at its first place, by (doc_id, text hash, position), and the lines of its later places are removed.
So of a passage of two or more lines that several documents hold every line goes but at one place, also where passages overlap or
their ends differ. Pairs are judged on the input, not on what is left; the first place of a line is never removed, so no line is lost.
Pairs under `LEAST_CHARS` characters (blank lines, brackets) are no passage and stay.

Only hashes and places are moved for all lines; bytes are compared for the lines in chunks. A pair's places are summed before they are
shuffled, so a pair that a third of all documents share is one row per task; joins are on plain keys, which adaptive execution
splits where they are skewed.

Edge cases: a null text has no lines and stays null; an empty text is one empty line; a text of one line is never removed;
rows that repeat both doc_id and text are one document and get the same result; a null doc_id comes after all others. Other
columns pass through `drop_repeated_lines` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import free_name, stored

LEAST_CHARS = 20  # characters of two neighbouring lines that may be removed


def lines_of(text: str | Column) -> Column:
    return F.split(text, "\n", -1)


def rolling_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, seq, hash: the hash that rolls over lines seq and seq + 1 of a text, where these are long enough."""
    rows = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), lines_of("text").alias("lines"))
    each = F.transform("lines", lambda line: F.struct(F.xxhash64(line).alias("hash"), F.length(line).alias("chars")))
    rows = rows.select("doc_id", "text_hash", each.alias("each"))

    def roll(a: Column, b: Column) -> Column:
        return F.when(a["chars"] + b["chars"] >= LEAST_CHARS, F.xxhash64(a["hash"], b["hash"]))

    n = F.size("each") - 1
    rolled = F.zip_with(F.slice("each", F.lit(1), n), F.slice("each", F.lit(2), n), roll)
    return rows.select("doc_id", "text_hash", F.posexplode(rolled).alias("seq", "hash")).filter("hash IS NOT NULL")


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the places of the pairs of lines whose rolling hash occurs again: runs of places are the chunks."""
    rows = rolling_hashes(docs)
    often = stored(rows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "lines-often")
    inside = rows.join(often, "hash", "left_semi")
    return stored(inside.groupBy("doc_id", "text_hash").agg(F.collect_set("seq").alias("places")), "lines-chunks")


def with_key(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """`docs` joined with `found` (doc id, text hash, ...), by the same plan at every size: `found` grows with the documents."""
    doc, same = found.columns[:2]
    on = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(same))
    return docs.join(found.hint("merge"), on, how)


def place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "seq")


def repeated_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the places of the pairs of lines that have an earlier place, after comparing their bytes."""
    found = chunks(docs).toDF("_doc", "text_hash", "places")
    rows = with_key(docs.select("doc_id", "text"), found, "inner")
    rows = rows.select("doc_id", "text_hash", "places", lines_of("text").alias("lines"))
    pairs = F.transform(
        "places", lambda i: F.struct(i.alias("seq"), F.concat_ws("\n", F.get("lines", i), F.get("lines", i + 1)).alias("pair"))
    )
    rows = rows.select("doc_id", "text_hash", F.explode(pairs).alias("at")).select("doc_id", "text_hash", "at.*")
    rows = stored(rows, "lines-pairs")
    # Grouping by the pair itself compares bytes.
    first = rows.groupBy("pair").agg(F.min(place()).alias("first"), F.max(place()).alias("last"))
    first = stored(first.filter(F.col("first") != F.col("last")).drop("last"), "lines-first")
    later = rows.join(first, "pair").filter(place() != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("seq").alias("places"))


def drop_repeated_lines(docs: DataFrame, name: str = "removed_lines") -> DataFrame:
    """`docs` with shortened texts, and the number of removed lines as column `name`."""
    if name in docs.columns:
        raise ValueError(f"the input already has a column {name}")
    doc, same, places, gone, lines = (free_name(docs, c) for c in ("_doc", "_hash", "_places", "_gone", "_lines"))
    removed = stored(repeated_pairs(docs.select("doc_id", "text")), "lines-removed")
    both = F.array_distinct(F.concat("places", F.transform("places", lambda i: i + 1)))
    rows = with_key(docs, removed.select("doc_id", "text_hash", both.alias("gone")).toDF(doc, same, gone), "left")
    rows = rows.withColumn(lines, F.when(F.col(gone).isNotNull(), lines_of("text")))
    rows = rows.withColumn(places, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)))
    kept = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    changed = {
        "text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept),
        name: F.coalesce(F.size(gone), F.lit(0)).cast("long"),
    }
    return rows.withColumns(changed).select(*docs.columns, name)
