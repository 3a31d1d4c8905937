"""Exact duplicates by content-defined chunk recipes. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import cut, lower_ascii, spread_join

LEAST, MOST = 512, 4096


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """A chunk ends behind the first full stop or line end after `least` characters, hence where
    its content says; without one, and at the text's end, after at most `most`."""
    return rf"(?s).{{{least},{most}}}?(?<=[.\n])|.{{1,{most}}}"


def _hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, least: int = LEAST, most: int = MOST, hash_chunk: Callable[[Column], Column] = _hash, broadcast_rows: int = 1 << 20) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, text_sha256, n_bytes, recipe: the ordered identifiers
    of the normalised text's chunks, each a hash and a number
    and standing for one chunk content alone.

    Chunks are deduplicated by content (hash and bytes together), each task sending a content at
    most once. A hash that stands for several contents cannot be an identifier: its
    contents are numbered, and the recipes that hold it are written again. (The number is 0 otherwise.) For that only
    chunks with such a hash move, found by a broadcast of these hashes (of their join beyond broadcast_rows of them).
    """
    norm = docs.select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("norm"))
    chunks = F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0))
    digested = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").cast("long").alias("n_bytes"), chunks.alias("chunks"))
    pieces = digested.select(F.explode("chunks").alias("chunk")).select(hash_chunk(F.col("chunk")).alias("h"), "chunk")
    unsure = pieces.distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    plain = digested.select("doc_id", "text_sha256", "n_bytes", F.transform("chunks", lambda c: F.struct(hash_chunk(c).alias("h"), F.lit(0).alias("k"))).alias("recipe"))
    hashes = unsure.count()
    if not hashes:
        return cut(plain)
    plain, unsure = cut(plain), cut(unsure)  # found again, in the rare case that there are any
    some = F.broadcast(unsure) if hashes <= broadcast_rows else unsure
    marked = digested.select("text_sha256", F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", hash_chunk(F.col("chunk")))
    marked = cut(marked.join(some, "h", "left_semi").distinct())
    numbered = marked.select("h", "chunk").distinct().withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    named = marked.join(numbered, ["h", "chunk"]).groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("pos", "k"))).alias("numbers"))
    renamed = F.transform("recipe", lambda x, i: F.struct(x["h"].alias("h"), F.coalesce(F.col("numbers")[i], x["k"]).alias("k")))
    return cut(plain.join(named, "text_sha256", "left").select("doc_id", "text_sha256", "n_bytes", renamed.alias("recipe")))


def exact_duplicates(docs: DataFrame, least: int = LEAST, most: int = MOST, hash_chunk: Callable[[Column], Column] = _hash) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, keep_id, group_size, kept, text_sha256: one row per row
    of docs, dropped ones too.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty.
    Of equal texts the row with the largest doc_id stays. Rows that repeat both id and text
    count in group_size and share the decision. A null doc_id loses to any
    other; groups of only null ids keep all their rows, which nothing tells apart.
    Other columns are ignored; an empty table gives no rows.

    Only recipes are compared and joined, as lists of identifiers; each chunk's bytes
    move once, however long the document is. Rows of large groups are joined by many tasks.
    """
    listed = recipes(docs, least, most, hash_chunk)
    groups = cut(listed.groupBy("n_bytes", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    found = spread_join(listed, groups.withColumn("rows", F.col("group_size")), ["n_bytes", "recipe"], "rows")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
