"""Document fingerprints as Merkle trees over paragraphs and sections. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A leaf is a stretch of a paragraph: 24 to 64 characters up to a space or full stop, else what
#: is left up to 64. Line ends stand for themselves.
LEAF = r"[^\n]{24,64}?[ .]|[^\n]{1,64}|\n+"
#: A section ends behind a paragraph whose digest starts with 0 or 1, or after 64 paragraphs.
SECTION = r"(?:[2-9a-f][0-9a-f]{15},){0,63}[0-9a-f]{16},"


def _digest(x: Column) -> Column:
    return F.substring(F.md5(x), 1, 16)


def leaves(text: Column) -> Column:
    """16 hex digits for each leaf; each line end is a slash, so no two texts share a list."""
    return F.transform(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), lambda x: F.when(x.startswith("\n"), F.repeat(F.lit("/"), F.char_length(x))).otherwise(_digest(x)))


def sections(leaf_list: Column) -> Column:
    """Digests of the sections above the leaves: leaves between line ends make a paragraph's digest,
    runs of paragraphs a section's."""
    paragraphs = F.transform(F.split(F.array_join(leaf_list, ""), "/"), lambda p: F.concat(_digest(p), F.lit(",")))
    return F.transform(F.regexp_extract_all(F.array_join(paragraphs, ""), F.lit(SECTION), F.lit(0)), _digest)


def marks(leaf_list: Column) -> Column:
    """The different leaves of a tree, by the first 8 digits."""
    return F.array_distinct(F.transform(F.filter(leaf_list, lambda x: ~x.startswith("/")), lambda x: F.substring(x, 1, 8)))


def fingerprint(section_list: Column, mark_list: Column) -> Column:
    """root:sections:leaves. The root is a hash over the sections' digests, which stand for everything below (by
    64 bits each), so equal roots mean equal texts; where roots differ, so do the sections and leaves that were edited."""
    joined = F.array_join(section_list, ",")
    return F.concat_ws(":", F.sha2(joined, 256), joined, F.array_join(mark_list, ""))


def likeness(a: Column, b: Column) -> Column:
    """Of two trees' different leaves, the part that both have (Dice); 1 if neither has any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) * F.lit(2.0) / both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with leaves, sections and fingerprint behind its columns; null counts as empty."""
    taken = {"leaves", "sections", "fingerprint"} & set(docs.columns)
    out = docs.drop(*taken).withColumn("leaves", leaves(F.coalesce("text", F.lit("")))).withColumn("sections", sections(F.col("leaves")))
    return out.withColumn("fingerprint", fingerprint(F.col("sections"), marks(F.col("leaves"))))


def changed_sections(before: Column, after: Column) -> Column:
    """Of two lists of sections, the places in the second whose digest the first lacks."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(after), F.lit(1))), lambda i: ~F.coalesce(F.array_contains(before, F.get(after, i - 1)), F.lit(True)))


#: Rows of a bucket, about; quantiles that cut the ids, and buckets in all, at most.
BUCKET_ROWS, MOST_CUTS, MOST_BUCKETS = 256, 2048, 1 << 20
#: An id is hot from this part of all rows on, so there are no more of them than that.
HOT = 1000


def _share(low: Column, high: Column, value: Column) -> Column:
    """How far value lies from low to high, 0 to 1."""
    return F.when(high > low, (value.cast("double") - low) / (high.cast("double") - low)).otherwise(F.lit(0.0))


def with_next(docs: DataFrame, rows_per_bucket: int = BUCKET_ROWS, most_cuts: int = MOST_CUTS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, next_text: the text of the next row by descending doc_id,
    after the last the first. Rows of one id follow one another by their text's hash; nulls come last.

    Rows go by id into ranges cut at quantiles, each divided evenly into buckets of about rows_per_bucket rows (more beyond
    MOST_BUCKETS of these); rows without an id, and those of an id that holds many rows, are divided by hash instead. Each bucket orders
    its own rows. The first row of every bucket also visits the bucket before, where it follows the last. Texts move once. What is
    gathered is a short row a bucket.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    total = docs.select("doc_id").count()
    hot = [r[0] for r in ids.where((F.col("n") > 4 * rows_per_bucket) & (F.col("n") * HOT >= total) & F.col("doc_id").isNotNull()).select("doc_id").collect()] if total > 4 * rows_per_bucket else []
    parts = min(MOST_BUCKETS, max(1, total // rows_per_bucket))
    ranges = min(parts, most_cuts)
    steps = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", steps, max(10_000, 20 * ranges)), F.min("doc_id"), F.max("doc_id")).first() if steps else (None, None, None)
    cuts = sorted({c for c in found[0] or []} | {x for i in hot for x in (max(i - 1, -(1 << 63)), i)})
    fine = max(1, -(-parts // ranges), -(-parts // 8) if hot else 1)  # a hot id's rows are as many buckets as its share may ask for
    ends = F.array(*map(F.lit, [*([found[1]] if cuts else []), *cuts, *([found[2]] if cuts else [])])).cast("array<bigint>")
    number = _bisect(cuts, F.col("doc_id"))
    by_hash = (F.col("h") / float(1 << 64) + 0.5) * fine
    inner = F.when(F.col("doc_id").isin(hot), fine - 1 - F.floor(by_hash)) if hot else F.when(F.lit(False), F.lit(0))
    inner = inner.otherwise(F.floor(_share(F.get(ends, number), F.get(ends, number + 1), F.col("doc_id")) * fine)) if cuts else F.lit(0)
    inner = F.least(F.greatest(inner, F.lit(0)), F.lit(fine - 1))
    bucket = F.when(F.col("doc_id").isNull(), 1 + F.least(F.floor(by_hash), F.lit(fine - 1))).otherwise(-(number * fine + inner)).cast("long")  # ascending as ids descend
    rows = rows.withColumn("bucket", bucket)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.bitwise_not("doc_id").alias("down"), "h"))
    heads = rows.groupBy("bucket").agg(first.alias("first")).select("bucket", F.bitwise_not("first.down").alias("head"), F.col("first.h").alias("head_h"))
    line = Window.orderBy("bucket")  # over one row a bucket
    last = F.max("bucket").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    visits = heads.select("head", "head_h", F.coalesce(F.lag("bucket").over(line), last).alias("visited"))
    rows = rows.join(F.broadcast(visits), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")), "left")  # MOST_BUCKETS short rows at most
    own = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("visit"))
    stop = F.when(F.col("visited").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("visited").alias("at"), F.lit(True).alias("visit"))))
    rows = rows.withColumn("stop", F.explode(stop)).select("doc_id", "text", "h", "stop.at", "stop.visit")
    order = Window.partitionBy("at").orderBy("visit", F.desc_nulls_last("doc_id"), "h")
    return rows.withColumn("next_text", F.lead("text").over(order)).where(~F.col("visit")).select("doc_id", "text", "next_text")


def _bisect(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are below the value: those of a coarse choice, then those between two of it."""
    width = max(1, math.isqrt(len(cuts)))
    coarse = cuts[width - 1 :: width]
    fine = [cuts[k : k + width] for k in range(0, len(cuts), width)] or [[]]
    fine += [[]] * (len(coarse) + 1 - len(fine))

    def longs(values: list[int]) -> Column:
        return F.array(*map(F.lit, values)).cast("array<bigint>")

    place = F.size(F.filter(longs(coarse), lambda s: s < value))
    return place * width + F.size(F.filter(F.get(F.array(*map(longs, fine)), place), lambda s: s < value))


def edit_report(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, changed_sections, n_sections: one row per row of docs.

    changed_sections lists, with commas, the places (from 1) of the edited text's sections that the text's tree lacks, of n_sections in all.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document's. Null counts as empty; an empty text has no leaves and a fingerprint
    of its own. A single row is its own next. Rows that repeat an id follow one another. Other
    columns are ignored; an empty table gives no rows.
    """
    out = with_next(docs.select("doc_id", "text"))
    n, k = F.char_length("text"), F.expr("char_length(text) div 3").cast("int")
    out = out.select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - k), F.left("next_text", k)).alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), leaves(F.col("text")).alias("a"), leaves(F.col("edited")).alias("b"), leaves(F.col("next_text")).alias("c"))
    out = out.select("doc_id", "n_chars", "edited_sha256", sections(F.col("a")).alias("sa"), sections(F.col("b")).alias("sb"), *[marks(F.col(x)).alias(x) for x in "abc"])
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sa"), F.col("a")).alias("fingerprint"), fingerprint(F.col("sb"), F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
        F.array_join(F.transform(changed_sections(F.col("sa"), F.col("sb")), lambda i: i.cast("string")), ",").alias("changed_sections"), F.size("sb").cast("long").alias("n_sections"),
    )


EDIT_REPORT_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC)),
    e AS (SELECT *, length(text) AS n, substring(text, 1, length(text) - length(text) // 3) || substring(next_text, 1, length(text) // 3) AS edited FROM n),
    l AS (
        SELECT doc_id, n, sha256(edited) AS edited_sha256,
            list_transform([text, edited, next_text], lambda t: list_transform(regexp_extract_all(t, '[^\n]{24,64}?[ .]|[^\n]{1,64}|\n+'),
                lambda x: CASE WHEN x[1] = chr(10) THEN repeat('/', length(x)) ELSE substring(md5(x), 1, 16) END)) AS v
        FROM e
    ), s AS (
        SELECT doc_id, n, edited_sha256,
            list_transform(v, lambda t: list_transform(regexp_extract_all(array_to_string(list_transform(string_split(array_to_string(t, ''), '/'),
                lambda p: substring(md5(p), 1, 16) || ','), ''), '(?:[2-9a-f][0-9a-f]{15},){0,63}[0-9a-f]{16},'), lambda x: substring(md5(x), 1, 16))) AS s,
            list_transform(v, lambda t: list_transform(list_filter(t, lambda x: x[1] <> '/'), lambda x: substring(x, 1, 8))) AS m
        FROM l
    ), u AS (
        SELECT *, list_transform(m, lambda t: list_filter(t, lambda x, i: list_position(t, x) = i)) AS m1 FROM s
    ), f AS (
        SELECT *, list_transform([1, 2], lambda i: sha256(array_to_string(s[i], ',')) || ':' || array_to_string(s[i], ',') || ':' || array_to_string(m1[i], '')) AS f FROM u
    )
    SELECT doc_id, n AS n_chars, edited_sha256, f[1] AS fingerprint, f[2] AS edited_fingerprint,
        CASE WHEN len(m1[1]) + len(m1[2]) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(m1[1], m1[2])) * 2.0::DOUBLE / (len(m1[1]) + len(m1[2])) END AS near_edited,
        CASE WHEN len(m1[1]) + len(m1[3]) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(m1[1], m1[3])) * 2.0::DOUBLE / (len(m1[1]) + len(m1[3])) END AS near_next,
        array_to_string(list_filter(range(1, len(s[2]) + 1), lambda i: NOT list_contains(s[1], s[2][i])), ',') AS changed_sections, len(s[2]) AS n_sections
    FROM f
"""
