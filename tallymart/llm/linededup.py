"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

Lines that aren't blank are hashed (two 64-bit hashes). Of every ``window`` consecutive lines, the one with the
smallest hash is a fingerprint; two documents that share a run of at least that many lines choose the same fingerprint
in it. Only fingerprints that occur more than once are looked at further: their positions are extended both ways, to
all runs of ``window`` lines that chose them, and a run that also occurs earlier is deleted. Overlapping deleted runs
join up, so that a longer repeat is deleted from its first to its last line.

Earlier means a smaller doc_id, or the same document and an earlier line. Runs are judged on the input, not on what is
left. So a line is deleted if and only if it lies in ``window`` consecutive lines that start earlier elsewhere; blank
lines don't count and stay. Documents of fewer lines lose none. Rows with equal doc_id and text count as one document
and get the same result; null text stays null, empty text empty. Null ids come last.

With ``passage``, runs of fewer lines than the window that together hold more words than that are deleted by the same rule:
short lines still need a window, long ones don't. The query op1 has none, as its SQL; the pipeline's stage takes 50.

No step needs the rows of one line or run together: first positions are minima, combined before the shuffle and written, so that
the join that brings them back is one of two tables, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table, word_count, written

WINDOW, PASSAGE = 3, 50
NO_INTS = "array<int>"


def line_array(text: Column) -> Column:
    return F.split(text, "\n")


def filled(text: Column, counted: bool = False) -> Column:
    """Positions (from 0) and hashes of the lines that aren't blank, and the number of their words where asked for."""
    lines = F.transform(line_array(text), lambda x, i: F.struct(i.alias("line"), F.trim(x).alias("s")))
    lines = F.filter(lines, lambda x: x["s"] != "")
    more = lambda x: [word_count(x["s"]).cast("int").alias("n")] if counted else []
    return F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["s"]).alias("h"), F.xxhash64(F.lit(1), x["s"]).alias("g"), *more(x)))


def windows_of(n: Column, window: int) -> Column:
    return F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast(NO_INTS))


def chosen(hs: Column, start: Column, window: int) -> Column:
    """The smallest hash of the window of lines that begins there."""
    return F.array_min(F.slice(hs, start + 1, window))


def long_runs(window: int, passage: int) -> Column:
    """Of rows with n, the words of each line: start and length of the runs of fewer than window lines with more than passage words."""
    words = lambda i, k: sum((F.get("n", i + j) for j in range(1, k)), F.get("n", i))
    at = lambda k: F.filter(windows_of(F.size("n"), k), lambda i: words(i, k) > passage)
    one = lambda k: lambda i: F.named_struct(F.lit("start"), i, F.lit("k"), F.lit(k))
    return F.concat(*[F.transform(at(k), one(k)) for k in range(1, window)])


def repeated_lines(docs: DataFrame, window: int = WINDOW, passage: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, tkey, gone): positions of the lines to delete, for documents that have any."""
    parts = let(filled(F.col("text"), passage is not None), lambda f: F.struct(*[f[x].alias(x) for x in ("line", "h", "g", *(() if passage is None else "n"))]))
    rows = docs.select("doc_id", F.xxhash64("text").alias("tkey"), parts.alias("f")).select("doc_id", "tkey", "f.*")
    some = F.size("h") >= window
    if passage is not None:
        rows = rows.withColumn("long", long_runs(window, passage)).drop("n")
        some = some | (F.size("long") > 0)
    rows = written(rows.filter(some).dropDuplicates(["doc_id", "tkey"]))
    hs = F.col("h")
    starts = windows_of(F.size("h"), window)

    # The outer forms: for the inner ones Spark adds a filter that computes the whole array once more. The joins drop the nulls.
    marks = rows.select("doc_id", "tkey", F.explode_outer(F.array_distinct(F.transform(starts, lambda i: chosen(hs, i, window)))).alias("mark"))
    # A mark repeats if two documents have it, or one has it at two places.
    places = rows.select(F.explode("h").alias("mark"))
    # Written, like first below: adaptive execution splits a hot key only where neither side of the join is an aggregate on it.
    often = written(marks.select("mark").distinct().join(places.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1"), "mark").select("mark"))
    hot = marks.join(often, "mark").groupBy("doc_id", "tkey").agg(F.collect_set("mark").alias("marks"))
    hot = hot.withColumnsRenamed({"doc_id": "_id", "tkey": "_key"})

    near = rows.join(hot, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_key")))
    at = F.filter(starts, lambda i: F.array_contains("marks", chosen(hs, i, window)))
    one = lambda i, k=window: F.struct(
        i.alias("start"),
        F.xxhash64(F.slice("h", i + 1, k)).alias("k1"),
        F.xxhash64(F.slice("g", i + 1, k)).alias("k2"),
        F.slice("line", i + 1, k).alias("lines"),
    )
    runs = near.select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey", F.inline_outer(F.transform(at, lambda i: one(i))))
    if passage is not None:
        each = F.transform("long", lambda r: one(r["start"], r["k"]))
        runs = runs.unionByName(rows.select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey", F.inline_outer(each)))
    runs = written(runs.filter("k1 IS NOT NULL"))
    here = F.struct("no_id", "doc_id", "tkey", "start")
    first = written(runs.groupBy("k1", "k2").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = runs.join(first, ["k1", "k2"]).filter(here != F.col("first"))
    return later.groupBy("doc_id", "tkey").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, passage: int | None = None) -> DataFrame:
    """docs with text less its repeated runs of lines; also _tm_lines and _tm_gone, the number of lines and of those deleted."""
    gone = repeated_lines(docs.select("doc_id", "text"), window, passage).withColumnsRenamed({"doc_id": "_tm_id", "tkey": "_tm_key", "gone": "_tm_at"})
    lines = line_array(F.col("text"))
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_tm_at"))
    left = let(lines, lambda ls: F.array_join(F.transform(keep, lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.col("_tm_at").isNull(), F.col("text")).otherwise(left)
    out = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_tm_id")) & (F.xxhash64(docs["text"]) == F.col("_tm_key")), "left")
    return out.select(
        *[text.alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).alias("_tm_lines"),
        F.coalesce(F.size("_tm_at"), F.lit(0)).alias("_tm_gone"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("_tm_lines")).cast("long").alias("n_lines"),
        F.when(F.col("_tm_gone") < 0, 0).otherwise(F.col("_tm_gone")).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
f AS (SELECT doc_id, pos, trim(line) AS s FROM l WHERE trim(line) <> ''),
w AS (SELECT doc_id, pos, s AS s1, lead(s, 1) OVER p AS s2, lead(s, 2) OVER p AS s3, lead(pos, 1) OVER p AS pos2, lead(pos, 2) OVER p AS pos3
      FROM f WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, row_number() OVER (PARTITION BY s1, s2, s3 ORDER BY doc_id, pos) AS seen FROM w WHERE s3 IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([pos, pos2, pos3]) AS pos FROM r WHERE seen > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""
