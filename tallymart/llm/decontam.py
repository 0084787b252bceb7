"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is 13 consecutive words of a benchmark item (a shorter item is one window). Of each ``w`` consecutive 5-word grams of
a document, winnowing keeps the smallest hash; w is so small that the shortest window of five words or more holds w grams, so
that all windows share one pass. The smallest gram of a window's own grams is then surely among those kept wherever
the window occurs: documents without such a mark are clean for certain. Windows of one to four words are a gram of their
own. Neighbouring places with one smallest hash are a run (mark, first place, last place); of the runs whose mark the benchmark
has, the windows around are compared as text, both ways, with the benchmark's. Only whole equal windows count as hits.

Words are runs of letters, digits and signs beyond ASCII; A to Z are lower-cased. A row is known by its doc_id and a
hash of its text, so that repeated ids do no harm: equal rows get equal results. Null and empty texts have no words;
null and wordless items are no windows; empty tables give no hits. Items of equal text are compared once, and so are
equal windows of several items: a passage that thousands of items share is one row a place. A document
has at most as many windows as words and lengths of windows, and they are put together per document, not per window or item.
Tables of marks, hit documents and windows are written, so that Spark broadcasts them where they are small and splits hot keys
where they aren't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, table, written

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # between words, before lower-casing or after
SPAN, GRAM = 13, 5


def words(text: Column) -> Column:
    """Splitting at the gaps takes a third of the time of matching the words."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), GAP), ""), F.array().cast("array<string>"))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def gram_hashes(ws: Column, gram: int) -> Column:
    """The hash of the gram at each place; null beyond the last place is never read."""
    at = lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(gram)])
    return F.when(F.size(ws) >= gram, F.transform(F.sequence(F.lit(0), F.size(ws) - gram), at)).otherwise(F.array().cast("array<bigint>"))


def windows_least(hashes: Column, window: int) -> Column:
    """The smallest hash of each window of grams. Fewer grams than a window give none."""
    if window == 1:
        return hashes
    n = F.size(hashes) - window + 1
    least = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_min(F.slice(hashes, i, window)))
    return F.when(n >= 1, least).otherwise(F.array().cast("array<bigint>"))


def runs_of(least: Column) -> Column:
    """(mark, lo, hi) of the runs of neighbouring places with one value."""
    new = lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
    one = lambda m, at: F.transform(at, lambda i, k: F.struct(F.get(m, i).alias("mark"), i.alias("lo"), (F.coalesce(F.get(at, k + 1), F.size(m)) - 1).alias("hi")))
    runs = let(least, lambda m: let(new(m), lambda at: one(m, at)))
    return F.when(F.size(least) >= 1, runs)


def doc_runs(ws: Column, lengths: list[int], gram: int = GRAM) -> Column:
    """The runs that windows of these lengths need, with the gram of each: one array, from one pass over the words."""
    none = F.array().cast("array<struct<mark:bigint,lo:int,hi:int>>")

    def of_gram(g: int) -> Column:
        window = min(n for n in lengths if min(n, gram) == g) - g + 1
        runs = let(let(ws, lambda w: gram_hashes(w, g)), lambda h: let(windows_least(h, window), runs_of))
        return F.transform(F.coalesce(runs, none), lambda r: F.struct(F.lit(g).alias("gram"), r["mark"].alias("mark"), r["lo"].alias("lo"), r["hi"].alias("hi")))

    return F.concat(*[of_gram(g) for g in sorted({min(n, gram) for n in lengths})])


def item_windows(items: DataFrame, span: int = SPAN) -> DataFrame:
    """items(item_id, text) -> distinct (item_text, n, span, skey): windows of each distinct item text, their lengths and names."""
    ws = items.select(words(F.col("text")).alias("ws")).filter(F.size("ws") > 0).distinct()
    n = F.least(F.size("ws"), F.lit(span))
    starts = F.sequence(F.lit(0), F.size("ws") - n)
    one = ws.select(
        F.sha2(F.array_join("ws", " "), 256).alias("item_text"),
        n.alias("n"),
        F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(F.col("ws"), i + 1, n), " ")))).alias("span"),
    )
    return one.withColumn("skey", F.md5("span"))


def item_texts(items: DataFrame) -> DataFrame:
    """The distinct word sequences of items, by digest, with the ids of the items that have it."""
    ws = items.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    return ws.select(F.sha2(F.array_join("ws", " "), 256).alias("item_text"), F.col("item_id").cast("string").alias("item_id"))


def overlaps(docs: DataFrame, windows: DataFrame, gram: int = GRAM) -> DataFrame:
    """(doc_id, tkey, start, n, skey): each place where a window (of item_windows) occurs in a document. docs(doc_id, text)."""
    spans = written(windows.select("n", "span", "skey").distinct())
    lengths = sorted(r.n for r in spans.select("n").distinct().collect())  # 13 numbers at most
    source = docs.select("doc_id", "text", text_key(F.col("text")).alias("tkey"))
    if not lengths:
        return source.select("doc_id", "tkey", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("skey")).limit(0)
    mark = F.lit(None).cast("long")
    for g in range(gram, 0, -1):
        mark = F.when(F.least("n", F.lit(gram)) == g, F.array_min(gram_hashes(F.split("span", " "), g))).otherwise(mark)
    marks = written(spans.select(F.least("n", F.lit(gram)).alias("gram"), mark.alias("mark")).distinct())

    # The outer forms: for the inner ones Spark adds a filter that computes the whole array once more. The joins drop the nulls.
    seen = source.select("doc_id", "tkey", F.inline_outer(let(words(F.col("text")), lambda ws: doc_runs(ws, lengths, gram))))
    hits = seen.join(marks, ["gram", "mark"]).groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("gram", "lo", "hi")).alias("runs"))
    hits = written(hits.withColumnsRenamed({"doc_id": "_id", "tkey": "_key"}))

    # Extension: the starts of all windows around the runs. The texts are read again, of the documents hit.
    again = source.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_key")))

    def around(ws: Column, n: int) -> Column:
        g = min(n, gram)
        least = min(x for x in lengths if min(x, gram) == g)
        mine = F.filter("runs", lambda r: r["gram"] == g)
        starts = F.transform(mine, lambda r: let(F.struct(F.greatest(r["lo"] - (n - least), F.lit(0)).alias("a"), F.least(r["hi"], F.size(ws) - n).alias("b")), lambda e: F.when(e["a"] <= e["b"], F.sequence(e["a"], e["b"])).otherwise(F.array().cast("array<int>"))))
        return F.transform(F.array_distinct(F.flatten(starts)), lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice(ws, i + 1, n), " ").alias("span")))

    places = again.select("doc_id", "tkey", F.inline_outer(let(words(F.col("text")), lambda ws: F.concat(*[around(ws, n) for n in lengths]))))
    return places.join(spans, ["n", "span"]).select("doc_id", "tkey", "start", "n", "skey")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per row of docs: doc_id, tkey, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = written(item_windows(items, span))
    found = written(overlaps(docs, windows, gram).distinct())
    pieces = found.select("doc_id", "tkey", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    covered = pieces.groupBy("doc_id", "tkey").agg(
        F.aggregate(  # the length of the union of a document's pieces
            F.array_sort(F.collect_list(F.struct("start", "end"))),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, x: F.struct(
                (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")
            ),
        )["n"].cast("long").alias("n_hit")
    )
    sets = found.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("skey")).alias("spans")).withColumn("set_key", F.sha2(F.array_join("spans", ","), 256))
    sets = written(sets)
    each = sets.select("set_key", "spans").dropDuplicates(["set_key"]).select("set_key", F.explode("spans").alias("skey"))
    each = each.join(windows.select("skey", "item_text"), "skey").select("set_key", "item_text").distinct()
    listed = (
        each.join(item_texts(items), "item_text").groupBy("set_key")
        .agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
        .select("set_key", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    )
    hits = covered.withColumnsRenamed({"doc_id": "_id", "tkey": "_key"}).join(
        sets.join(listed, "set_key").select("doc_id", "tkey", "n_items", "items_sha256"),
        F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("tkey")),
    ).select("_id", "_key", "n_hit", "n_items", "items_sha256")
    base = docs.select(
        "doc_id", text_key(F.col("text")).alias("tkey"), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), GAP), "")).cast("long").alias("n_words")
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_key")), "left").select(
        "doc_id",
        "tkey",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs less the contaminated ones."""
    bad = written(contamination(docs.select("doc_id", "text"), items).filter("contaminated").select(F.col("doc_id").alias("_tm_id"), F.col("tkey").alias("_tm_key")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_tm_id")) & (text_key(docs["text"]) == F.col("_tm_key")), "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tkey")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
i AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS span
       FROM (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS s FROM i WHERE len(ws) > 0)),
dw AS (SELECT r, s, n, array_to_string(ws[s:s + n - 1], ' ') AS span
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hit AS (SELECT r, s, dw.n, item_id FROM dw JOIN iw USING (span)),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS w FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r),
k AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
      FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN k USING (r)
"""
