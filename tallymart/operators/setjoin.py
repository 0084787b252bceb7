"""Names that are alike, without meeting all names that share a word: a prefix-filtered set-similarity join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_score, percentage, set_score, text_key, tokens
from ..registry import query
from ..sources.market import PRODUCTS, products
from ..sources.scratch import written
from .joins import tiles


def thousandths(score: Column) -> Column:
    return F.floor(score * 1000 + 1e-6)


def least_overlap(n: Column, k: Column, at_least: int) -> Column:
    """Words that names of n and k words must share to score at_least thousandths, their letters being as alike as can be; null if
    not even all words of the shorter would do."""
    enough = lambda o: thousandths(0.5 * o / (n + k - o) + 0.25 * o / F.least(n, k) + 0.25) >= at_least
    return F.get(F.filter(F.sequence(F.lit(1), F.least(n, k)), enough), F.lit(0))


def rare_first(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of distinct key -> key, toks: its distinct words, those that fewest keys have first, ties by word. Both sides
    have one order. The counts are a written table, so that a word of very many keys is split where it meets them."""
    worded = [side.select("key", F.explode(tokens(F.col("key"))).alias("tok")) for side in (left, right)]
    n_keys = written(worded[0].unionByName(worded[1]).groupBy("tok").agg(F.count("*").alias("n_keys")))
    order = F.transform(F.array_sort(F.collect_list(F.struct("n_keys", "tok"))), lambda x: x["tok"])
    a, b = (written(w.join(n_keys, "tok").groupBy("key").agg(order.alias("toks"))) for w in worded)
    return a, b


def prefixes(sets: DataFrame, others: DataFrame, own: str, other: str, at_least: int) -> DataFrame:
    """key, toks -> a row for each size that names of the other side have and each group of words that a name of that size must meet
    one of: of n words of which o must be shared, the first n - o + g in rare-first order hold the first g shared ones.

    g is up to three, as long as the longer name has at most ``GROUPS`` such groups. A group is rarer than its words, so that names
    which share fewer words than they must seldom meet. Columns: tok (the group's words), the two sizes, need (o), g, key, toks, left
    (words after the group). The sizes of the other side are one row: as many numbers as names differ in length.
    """
    sizes = others.agg(F.collect_set(F.size("toks")).alias("_sizes"))
    n, k = F.size("toks"), F.col(other)
    rows = sets.join(F.broadcast(sizes)).withColumn(other, F.explode("_sizes")).withColumn("need", least_overlap(n, k, at_least)).filter("need IS NOT NULL")
    spare = F.greatest(n, k) - F.col("need")
    g = F.when((F.col("need") >= 3) & ((spare + 3) * (spare + 2) * (spare + 1) <= 6 * GROUPS), 3).when((F.col("need") >= 2) & ((spare + 2) * (spare + 1) <= 2 * GROUPS), 2).otherwise(1)
    rows = rows.withColumns({own: n, "g": g}).withColumn("_last", n - F.col("need") + F.col("g") - 1)
    word, end = lambda i: F.get("toks", i), F.col("_last")
    group = lambda *at: F.struct(F.concat_ws(" ", *map(word, at)).alias("tok"), (n - at[-1] - 1).alias("left"))
    after = lambda i, stop, use: F.transform(F.sequence(i, stop), use)
    one = after(F.lit(0), end, lambda i: group(i))
    two = F.flatten(after(F.lit(0), end - 1, lambda i: after(i + 1, end, lambda j: group(i, j))))
    three = F.flatten(after(F.lit(0), end - 2, lambda i: F.flatten(after(i + 1, end - 1, lambda j: after(j + 1, end, lambda m: group(i, j, m))))))
    groups = F.when(F.col("g") == 3, three).when(F.col("g") == 2, two).otherwise(one)
    return rows.select("key", "toks", own, other, "need", "g", F.inline(groups)).select("tok", own, other, "need", "g", "key", "toks", "left")


#: Groups of words that a name meets names of one size by.
GROUPS = 20


def similar_pairs(left: DataFrame, right: DataFrame, at_least: int) -> DataFrame:
    """Distinct text keys (column key) of two sides -> a, b, score (thousandths): all pairs that score at_least or more, exactly.

    Words stand rarest first; a pair can only score enough if it shares a given number of words, so that the first one to three shared
    words are among the first few of each. Only groups of those few are joined on, together with both sizes; a pair counts at its first
    common words alone, where enough words must follow on both sides, and is then scored. Pairs that meet are dealt evenly, since
    few rows make many. The score is that of ``similarity`` on keys (percentages are read from the key). A key without words scores
    half its letters at most, so at_least must be above 500. Null keys match nothing; repeated keys, which callers remove, would
    repeat pairs. Empty tables give no pairs.
    """
    if at_least <= 500:
        raise ValueError("at_least must be above 500: below, names without a common word may match")
    a, b = rare_first(left, right)
    on = ["tok", "na", "nb"]
    side = lambda p, end: p.select(*on, F.col("key").alias(end), F.col("toks").alias(f"t{end}"), F.col("left").alias(f"l{end}"))
    x, y = (written(p) for p in (prefixes(a, b, "na", "nb", at_least), prefixes(b, a, "nb", "na", at_least)))
    mine = x.select(*on, F.col("key").alias("a"), F.col("toks").alias("ta"), F.col("left").alias("la"), "need", "g")
    met = tiles(mine, side(y, "b"), on).filter(F.least("la", "lb") + F.col("g") >= F.col("need")).withColumn("shared", F.array_intersect("ta", "tb"))
    pairs = met.filter((F.size("shared") >= F.col("need")) & (F.concat_ws(" ", F.slice("shared", F.lit(1), F.col("g"))) == F.col("tok")))
    pairs = pairs.select("a", "b", F.size("shared").alias("both"), "na", "nb")
    either, fewer = F.col("na") + F.col("nb") - F.col("both"), F.least("na", "nb")
    score = set_score(F.col("both"), either, fewer, char_score(F.col("a"), F.col("b")), percentage(F.col("a")), percentage(F.col("b")))
    return pairs.select("a", "b", thousandths(score).alias("score")).filter(F.col("score") >= at_least)


#: Texts that have two labels from this score on (thousandths) aren't compared with those below.
FIRST = 750


def two_best(texts: DataFrame, labels: DataFrame, at_least: int) -> DataFrame:
    """Distinct keys of two sides -> a, b, score, place: the two best labels of each text. A text with two from ``FIRST`` on has its best;
    only the others meet those from at_least on, whose number grows much faster."""
    rank = lambda pairs: written(pairs.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), "b"))).filter("place <= 2"))
    if at_least >= FIRST:
        return rank(similar_pairs(texts, labels, at_least))
    near = rank(similar_pairs(texts, labels, FIRST))
    told = near.filter("place = 2").select("a")
    rest = written(texts.join(told, texts["key"] == told["a"], "left_anti"))
    return near.join(told, "a", "left_semi").unionByName(rank(similar_pairs(rest, labels, at_least)))


def best_matches(entries: DataFrame, offered: DataFrame, at_least: int) -> DataFrame:
    """entries(id, own, text: one row for each name or alias), offered(label) -> id, other, score: the label most like any of an
    entry's texts, not its own; of equal scores the first in order. Entries without one have no row.

    Texts and labels are compared once each however many rows repeat them. A text keeps its two best labels, one of which is not
    the entry's own, unless ``own`` differs from both: either way the best other one is among them.
    """
    keyed = entries.select("id", text_key(F.col("own")).alias("own"), text_key(F.col("text")).alias("a"))
    texts, labels = written(keyed.select(F.col("a").alias("key")).distinct()), written(offered.select(text_key(F.col("label")).alias("key")).distinct())
    found = keyed.join(two_best(texts, labels, at_least), "a").filter(~F.col("b").eqNullSafe(F.col("own")))
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("x"))
    return best.select("id", F.col("x.b").alias("other"), (-F.col("x.s")).alias("score"))


LABELS = f"""{PRODUCTS}, e AS (SELECT gtin, size % 7 = 0 AS weighed, gtin % 11 = 0 AS codeless, lower(name || ' ' || replace(brand, '#', '') || ' ' || department || ' ' || size || 'g') AS own, lower(name || ' ' || replace(brand, '#', '') || ' ' || size || 'g') AS alias FROM products),
texts AS (SELECT DISTINCT weighed, text, list_distinct(string_split(text, ' ')) AS ws FROM (SELECT weighed, unnest([own, alias]) AS text FROM e)),
labels AS (SELECT own AS label, bool_or(weighed OR codeless) AS loose, list_distinct(string_split(own, ' ')) AS ws FROM e GROUP BY own)"""


@query(
    "j04_catalogue_matches",
    f"""WITH {LABELS}, tw AS (SELECT weighed, text, unnest(ws) AS w FROM texts), lw AS (SELECT label, loose, unnest(ws) AS w FROM labels),
o AS (SELECT weighed, text, label, count(*) AS n FROM tw JOIN lw USING (w) WHERE NOT weighed OR loose GROUP BY ALL),
x AS (SELECT o.weighed, text, label, 0.5::DOUBLE * n / (len(texts.ws) + len(labels.ws) - n) + 0.25::DOUBLE * n / least(len(texts.ws), len(labels.ws)) AS part, CASE WHEN o.weighed THEN 550 ELSE 750 END AS t FROM o JOIN texts USING (weighed, text) JOIN labels USING (label)),
s AS (SELECT weighed, text, label, t, floor((part + 0.25::DOUBLE * (1 - levenshtein(text, label)::DOUBLE / greatest(len(text), len(label)))) * 1000 + 1e-6)::BIGINT AS score FROM x WHERE part >= t / 1000.0 - 0.26),
r AS (SELECT gtin, e.weighed, label AS other, score FROM e JOIN s ON s.weighed = e.weighed AND (s.text = e.own OR s.text = e.alias) WHERE score >= t AND label <> own)
SELECT gtin, weighed, other, score FROM r QUALIFY row_number() OVER (PARTITION BY gtin ORDER BY score DESC, other) = 1""",
)
def j04_catalogue_matches(spark, sf_dir):
    """For each product the other label most like its name or alias: weighed ones from 0.55 on among loose labels (weighed or
    without a code), packaged ones from 0.75 on among all."""
    p = products(spark, sf_dir).withColumns({"brand": F.replace("brand", F.lit("#"), F.lit("")), "g": F.concat("size", F.lit("g")), "weighed": F.col("size") % 7 == 0})
    p = p.withColumns({"own": F.lower(F.concat_ws(" ", "name", "brand", "department", "g")), "alias": F.lower(F.concat_ws(" ", "name", "brand", "g"))})
    entries = p.select(F.col("gtin").alias("id"), "own", F.explode(F.array("own", "alias")).alias("text"), "weighed")
    labels = p.select(F.col("own").alias("label"), (F.col("weighed") | (F.col("gtin") % 11 == 0)).alias("loose"))
    out = [best_matches(entries.filter(F.col("weighed") == w), labels.filter("loose") if w else labels, t).withColumn("weighed", F.lit(w)) for w, t in ((True, 550), (False, 750))]
    return out[0].unionByName(out[1]).select(F.col("id").alias("gtin"), "weighed", "other", "score")
