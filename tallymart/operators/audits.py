"""More votes, audits and merges: names, sizes, snapshots, labels, decisions, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity, text_key, tokens
from ..registry import query
from ..sources.market import CART_LINES, OFFERS, PRICE_ROWS, PRODUCTS, cart_lines, offers, price_rows, products, table
from .history import DAYS, daily_prices
from .quality import IDENTITY, identity_members

# Hebrew letters that a word is written with or without.
SILENT = "יו"


@query(
    "p02_dropped_rows",
    f"WITH {PRICE_ROWS} SELECT chain, count(*) AS n, count(*) FILTER (price_c <= 0) AS unpriced, count(*) FILTER (price_c > 0 AND price_c < 5000) AS implausible, count(*) FILTER (price_c >= 5000) AS kept FROM price_rows GROUP BY chain",
)
def p02_dropped_rows(spark, sf_dir):
    """Rows without a price and with an implausible one, by chain; here that is one under 50.00."""
    p = F.col("price_c")
    return price_rows(spark, sf_dir).groupBy("chain").agg(
        F.count("*").alias("n"), F.count_if(p <= 0).alias("unpriced"), F.count_if((p > 0) & (p < 5000)).alias("implausible"), F.count_if(p >= 5000).alias("kept")
    )


@query("p06_valid_promotions", f"WITH {PRICE_ROWS} SELECT chain, count(*) AS n FROM price_rows WHERE pct > 0 AND (pct = 10 OR day + 30 >= DATE '1998-06-30') AND day <= DATE '1998-06-30' GROUP BY chain")
def p06_valid_promotions(spark, sf_dir):
    """Promotions valid on a day: those without an end, and those that end later."""
    ends = F.when(F.col("pct") != 10, F.date_add("day", 30))
    rows = price_rows(spark, sf_dir).filter("pct > 0 AND day <= DATE '1998-06-30'").withColumn("ends", ends)
    return rows.filter("ends IS NULL OR ends >= DATE '1998-06-30'").groupBy("chain").agg(F.count("*").alias("n"))


@query(
    "a06_display_name",
    f"""WITH {PRODUCTS}, v AS (SELECT size, name, count(*) AS n FROM products GROUP BY ALL)
SELECT size, name, n FROM v QUALIFY row_number() OVER (PARTITION BY size ORDER BY n * 10 + least(len(name), 9) DESC, name) = 1""",
)
def a06_display_name(spark, sf_dir):
    """The name shown for a group: frequency times ten and capped length. A prefix of a longer name of the group falls out
    when the longer one is at least half as frequent; the driver's names have no such prefixes."""
    v = products(spark, sf_dir).groupBy("size", "name").agg(F.count("*").alias("n"))
    longer = v.alias("a").join(v.alias("b"), "size").filter("startswith(b.name, a.name) AND length(b.name) > length(a.name) AND b.n * 2 >= a.n").select("size", F.col("a.name").alias("name")).distinct()
    w = Window.partitionBy("size").orderBy((F.col("n") * 10 + F.least(F.length("name"), F.lit(9))).desc(), "name")
    return v.join(longer, ["size", "name"], "left_anti").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


@query(
    "a08_size_vote",
    f"""WITH {PRICE_ROWS}, c AS (SELECT gtin, CASE WHEN qty % 10 = 0 THEN qty // 10 ELSE qty END AS total, qty, count(*) AS n FROM price_rows GROUP BY ALL),
v AS (SELECT gtin, total, sum(n)::BIGINT AS votes FROM c GROUP BY gtin, total), t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY gtin ORDER BY votes DESC, total DESC) = 1)
SELECT t.gtin, t.total, t.votes, arg_max(c.qty, (c.n, -c.qty)) AS spelling FROM t JOIN c ON c.gtin = t.gtin AND c.total = t.total GROUP BY ALL""",
)
def a08_size_vote(spark, sf_dir):
    """Two levels: the pack total with most votes, and its most used spelling."""
    total = F.when(F.col("qty") % 10 == 0, F.expr("qty div 10")).otherwise(F.col("qty"))
    c = price_rows(spark, sf_dir).groupBy("gtin", total.alias("total"), "qty").agg(F.count("*").alias("n"))
    t = c.groupBy("gtin", "total").agg(F.sum("n").alias("votes"), F.max_by("qty", F.struct("n", -F.col("qty"))).alias("spelling"))
    w = Window.partitionBy("gtin").orderBy(F.col("votes").desc(), F.col("total").desc())
    return t.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("gtin", "total", "votes", "spelling")


@query(
    "a21_no_concept_by_department",
    f"WITH {PRODUCTS} SELECT department, count(*) FILTER (size < 10) AS unsized, count(*) FILTER (brand = 'Brand#1') AS unbranded, count(*) AS n FROM products GROUP BY department HAVING count(*) FILTER (size < 10) > 0",
)
def a21_no_concept_by_department(spark, sf_dir):
    out = products(spark, sf_dir).groupBy("department").agg(F.count_if(F.col("size") < 10).alias("unsized"), F.count_if(F.col("brand") == "Brand#1").alias("unbranded"), F.count("*").alias("n"))
    return out.filter("unsized > 0")


@query(
    "a41_quality_checks",
    f"""WITH {OFFERS}, {PRODUCTS}, s AS (SELECT gtin, count(*) AS n_chains, max(price_c) AS hi, min(price_c) AS lo FROM offers GROUP BY gtin),
c AS (SELECT gtin, 'department word' AS rule FROM products WHERE contains(lower(name), lower(department)) UNION ALL SELECT gtin, 'size' FROM products WHERE size > 45
  UNION ALL SELECT gtin, 'price spread' FROM s WHERE hi > 20 * lo UNION ALL SELECT gtin, 'one chain' FROM s WHERE n_chains <= 9)
SELECT rule, count(*) AS n, count(DISTINCT gtin) AS n_products FROM c GROUP BY rule""",
)
def a41_quality_checks(spark, sf_dir):
    """One table of findings from all checks, counted by rule."""
    p = products(spark, sf_dir)
    s = offers(spark, sf_dir).groupBy("gtin").agg(F.count("*").alias("n_chains"), F.max("price_c").alias("hi"), F.min("price_c").alias("lo"))
    found = lambda rows, rule: rows.select("gtin", F.lit(rule).alias("rule"))
    checks = (
        found(p.filter("contains(lower(name), lower(department))"), "department word").unionByName(found(p.filter("size > 45"), "size"))
        .unionByName(found(s.filter("hi > 20 * lo"), "price spread")).unionByName(found(s.filter("n_chains <= 9"), "one chain"))
    )
    return checks.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("gtin").alias("n_products"))


@query(
    "a48_class_health",
    f"""WITH {PRODUCTS}, c AS (SELECT family, department, count(*) AS n FROM products GROUP BY ALL),
h AS (SELECT family, arg_max(department, (n, department)) AS home, max(n) AS n_home, sum(n)::BIGINT AS n_all FROM c GROUP BY family)
SELECT family, home, n_home, n_all, CASE WHEN 2 * n_home <= n_all THEN 'misfiled' WHEN n_home < n_all THEN 'too wide' ELSE 'ok' END AS verdict FROM h""",
)
def a48_class_health(spark, sf_dir):
    c = products(spark, sf_dir).groupBy("family", "department").agg(F.count("*").alias("n"))
    h = c.groupBy("family").agg(F.max_by("department", F.struct("n", "department")).alias("home"), F.max("n").alias("n_home"), F.sum("n").alias("n_all"))
    return h.withColumn("verdict", F.when(2 * F.col("n_home") <= F.col("n_all"), "misfiled").when(F.col("n_home") < F.col("n_all"), "too wide").otherwise("ok"))


@query(
    "a52_synonym_audit",
    f"WITH {PRODUCTS}, o AS (SELECT DISTINCT family AS phrase, department AS class FROM products) SELECT phrase, count(*) AS n_classes, string_agg(class, ',' ORDER BY class) AS classes FROM o GROUP BY phrase HAVING count(*) > 1",
)
def a52_synonym_audit(spark, sf_dir):
    """Phrases that several classes own."""
    o = products(spark, sf_dir).select(F.col("family").alias("phrase"), F.col("department").alias("class")).distinct()
    out = o.groupBy("phrase").agg(F.count("*").alias("n_classes"), F.array_join(F.array_sort(F.collect_list("class")), ",").alias("classes"))
    return out.filter("n_classes > 1")


@query(
    "a55_brand_propagation",
    f"""WITH {PRODUCTS}, t AS (SELECT brand, head, count(*) AS n FROM products GROUP BY ALL HAVING count(*) >= 3), h AS (SELECT p.gtin, t.brand FROM products p JOIN t ON t.head = p.head AND p.size % 10 = 0 AND t.n >= 14)
SELECT gtin, min(brand) AS brand FROM h GROUP BY gtin HAVING count(*) = 1""",
)
def a55_brand_propagation(spark, sf_dir):
    """Products without a brand take the trusted brand of their word, where there is exactly one."""
    p = products(spark, sf_dir)
    trusted = p.groupBy("brand", "head").agg(F.count("*").alias("n")).filter("n >= 14").select("brand", "head")
    hits = p.filter("size % 10 = 0").select("gtin", "head").join(trusted, "head")
    return hits.groupBy("gtin").agg(F.min("brand").alias("brand"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query(
    "a59_cluster_impact",
    f"""WITH {IDENTITY}, k AS (SELECT key, arg_max(gtin, (n_chains, -gtin)) AS canonical, max(n_chains) AS n_canonical, sum(n_chains)::BIGINT AS n_all, count(*) AS n FROM members GROUP BY key HAVING count(*) > 1)
SELECT *, n_all - n_canonical AS gain FROM k""",
)
def a59_cluster_impact(spark, sf_dir):
    """The code of a cluster that most chains sell, the smaller one of equal, and what the others would add."""
    k = identity_members(spark, sf_dir).groupBy("key").agg(
        F.max_by("gtin", F.struct("n_chains", -F.col("gtin"))).alias("canonical"), F.max("n_chains").alias("n_canonical"), F.sum("n_chains").alias("n_all"), F.count("*").alias("n")
    )
    return k.filter("n > 1").withColumn("gain", F.col("n_all") - F.col("n_canonical"))


@query(
    "a61_differing_tokens",
    f"""WITH {PRODUCTS}, t AS (SELECT family, gtin, unnest([head, department, brand]) AS tok FROM products), n AS (SELECT family, count(*) AS n FROM products GROUP BY family)
SELECT family, tok, count(DISTINCT gtin) AS n_members, n FROM t JOIN n USING (family) GROUP BY ALL HAVING count(DISTINCT gtin) < n""",
)
def a61_differing_tokens(spark, sf_dir):
    """Tokens of a group that not all members have."""
    p = products(spark, sf_dir)
    n = p.groupBy("family").agg(F.count("*").alias("n"))
    t = p.select("family", "gtin", F.explode(F.array_distinct(F.array("head", "department", "brand"))).alias("tok"))
    return t.groupBy("family", "tok").agg(F.count("*").alias("n_members")).join(n, "family").filter("n_members < n")


@query("a62_longest_name", f"WITH {PRODUCTS} SELECT brand, arg_max(name, (len(name), -gtin)) AS name FROM products GROUP BY brand")
def a62_longest_name(spark, sf_dir):
    return products(spark, sf_dir).groupBy("brand").agg(F.max_by("name", F.struct(F.length("name"), -F.col("gtin"))).alias("name"))


@query(
    "w12_truncated_names",
    """WITH n AS (SELECT DISTINCT source, substring(split_part(text, chr(10), 1), 1, 12 + (doc_id % 5)::INT) AS name FROM documents)
SELECT source, name FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.source = a.source AND starts_with(b.name, a.name) AND len(b.name) > len(a.name))""",
)
def w12_truncated_names(spark, sf_dir):
    name = F.expr("substring(split_part(text, '\n', 1), 1, 12 + CAST(doc_id % 5 AS INT))")
    return untruncated(table(spark, sf_dir, "documents").select("source", name.alias("name")))


def untruncated(names: DataFrame, head: int = 4) -> DataFrame:
    """names(source, name) -> the distinct ones less those that begin a longer one of their source; a null source or name is no one's
    beginning and stays.

    Names of ``head`` characters or more meet those with the same first ones: in binary order a name's longer forms come right after
    it, so that the next name tells. Shorter ones (the empty one too) are looked up among the short beginnings of all longer names.
    """
    n = names.distinct()
    after = F.lead("name").over(Window.partitionBy("source", F.substring("name", 1, head)).orderBy("name"))
    begins = F.col("source").isNotNull() & F.col("after").startswith(F.col("name"))
    long = n.filter(F.length("name") >= head).withColumn("after", after).filter(~F.coalesce(begins, F.lit(False))).select("source", "name")
    short = n.filter((F.length("name") < head) | F.col("name").isNull())
    starts = F.transform(F.sequence(F.lit(0), F.least(F.length("name"), F.lit(head)) - 1), lambda i: F.substring("name", F.lit(1), i))
    starts = n.filter(F.length("name") > 0).select("source", F.explode(starts).alias("name")).distinct()
    return long.unionByName(short.join(starts, ["source", "name"], "left_anti"))


@query(
    "u04_new_since",
    f"WITH {PRICE_ROWS} SELECT chain, count(DISTINCT gtin) AS n_new FROM price_rows a WHERE day >= DATE '2000-01-01' AND NOT EXISTS (SELECT 1 FROM price_rows b WHERE b.chain = a.chain AND b.gtin = a.gtin AND b.day < DATE '2000-01-01') GROUP BY chain",
)
def u04_new_since(spark, sf_dir):
    """Products that a chain lists since 2000 and not before: one pass, by the first day."""
    first = price_rows(spark, sf_dir).groupBy("chain", "gtin").agg(F.min("day").alias("first"))
    return first.filter("first >= DATE '2000-01-01'").groupBy("chain").agg(F.count("*").alias("n_new"))


@query(
    "h05_snapshot_diff",
    f"""WITH {DAYS}, a AS (SELECT chain, gtin, arg_max(price_c, day) AS old_c FROM days WHERE day < DATE '1998-07-01' GROUP BY ALL), b AS (SELECT chain, gtin, arg_max(price_c, day) AS new_c FROM days GROUP BY ALL)
SELECT chain, count(*) FILTER (old_c IS NULL) AS gained, count(*) FILTER (new_c > old_c) AS dearer, count(*) FILTER (new_c < old_c) AS cheaper, count(*) FILTER (new_c = old_c) AS same FROM b LEFT JOIN a USING (chain, gtin) GROUP BY chain""",
)
def h05_snapshot_diff(spark, sf_dir):
    """Last prices by the middle of 1998 and now, side by side in one aggregation."""
    early = F.col("day") < "1998-07-01"
    x = daily_prices(spark, sf_dir).groupBy("chain", "gtin").agg(F.max_by("price_c", "day").alias("new_c"), F.max_by(F.when(early, F.col("price_c")), F.when(early, F.col("day"))).alias("old_c"))
    new, old = F.col("new_c"), F.col("old_c")
    return x.groupBy("chain").agg(F.count_if(old.isNull()).alias("gained"), F.count_if(new > old).alias("dearer"), F.count_if(new < old).alias("cheaper"), F.count_if(new == old).alias("same"))


@query("h07_fingerprint", f"WITH {OFFERS} SELECT chain, count(*) AS n, md5(string_agg(gtin || ':' || price_c, ',' ORDER BY gtin)) AS print FROM offers GROUP BY chain")
def h07_fingerprint(spark, sf_dir):
    """Whether a chain's snapshot changed. A chain's catalogue is bounded by its products; prices are no part of the order."""
    x = F.struct("gtin", F.concat_ws(":", "gtin", "price_c").alias("s"))
    return offers(spark, sf_dir).groupBy("chain").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["s"]), ",")).alias("print"))


def multiset_print(rows: DataFrame, *keys: str, content: Column) -> DataFrame:
    """rows -> keys, n, s1, s2: the number of rows and the sums of two 48-bit pieces of their contents' digests.

    The same for any order of rows and any cut into tasks; sums of two tables add up, so that a change costs the rows changed (see
    after_change()). Equal contents count as often as they occur, null ones as the empty text. Sums are exact (DECIMAL(38)).
    """
    digest = F.md5(F.coalesce(content.cast("string"), F.lit("")))
    piece = lambda start: F.sum(F.conv(F.substring(digest, start, 12), 16, 10).cast("decimal(28,0)"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), piece(1).alias("s1"), piece(13).alias("s2"))


def after_change(old: DataFrame, added: DataFrame, removed: DataFrame, *keys: str) -> DataFrame:
    """Prints of the tables after a change, from those before it and those of the rows added and removed; a key without rows goes."""
    less = removed.select(*keys, *[(-F.col(c)).alias(c) for c in ("n", "s1", "s2")])
    out = old.unionByName(added).unionByName(less).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
    return out.filter("n <> 0")


@query(
    "h07_mergeable_print",
    f"""WITH {OFFERS}, d AS (SELECT chain, md5(gtin || ':' || CASE WHEN gtin % 7 = 0 THEN price_c + 1 ELSE price_c END) AS h FROM offers WHERE gtin % 11 <> 0)
SELECT chain, count(*) AS n, sum(('0x' || substr(h, 1, 12))::BIGINT)::VARCHAR AS s1, sum(('0x' || substr(h, 13, 12))::BIGINT)::VARCHAR AS s2 FROM d GROUP BY chain""",
)
def h07_mergeable_print(spark, sf_dir):
    """Prints of the chains' catalogues after a batch of changes (other prices of codes by seven, codes by eleven gone), from the prints before and the changes alone."""
    rows = offers(spark, sf_dir).select("chain", "gtin", "price_c")
    says = F.concat_ws(":", "gtin", "price_c")
    gone, dearer = F.col("gtin") % 11 == 0, (F.col("gtin") % 7 == 0) & (F.col("gtin") % 11 != 0)
    added = multiset_print(rows.filter(dearer).withColumn("price_c", F.col("price_c") + 1), "chain", content=says)
    out = after_change(multiset_print(rows, "chain", content=says), added, multiset_print(rows.filter(gone | dearer), "chain", content=says), "chain")
    return out.select("chain", "n", F.col("s1").cast("string").alias("s1"), F.col("s2").cast("string").alias("s2"))


@query(
    "h03_content_dedupe",
    """WITH t AS (SELECT doc_id, md5(text) AS print, len(text) AS n_chars FROM documents), g AS (SELECT print, min(doc_id) AS first, count(*) AS n FROM t GROUP BY print)
SELECT t.doc_id, g.first, g.n, t.n_chars FROM t JOIN g USING (print) WHERE g.n > 1""",
)
def h03_content_dedupe(spark, sf_dir):
    """Contents computed once per fingerprint and dealt back to all that share it."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("print"), F.length("text").alias("n_chars"))
    g = t.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return t.join(g, "print").select("doc_id", "first", "n", "n_chars")


@query(
    "g02_thin_catalogue",
    f"""WITH {OFFERS}, {PRODUCTS}, m AS (SELECT gtin, quantile_disc(price_c, 0.5 ORDER BY price_c DESC) AS base FROM offers GROUP BY gtin HAVING count(*) >= 10)
SELECT chain, gtin, price_c, pct >= 9 AS own_brand, price_c <= 3 * base AND price_c * 3 >= base AS in_band FROM offers JOIN m USING (gtin)""",
)
def g02_thin_catalogue(spark, sf_dir):
    """Each chain's offers of published products, with the own-brand mark and whether the price is in the band."""
    o = offers(spark, sf_dir)
    m = o.groupBy("gtin").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY price_c DESC)").cast("long").alias("base"), F.count("*").alias("n")).filter("n >= 10")
    band = (F.col("price_c") <= 3 * F.col("base")) & (F.col("price_c") * 3 >= F.col("base"))
    return o.join(m.select("gtin", "base"), "gtin").select("chain", "gtin", "price_c", (F.col("pct") >= 9).alias("own_brand"), band.alias("in_band"))


@query(
    "g05_alias_checks",
    f"""WITH {PRODUCTS}, a AS (SELECT gtin AS alias, gtin - size % 4 AS canonical FROM products WHERE size % 5 < 3)
SELECT count(*) AS n, count(*) FILTER (alias = canonical) AS self, count(*) FILTER (alias <> canonical AND canonical IN (SELECT alias FROM a b WHERE b.alias <> b.canonical)) AS chained FROM a""",
)
def g05_alias_checks(spark, sf_dir):
    """Aliases of themselves, and aliases whose canonical code is an alias too."""
    a = products(spark, sf_dir).filter("size % 5 < 3").select(F.col("gtin").alias("alias"), (F.col("gtin") - F.col("size") % 4).alias("canonical"))
    real = a.filter("alias <> canonical")
    chained = real.join(real.select(F.col("alias").alias("canonical")), "canonical", "left_semi").agg(F.count("*").alias("chained"))
    return a.agg(F.count("*").alias("n"), F.count_if(F.col("alias") == F.col("canonical")).alias("self")).crossJoin(chained)


@query(
    "g14_label_merge",
    """WITH o AS (SELECT doc_id, quality, 1 AS batch FROM labels WHERE doc_id % 3 > 0), n AS (SELECT doc_id, 1 - quality AS quality, 2 AS batch FROM labels WHERE doc_id % 4 = 0), u AS (SELECT * FROM o UNION ALL SELECT * FROM n)
SELECT doc_id, arg_max(quality, batch)::INT AS quality, count(*) AS n_batches, count(DISTINCT quality) > 1 AS conflict FROM u GROUP BY doc_id""",
)
def g14_label_merge(spark, sf_dir):
    """New labels over old ones; labels that differ are told."""
    labels = table(spark, sf_dir, "labels")
    old = labels.filter("doc_id % 3 > 0").select("doc_id", "quality", F.lit(1).alias("batch"))
    new = labels.filter("doc_id % 4 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit(2).alias("batch"))
    return old.unionByName(new).groupBy("doc_id").agg(F.max_by("quality", "batch").cast("int").alias("quality"), F.count("*").alias("n_batches"), (F.count_distinct("quality") > 1).alias("conflict"))


def heads(words: Column) -> Column:
    """The first three letters of each word; words of one letter count only where there are no others."""
    longer = F.filter(words, lambda w: F.length(w) >= 2)
    return F.array_distinct(F.transform(F.when(F.size(longer) > 0, longer).otherwise(words), lambda w: F.substring(w, 1, 3)))


def holders(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """keys(key, form), asked(want, form) -> want, key: keys that hold the question's rarest word head, anywhere.

    A key that holds the question, or a word beginning with each of its words, holds all its heads, so that none is missed.
    """
    ranks = F.expr("flatten(transform(sequence(1, length(form)), i -> array(substr(form, i, 1), substr(form, i, 2), substr(form, i, 3))))")
    grams = keys.filter("form <> ''").select("key", F.explode(F.array_distinct(ranks)).alias("gram"))
    wanted = asked.select("want", F.explode(heads(tokens(F.col("form")))).alias("gram"))
    often = grams.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, "gram").groupBy("want").agg(F.min_by("gram", "n").alias("gram"))
    return grams.join(rarest, "gram").select("want", "key")


def every_word(want: Column, key: Column) -> Column:
    """Each word of two letters or more begins a word of the key; shorter ones are words of it."""
    return F.forall(want, lambda w: F.exists(key, lambda k: (k == w) | ((F.length(w) >= 2) & k.startswith(w))))


def search(items: DataFrame, questions: DataFrame, most: int = 10, few: int = 10, silent: str = SILENT, floor: float = 0.4) -> DataFrame:
    """items(gtin, name), questions(q, asked) -> q, gtin, score, place: the best hits of each question, at most ``most``.

    1 for a name that holds the question, 0.8 for one with all its words or words that they begin. Other names: where a question
    has under ``few`` such hits, 0.9 and 0.75 by the same rules with ``silent`` letters left out; else 0.7 times the similarity,
    which counts from ``floor`` on. Questions without a letter or digit have no hits. Names with equal keys are judged once.
    A similarity that reaches the floor needs a common word if the floor is over 0.35 (without one it is half at most).
    """
    if floor <= 0.35:
        raise ValueError(f"floor {floor}: names without a word in common could reach it")
    i = items.select("gtin", text_key(F.col("name")).alias("key")).filter("key <> ''")
    q = questions.select("q", text_key(F.col("asked")).alias("want")).filter("want <> ''")
    keys, wants = i.groupBy("key").agg(F.count("*").alias("n")), q.select("want").distinct()
    want, key, fold = F.col("want"), F.col("key"), lambda c: F.translate(c, silent, "")
    plain = holders(keys.select("key", key.alias("form")), wants.select("want", want.alias("form")))
    exact = plain.withColumn("score", F.when(F.contains(key, want), 1.0).when(every_word(tokens(want), tokens(key)), 0.8)).filter("score IS NOT NULL")
    scarce = wants.join(exact.join(keys, "key").groupBy("want").agg(F.sum("n").alias("hits")), "want", "left").select("want", (F.coalesce("hits", F.lit(0)) < few).alias("scarce"))

    folded = holders(keys.select("key", fold(key).alias("form")), scarce.filter("scarce").select("want", fold(want).alias("form")))
    word = lambda t, c: t.select(c, F.explode(tokens(F.col(c))).alias("word"))
    alike = word(wants, "want").join(word(keys, "key"), "word").select("want", "key")
    rest = folded.unionByName(alike).distinct().join(exact, ["want", "key"], "left_anti").join(scarce, "want")
    words = F.filter(tokens(fold(want)), lambda w: F.length(w) >= 2)
    held = F.col("scarce") & (F.length(fold(want)) >= 2) & F.contains(fold(key), fold(want))
    begun = F.col("scarce") & (F.size(words) > 0) & every_word(words, tokens(fold(key)))
    near = F.floor(0.7 * similarity(want, key) * 1000 + 1e-6) / 1000
    rescued = rest.withColumn("score", F.when(held, 0.9).when(begun, 0.75).otherwise(near)).filter(F.col("score") >= floor)

    first = i.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("gtin"))).filter(F.col("nth") <= most)
    hits = exact.unionByName(rescued.select("want", "key", "score")).join(first, "key").join(q, "want")
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "key", "gtin")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("q", "gtin", "score", "place")


def sql_words(want: str, key: str) -> str:
    """SQL of every_word over two lists."""
    return f"len(list_filter({want}, lambda w: len(list_filter({key}, lambda k: k = w OR (len(w) >= 2 AND starts_with(k, w)))) = 0)) = 0"


@query(
    "r01_product_search",
    f"""WITH {PRODUCTS}, a AS (SELECT DISTINCT name, head, family FROM products WHERE gtin % 20 = 0),
q AS (SELECT name AS want FROM a UNION SELECT substring(head, 1, 2) || ' ' || family FROM a UNION SELECT trim(substring(name, 2, 3)) FROM a UNION SELECT substring(name, 1, 1) FROM a UNION SELECT translate(name, 'ei', '') FROM a UNION SELECT name || ' extra' FROM a),
n AS (SELECT name AS key, count(*) AS n FROM products GROUP BY ALL),
x AS (SELECT *, string_split(want, ' ') AS ws, string_split(key, ' ') AS ks, translate(want, 'ei', '') AS fw, translate(key, 'ei', '') AS fk FROM q, n),
e AS (SELECT *, CASE WHEN contains(key, want) THEN 1.0::DOUBLE WHEN {sql_words('ws', 'ks')} THEN 0.8::DOUBLE END AS s, list_filter(string_split(fw, ' '), lambda w: len(w) >= 2) AS fs, string_split(fk, ' ') AS gs,
  len(list_intersect(ws, ks)) AS shared, len(list_distinct(ws)) AS nw, len(list_distinct(ks)) AS nk, 1 - levenshtein(want, key) / greatest(len(want), len(key)) AS ch FROM x),
g AS (SELECT *, coalesce(sum(n) FILTER (s IS NOT NULL) OVER (PARTITION BY want), 0) < 10 AS few FROM e),
r AS (SELECT want, key, coalesce(s, CASE WHEN few AND len(fw) >= 2 AND contains(fk, fw) THEN 0.9::DOUBLE WHEN few AND len(fs) > 0 AND {sql_words('fs', 'gs')} THEN 0.75::DOUBLE
  ELSE floor(0.7 * (0.5 * shared / (nw + nk - shared) + 0.25 * shared / least(nw, nk) + 0.25 * ch) * 1000 + 1e-6) / 1000 END) AS score FROM g)
SELECT want AS q, gtin, score, row_number() OVER (PARTITION BY want ORDER BY score DESC, name, gtin) AS place FROM r JOIN products ON name = key WHERE score >= 0.4 QUALIFY place <= 10""",
)
def r01_product_search(spark, sf_dir):
    """Names of products with codes divisible by 20 asked whole, abbreviated, from inside a word, by a letter, misspelt and with a word too many."""
    p = products(spark, sf_dir)
    a = p.filter("gtin % 20 = 0")
    forms = ["name", "concat(substring(head, 1, 2), ' ', family)", "trim(substring(name, 2, 3))", "substring(name, 1, 1)", "translate(name, 'ei', '')", "concat(name, ' extra')"]
    asked = a.select(F.explode(F.array(*[F.expr(f) for f in forms])).alias("asked")).distinct()
    return search(p, asked.select(F.col("asked").alias("q"), "asked"), silent="ei")


def size_of(name: Column) -> Column:
    """value, unit, count from a name: `6x330 ml`, `1.5 l`, `500 g`, `12 units`; grams, millilitres and pieces; null without one."""
    pattern = r"(?:(\d+) ?[x*] ?)?(\d+(?:\.\d+)?) ?(kg|g|ml|l|units?)(?![a-z])"
    part = lambda i: F.nullif(F.regexp_extract(F.lower(name), pattern, i), F.lit(""))
    unit = part(3)
    scale = F.when(unit.isin("kg", "l"), 1000).otherwise(1)
    base = F.when(unit.isin("kg", "g"), "g").when(unit.isin("l", "ml"), "ml").when(unit.isNotNull(), "unit")
    return F.when(unit.isNotNull(), F.struct((part(2).cast("double") * scale).alias("value"), base.alias("unit"), F.coalesce(part(1).cast("int"), F.lit(1)).alias("count")))


@query(
    "f09_sizes",
    r"""WITH n AS (SELECT p_partkey AS gtin, CASE p_partkey % 5 WHEN 0 THEN p_name || ' 6x' || p_size || ' ml' WHEN 1 THEN p_name || ' ' || p_size || '.5 l' WHEN 2 THEN p_size || ' g ' || p_name WHEN 3 THEN p_name || ' ' || p_size || ' units' ELSE p_name END AS name, p_size FROM part)
SELECT gtin, CASE gtin % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 + 500 WHEN 2 THEN p_size WHEN 3 THEN p_size END::DOUBLE AS value, CASE gtin % 5 WHEN 0 THEN 'ml' WHEN 1 THEN 'ml' WHEN 2 THEN 'g' WHEN 3 THEN 'unit' END AS unit, CASE gtin % 5 WHEN 0 THEN 6 WHEN 4 THEN NULL ELSE 1 END::INT AS count FROM n""",
)
def f09_sizes(spark, sf_dir):
    n, s, k = F.col("name"), F.col("size").cast("string"), F.col("gtin") % 5
    name = (
        F.when(k == 0, F.concat(n, F.lit(" 6x"), s, F.lit(" ml"))).when(k == 1, F.concat(n, F.lit(" "), s, F.lit(".5 l"))).when(k == 2, F.concat(s, F.lit(" g "), n))
        .when(k == 3, F.concat(n, F.lit(" "), s, F.lit(" units"))).otherwise(n)
    )
    return products(spark, sf_dir).select("gtin", size_of(name).alias("s")).select("gtin", "s.value", "s.unit", "s.count")


@query(
    "b06_pool_choice",
    f"""WITH RECURSIVE {CART_LINES}, g AS (SELECT cart, gtin % 3 AS a, gtin % 2 AS b, line, qty FROM cart_lines),
p AS (SELECT cart, 'a' || a AS pool, list_distinct(list(line)) AS lines, sum(qty) AS gain FROM g GROUP BY ALL HAVING count(DISTINCT line) > 1 UNION ALL SELECT cart, 'b' || b, list_distinct(list(line)), sum(qty) FROM g GROUP BY ALL HAVING count(DISTINCT line) > 1),
o AS (SELECT *, row_number() OVER (PARTITION BY cart ORDER BY gain DESC, pool) AS rn FROM p),
r AS (SELECT cart, rn, [pool] AS chosen, lines AS taken FROM o WHERE rn = 1
  UNION ALL SELECT o.cart, o.rn, CASE WHEN list_has_any(r.taken, o.lines) THEN r.chosen ELSE r.chosen || [o.pool] END, CASE WHEN list_has_any(r.taken, o.lines) THEN r.taken ELSE r.taken || o.lines END FROM r JOIN o ON o.cart = r.cart AND o.rn = r.rn + 1)
SELECT cart, array_to_string(chosen, ',') AS pools FROM r QUALIFY row_number() OVER (PARTITION BY cart ORDER BY rn DESC) = 1""",
)
def b06_pool_choice(spark, sf_dir):
    """Pools by gain, the largest first; a line joins one. A cart's few pools are folded in its row, without a Python function."""
    g = cart_lines(spark, sf_dir)
    pool = lambda letter, n: g.groupBy("cart", F.concat(F.lit(letter), (F.col("gtin") % n).cast("string")).alias("pool")).agg(F.collect_set("line").alias("lines"), F.sum("qty").alias("gain"))
    pools = pool("a", 3).unionByName(pool("b", 2)).filter(F.size("lines") > 1)
    ordered = pools.groupBy("cart").agg(F.array_sort(F.collect_list(F.struct((-F.col("gain")).alias("gain"), "pool", "lines"))).alias("pools"))
    start = F.struct(F.array().cast("array<string>").alias("chosen"), F.array().cast("array<int>").alias("taken"))
    add = lambda a, x: F.when(F.arrays_overlap(a["taken"], x["lines"]), a).otherwise(F.struct(F.array_append(a["chosen"], x["pool"]).alias("chosen"), F.concat(a["taken"], x["lines"]).alias("taken")))
    return ordered.select("cart", F.array_join(F.aggregate("pools", start, add)["chosen"], ",").alias("pools"))
