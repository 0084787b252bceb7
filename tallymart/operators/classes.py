"""Class rules over names: word starts with attached prefixes, guards by kind of word, the specific class before the general, twins.

Letters, prefix letters and word lists are parameters. Rule tables have a row for each pattern: concept, kind (all, any, none), pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.market import PRODUCTS, products
from .rules import MATCHED, rule_matches, sample_patterns


def word_start(pattern: Column, letters: str, prefixes: str) -> Column:
    """A pattern rewritten so that it matches only from the start of a word, or after one prefix letter that starts the word.

    A match that begins with another sign than a letter is judged as before. letters and prefixes are insides of a character class.
    """
    at_start = f"(?:(?<![{letters}])|(?<=(?<![{letters}])[{prefixes}]))(?=[{letters}])"
    return F.concat(F.lit(f"(?![{letters}])(?:"), pattern, F.lit(f")|{at_start}(?:"), pattern, F.lit(")"))


def stems_in(names: DataFrame, stems: DataFrame, letters: str, prefixes: str) -> DataFrame:
    """names(name), stems(stem) -> (name, stem): a word of the name begins with the stem, or does so after one prefix letter.

    What word_start() decides by pattern, for plain stems by an equi join: distinct names give the beginnings of their words, of
    the stems' lengths only (a few numbers).
    """
    lengths = [r[0] for r in stems.select(F.length("stem")).distinct().collect()]
    words = F.regexp_extract_all("name", F.lit(f"[{letters}]+"), F.lit(0))
    bare = F.transform(F.filter(words, lambda w: w.rlike(f"^[{prefixes}].")), lambda w: F.substring(w, 2, 1 << 20))
    begins = F.flatten(F.transform(F.concat(words, bare), lambda w: F.filter(F.array(*[F.substring(w, 1, n) for n in lengths]), lambda x: x != "")))
    keyed = names.select("name").distinct().select("name", F.explode(F.array_distinct(begins)).alias("stem"))
    return keyed.join(stems.select("stem").distinct(), "stem").select("name", "stem")


STEMS = "stems AS (SELECT substring(family, 1, 3) AS stem FROM products UNION SELECT substring(head, 2, 3) FROM products WHERE len(head) > 2)"


@query("f23_word_starts", f"WITH {PRODUCTS}, {STEMS} SELECT gtin, stem FROM products JOIN stems ON regexp_matches(name, '(^|[^a-z])[bcs]?' || stem)")
def f23_word_starts(spark, sf_dir):
    """Stems that name a product's words, in whole names or after one of three attached letters; never inside a word."""
    p = products(spark, sf_dir)
    stems = p.select(F.substring("family", 1, 3).alias("stem")).unionByName(p.filter("length(head) > 2").select(F.substring("head", 2, 3).alias("stem"))).distinct()
    return p.select("gtin", "name").join(stems_in(p, stems, "a-z", "bcs"), "name").select("gtin", "stem")


def guarded(matches: DataFrame, classes: DataFrame, words: DataFrame) -> DataFrame:
    """matches(name, concept) that the guards let through.

    classes(concept, kind, animals, vegan_scope, own, exempt): kind fresh refuses names with a processed word, but for words in its own
    patterns (own) or exempt; kind processed refuses names with a fresh word and no processed one; any refuses none. words(group,
    word), group fresh, processed, animal or vegan: names with an animal word belong to classes for animals only, those
    with a vegan word not to classes in the vegan scope. The words of a name are looked up once for each distinct name.
    """
    names = matches.select("name").distinct()
    said = names.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("word")).join(words, "word").groupBy("name").agg(
        *[F.collect_set(F.when(F.col("group") == g, F.col("word"))).alias(f"_{g}") for g in ("fresh", "processed", "animal", "vegan")]
    )
    some = lambda g: F.coalesce(F.size(f"_{g}"), F.lit(0)) > 0
    refused = F.size(F.array_except(F.coalesce("_processed", F.array().cast("array<string>")), F.array_union("own", "exempt"))) > 0
    out = matches.join(said, "name", "left").join(classes, "concept")
    kind = F.when(F.col("kind") == "fresh", ~refused).when(F.col("kind") == "processed", ~(some("fresh") & ~some("processed"))).otherwise(True)
    return out.filter(kind & (~some("animal") | F.col("animals")) & ~(some("vegan") & F.col("vegan_scope"))).select("name", "concept")


WORDS = [("processed", "gizmo"), ("processed", "widget"), ("fresh", "ring"), ("fresh", "rod"), ("animal", "bolt"), ("vegan", "anvil")]


@query(
    "f24_kind_guards",
    f"""WITH {MATCHED}, c AS (SELECT *, replace(concept, '!', '') AS head, split_part(name, ' ', -1) AS family FROM matched),
k AS (SELECT *, CASE len(head) % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'processed' ELSE 'any' END AS kind FROM c)
SELECT p.gtin, k.concept FROM k JOIN products p USING (name)
WHERE CASE kind WHEN 'fresh' THEN NOT (k.family = 'gizmo' OR (k.family = 'widget' AND k.head <> 'red')) WHEN 'processed' THEN k.family NOT IN ('ring', 'rod') ELSE true END
  AND (k.family <> 'bolt' OR k.head = 'hot') AND NOT (k.family = 'anvil' AND k.head IN ('cold', 'new'))""",
)
def f24_kind_guards(spark, sf_dir):
    """Class matches after the guards: fresh and processed words, animals, vegan names."""
    p = products(spark, sf_dir)
    h, n = F.col("head"), F.length("head") % 3
    classes = p.select("head").distinct().select(
        F.concat("head", F.lit("!")).alias("concept"), F.when(n == 0, "fresh").when(n == 1, "processed").otherwise("any").alias("kind"), (h == "hot").alias("animals"),
        h.isin("cold", "new").alias("vegan_scope"), F.array("head").alias("own"), F.when(h == "red", F.array(F.lit("widget"))).otherwise(F.array().cast("array<string>")).alias("exempt"),
    )
    kept = guarded(rule_matches(p, sample_patterns(p)), classes, spark.createDataFrame(WORDS, "group string, word string"))
    return p.select("gtin", "name").join(kept, "name").select("gtin", "concept")


def specific(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """hits(name, concept): of a name's classes the one that refines all others, where there is one; else all.

    rules(concept, kind, pattern). A refines B if A's ``all`` has B's and more, and B's ``any`` is empty, meets A's ``all``, or holds A's own
    ``any``. Only classes that meet in a name are compared, once for each pair; a name has few.
    """
    sets = rules.groupBy("concept").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("pattern"))).alias(k) for k in ("all", "any")])
    side = lambda x: sets.select(F.col("concept").alias(x), F.col("all").alias(f"{x}_all"), F.col("any").alias(f"{x}_any"))
    met = hits.select("name", F.col("concept").alias("a")).join(hits.select("name", F.col("concept").alias("b")), "name").filter("a <> b")
    pairs = met.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    within = lambda x, y: F.size(F.array_except(x, y)) == 0
    more = within("b_all", "a_all") & (F.size("a_all") > F.size("b_all"))
    sure = (F.size("b_any") == 0) | F.arrays_overlap("b_any", "a_all") | ((F.size("a_any") > 0) & within("a_any", "b_any"))
    refines = pairs.filter(more & sure).select("a", "b")
    wins = met.join(refines, ["a", "b"]).groupBy("name", "a").agg(F.count("*").alias("n"))
    n = hits.groupBy("name").agg(F.count("*").alias("hits"))
    winners = wins.join(n, "name").filter("n = hits - 1").select("name", F.col("a").alias("winner"))
    return hits.join(winners, "name", "left").filter("winner IS NULL OR winner = concept").select("name", "concept")


RULES = f"""{PRODUCTS}, rules AS (SELECT DISTINCT 'G ' || head AS concept, 'all' AS kind, head AS pattern FROM products
  UNION SELECT 'S ' || name, 'all', head FROM products WHERE len(family) = 4 UNION SELECT 'S ' || name, 'all', family FROM products WHERE len(family) = 4
  UNION SELECT 'A ' || head, 'all', head FROM products UNION SELECT 'A ' || head, 'any', family FROM products WHERE len(family) IN (4, 5)
  UNION SELECT 'G ' || head, 'none', 'frozen' FROM products WHERE len(head) = 4)"""


def word_rules(p: DataFrame) -> DataFrame:
    """A rule table of whole words over the products: general classes by head, specific ones by both words, one with alternatives."""
    row = lambda x, name, kind, pattern: x.select(F.concat(F.lit(name[0]), F.col(name[1])).alias("concept"), F.lit(kind).alias("kind"), pattern.alias("pattern"))
    four = p.filter("length(family) = 4")
    h, f = F.col("head"), F.col("family")
    parts = [
        row(p, ("G ", "head"), "all", h), row(four, ("S ", "name"), "all", h), row(four, ("S ", "name"), "all", f), row(p, ("A ", "head"), "all", h),
        row(p.filter("length(family) IN (4, 5)"), ("A ", "head"), "any", f), row(p.filter("length(head) = 4"), ("G ", "head"), "none", F.lit("frozen")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def whole_word_matches(names: DataFrame, rules: DataFrame) -> DataFrame:
    return rule_matches(names, rules.select("concept", "kind", F.col("pattern").alias("literal"), F.concat(F.lit("(^| )"), "pattern", F.lit("( |$)")).alias("pattern")))


@query(
    "f25_specificity",
    f"""WITH {RULES}, n AS (SELECT DISTINCT name, head, family FROM products), s AS (SELECT concept, list(pattern) FILTER (kind = 'all') AS al, coalesce(list(pattern) FILTER (kind = 'any'), []) AS an FROM rules GROUP BY concept),
h AS (SELECT name, concept, al, an FROM n JOIN s ON list_has_all([head, family], al) AND (len(an) = 0 OR list_has_any([head, family], an))),
r AS (SELECT a.name, a.concept, count(*) FILTER (a.concept <> b.concept AND NOT (list_has_all(a.al, b.al) AND len(a.al) > len(b.al) AND (len(b.an) = 0 OR list_has_any(b.an, a.al) OR (len(a.an) > 0 AND list_has_all(b.an, a.an))))) AS open FROM h a JOIN h b USING (name) GROUP BY ALL),
w AS (SELECT *, min(open) OVER (PARTITION BY name) AS least FROM r) SELECT name, concept FROM w WHERE open = 0 OR least > 0""",
)
def f25_specificity(spark, sf_dir):
    p = products(spark, sf_dir)
    rules = word_rules(p)
    return specific(whole_word_matches(p, rules), rules)


def twins(rules: DataFrame, listed: DataFrame, word: str, suffix: str = "-frozen") -> DataFrame:
    """rules(concept, kind, pattern) with a twin of each listed(concept): the twin requires the word and doesn't exclude it, the original excludes it."""
    mine = rules.join(listed, "concept", "left_semi")
    twin = mine.filter((F.col("kind") != "none") | (F.col("pattern") != word)).withColumn("concept", F.concat("concept", F.lit(suffix)))
    known = mine.select("concept").distinct()
    need = known.select(F.concat("concept", F.lit(suffix)).alias("concept"), F.lit("all").alias("kind"), F.lit(word).alias("pattern"))
    bar = known.select("concept", F.lit("none").alias("kind"), F.lit(word).alias("pattern"))
    return rules.unionByName(twin).unionByName(need).unionByName(bar).distinct()


@query(
    "f39_twins",
    f"""WITH {RULES}, m AS (SELECT * FROM rules WHERE starts_with(concept, 'G ') AND len(concept) <= 6)
SELECT * FROM rules UNION SELECT concept || '-frozen', kind, pattern FROM m WHERE NOT (kind = 'none' AND pattern = 'frozen')
UNION SELECT concept || '-frozen', 'all', 'frozen' FROM m UNION SELECT concept, 'none', 'frozen' FROM m""",
)
def f39_twins(spark, sf_dir):
    """Frozen twins of the general classes with short names."""
    rules = word_rules(products(spark, sf_dir))
    return twins(rules, rules.filter("concept LIKE 'G %' AND length(concept) <= 6").select("concept").distinct(), "frozen")
