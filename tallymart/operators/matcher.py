"""The class matcher: an automaton over the literals of a rule table, two texts a name, word starts, guards, the specific class first.

Names are keys as text_key() gives them. Letters, prefix letters and word lists are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.market import PRODUCTS, products
from ..sources.scratch import written
from .classes import specific, word_start
from .names import without_flavour

#: Literals of so many characters together at most become one automaton, about 100 bytes a character.
AUTOMATON_CHARS = 400_000


def literal_positions(texts: DataFrame, literals: DataFrame, most: int = AUTOMATON_CHARS) -> DataFrame:
    """texts(text), literals(literal) -> (text, literal, at): each place, from 1, where a literal stands in a text, once for distinct rows.

    Overlapping places count; null and empty texts and literals have none. The literals' characters are counted first: up to ``most``
    they become one Aho-Corasick automaton that each task receives and reads its texts with; beyond that, literals and places
    of texts meet by their first three characters. Both give the same rows.
    """
    wanted = literals.filter("literal <> ''").select("literal").distinct()
    held = texts.filter("text <> ''").select("text").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.length("literal")), F.lit(0))).first()[0]
    return _scanned(held, wanted) if size <= most else _dealt(held, wanted)


def _scanned(texts: DataFrame, literals: DataFrame, rows: int = 50_000) -> DataFrame:
    trie = ahocorasick.Automaton()
    for (x,) in literals.collect():  # of bounded size, see above
        trie.add_word(x, x)
    schema = "text string, literal string, at int"
    if not len(trie):
        return texts.sparkSession.createDataFrame([], schema)
    trie.make_automaton()
    sent = texts.sparkSession.sparkContext.broadcast(trie)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for batch in batches:
            for text in batch["text"]:
                for end, x in sent.value.iter(text):
                    found.append((text, x, end - len(x) + 2))
                    if len(found) >= rows:
                        yield pd.DataFrame(found, columns=["text", "literal", "at"])
                        found = []
        if found:
            yield pd.DataFrame(found, columns=["text", "literal", "at"])

    return texts.mapInPandas(scan, schema)


def _dealt(texts: DataFrame, literals: DataFrame) -> DataFrame:
    lengths = [r[0] for r in literals.select(F.least(F.length("literal"), F.lit(3))).distinct().collect()]  # three numbers at most
    places = texts.select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    pieces = F.array(*[F.substr("text", F.col("at"), F.lit(n)) for n in lengths])
    keyed = places.select("text", "at", F.explode(F.array_distinct(pieces)).alias("key"))
    met = keyed.join(literals.select("literal", F.substring("literal", 1, 3).alias("key")), "key")
    return met.filter(F.substr("text", F.col("at"), F.length("literal")) == F.col("literal")).select("text", "literal", "at")


def class_matches(
    names: DataFrame, rules: DataFrame, classes: DataFrame, words: DataFrame, core: Column, letters: str, prefixes: str, most: int = AUTOMATON_CHARS
) -> DataFrame:
    """names(name) -> (name, concept): the classes whose rules take a name, less those that a more specific one of the name refines.

    rules(concept, kind all/any/none, literal, pattern): a pattern's matches hold its literal. A class takes a name if all of ``all``, one
    of ``any`` where there are such, and none of ``none`` match; a class without ``all`` and ``any`` takes nothing. classes(concept, whole,
    kind, animals, vegan_scope, exempt): a class without a row is of kind any, reads the core, is for no animals and in no vegan
    scope. words(group, word), group processed, fresh, animal or vegan, found anywhere in a text, inside words too.

    - ``core`` is an expression over ``name``, the name less what only tells its flavour. ``all``, ``any`` and the guards of kind read the
      core, or the whole name in classes of ``whole``; ``none``, animal and vegan words read the whole name.
    - ``all``, ``any`` and those of ``none`` that are a plain word match only from a word's start, or after one of ``prefixes`` that starts the
      word; other patterns of ``none`` match anywhere. Word starts are told by the first of ``letters`` in a match.
    - Guards: fresh classes refuse names with a processed word, but for words in their own ``all`` and in ``exempt``; processed ones
      names with a fresh and no processed word. Names with an animal word are for classes of animals only, those with a vegan word
      not for classes in the vegan scope.

    Null and empty names have no class; repeated names, rules and words count once. Plain words are decided by their places alone,
    other patterns are tried only on texts that hold their literal.
    """
    rules, words = rules.select("concept", "kind", "literal", "pattern").distinct(), words.select("group", F.col("word").alias("literal")).distinct()
    both = names.filter("name <> ''").select("name").distinct().select("name", core.alias("core"))
    side = lambda whole, text: F.struct(F.lit(whole).alias("whole"), F.col(text).alias("text"))
    sides = both.select("name", F.inline(F.array(side(False, "core"), side(True, "name"))))

    head = F.left("text", F.col("at") - 1)
    starts = ~F.col("literal").rlike(f"^[{letters}]") | ~head.rlike(f"[{letters}]$")
    if prefixes:
        starts = starts | head.rlike(f"(?:^|[^{letters}])[{prefixes}]$")
    places = literal_positions(sides, rules.select("literal").unionByName(words.select("literal")), most)
    met = written(sides.join(places.groupBy("text", "literal").agg(F.bool_or(starts).alias("starts")), "text"))

    info = classes.select("concept", F.col("whole").alias("reads_whole"), F.col("kind").alias("sort"), "animals", "vegan_scope", "exempt").dropDuplicates(["concept"])
    asked = rules.join(info.select("concept", "reads_whole"), "concept", "left")
    asked = asked.select("concept", "kind", "literal", "pattern", ((F.col("kind") == "none") | F.coalesce("reads_whole", F.lit(False))).alias("whole"))
    plain = (F.col("pattern") == F.col("literal")) & F.col("pattern").rlike(f"^[A-Za-z{letters}]+$")
    anywhere = F.rlike(F.col("text"), F.col("pattern"))
    takes = F.when(plain, F.col("starts")).when(F.col("kind") == "none", anywhere).otherwise(F.rlike(F.col("text"), word_start(F.col("pattern"), letters, prefixes)))
    count = lambda name: [F.count_if(F.col("kind") == k).alias(f"{name}_{k}") for k in ("all", "any", "none")]
    hit = met.join(asked, ["literal", "whole"]).filter(takes).groupBy("name", "concept").agg(*count("n"))
    need = rules.groupBy("concept").agg(*count("want"), F.collect_set(F.when(F.col("kind") == "all", F.col("pattern"))).alias("own"))
    hit = hit.join(need, "concept").filter("n_none = 0 AND n_all = want_all AND (want_any = 0 OR n_any > 0) AND want_all + want_any > 0")

    said = met.join(words, "literal").groupBy("name", "whole").agg(
        *[F.collect_set(F.when(F.col("group") == g, F.col("literal"))).alias(g) for g in ("processed", "fresh")], *[F.bool_or(F.col("group") == g).alias(g) for g in ("animal", "vegan")]
    )
    scope = said.filter("whole").select("name", "animal", "vegan")
    none = F.array().cast("array<string>")
    out = hit.join(info, "concept", "left").withColumn("whole", F.coalesce("reads_whole", F.lit(False)))
    out = out.join(said.select("name", "whole", "processed", "fresh"), ["name", "whole"], "left").join(scope, "name", "left")
    out = out.withColumns({"exempt": F.coalesce("exempt", none), "processed": F.coalesce("processed", none), "fresh": F.coalesce("fresh", none)})
    strange = F.exists("processed", lambda w: ~F.array_contains("exempt", w) & ~F.exists("own", lambda p: F.contains(p, w)))
    kind = F.when(F.col("sort") == "fresh", ~strange).when(F.col("sort") == "processed", (F.size("fresh") == 0) | (F.size("processed") > 0)).otherwise(True)
    yes = lambda c: F.coalesce(c, F.lit(False))
    kept = out.filter(kind & (~yes("animal") | yes("animals")) & ~(yes("vegan") & yes("vegan_scope"))).select("name", "concept")
    return specific(written(kept), rules)


GUARD_WORDS = [("processed", "gizmo"), ("processed", "ring"), ("fresh", "rod"), ("fresh", "gear"), ("animal", "olt"), ("vegan", "nvil")]

LABELLED = f"""{PRODUCTS}, cores AS (SELECT *, CASE WHEN size % 4 = 1 THEN 'b' ELSE '' END || name AS core FROM products),
texts AS (SELECT DISTINCT core, core || CASE WHEN size % 3 = 0 THEN ' with ' || lower(department) ELSE '' END AS name FROM cores),
rules AS (SELECT 'G ' || head AS concept, 'all' AS kind, head AS literal, head AS pattern FROM products UNION SELECT 'A ' || head, 'all', head, head FROM products
  UNION SELECT 'S ' || name, 'all', head, head FROM products WHERE len(family) = 4 UNION SELECT 'S ' || name, 'all', family, family FROM products WHERE len(family) = 4
  UNION SELECT 'A ' || head, 'any', family, family FROM products WHERE len(family) IN (4, 5)
  UNION SELECT 'G ' || head, 'none', 'ea', '[a-z]*ear' FROM products WHERE len(head) = 4 UNION SELECT 'G ' || head, 'none', 'mall', 'mall' FROM products WHERE len(head) = 3
  UNION SELECT 'G ' || head, 'none', 'idget', 'idget' FROM products),
about AS (SELECT concept, bool_or(starts_with(concept, 'A ')) AS whole, split_part(any_value(concept), ' ', 2) AS head, coalesce(list(pattern) FILTER (kind = 'all'), []) AS al, coalesce(list(pattern) FILTER (kind = 'any'), []) AS an,
  count(*) FILTER (kind = 'all') AS want_all, count(*) FILTER (kind = 'any') AS want_any FROM rules GROUP BY concept),
counted AS (SELECT t.name, t.core, r.concept, count(*) FILTER (kind = 'all') AS n_all, count(*) FILTER (kind = 'any') AS n_any, count(*) FILTER (kind = 'none') AS n_none FROM texts t JOIN rules r
  ON regexp_matches(CASE WHEN kind = 'none' OR starts_with(concept, 'A ') THEN name ELSE core END, CASE WHEN literal = pattern THEN '(^|[^a-z])[bcs]?' ELSE '' END || pattern) GROUP BY ALL),
taken AS (SELECT name, a.*, CASE WHEN whole THEN name ELSE core END AS t FROM counted c JOIN about a USING (concept) WHERE n_none = 0 AND n_all = want_all AND (want_any = 0 OR n_any > 0)),
h AS (SELECT name, concept, al, an FROM taken WHERE CASE len(head) % 3
    WHEN 0 THEN NOT ((contains(t, 'gizmo') AND head <> 'red') OR (contains(t, 'ring') AND NOT list_contains(al, 'ring')))
    WHEN 1 THEN contains(t, 'gizmo') OR contains(t, 'ring') OR NOT (contains(t, 'rod') OR contains(t, 'gear')) ELSE true END
  AND (NOT contains(name, 'olt') OR head = 'hot') AND NOT (contains(name, 'nvil') AND head IN ('cold', 'new'))),
r AS (SELECT a.name, a.concept, count(*) FILTER (a.concept <> b.concept AND NOT (list_has_all(a.al, b.al) AND len(a.al) > len(b.al) AND (len(b.an) = 0 OR list_has_any(b.an, a.al) OR (len(a.an) > 0 AND list_has_all(b.an, a.an))))) AS open FROM h a JOIN h b USING (name) GROUP BY ALL),
w AS (SELECT *, min(open) OVER (PARTITION BY name) AS least FROM r)"""


@query("j13_class_matcher", f"WITH {LABELLED} SELECT name, concept FROM w WHERE open = 0 OR least > 0")
def j13_class_matcher(spark, sf_dir):
    """The products' labels (some with an attached letter, some with a flavour) and their classes, by rules over the products' own words."""
    p = products(spark, sf_dir)
    attached = F.concat(F.when(F.col("size") % 4 == 1, "b").otherwise(""), "name")
    labels = p.select(F.concat(attached, F.when(F.col("size") % 3 == 0, F.concat(F.lit(" with "), F.lower("department"))).otherwise("")).alias("name"))
    four = p.filter("length(family) = 4")
    head, family = F.col("head"), F.col("family")
    row = lambda x, sign, key, kind, literal, pattern: x.select(F.concat(F.lit(sign), key).alias("concept"), F.lit(kind).alias("kind"), literal.alias("literal"), pattern.alias("pattern"))
    parts = [
        row(p, "G ", "head", "all", head, head), row(p, "A ", "head", "all", head, head), row(four, "S ", "name", "all", head, head), row(four, "S ", "name", "all", family, family),
        row(p.filter("length(family) IN (4, 5)"), "A ", "head", "any", family, family), row(p.filter("length(head) = 4"), "G ", "head", "none", F.lit("ea"), F.lit("[a-z]*ear")),
        row(p.filter("length(head) = 3"), "G ", "head", "none", F.lit("mall"), F.lit("mall")), row(p, "G ", "head", "none", F.lit("idget"), F.lit("idget")),
    ]
    rules = parts[0]
    for part in parts[1:]:
        rules = rules.unionByName(part)
    of, n = F.split("concept", " ")[1], F.length(F.split("concept", " ")[1]) % 3
    classes = rules.select("concept").distinct().select(
        "concept", F.col("concept").startswith("A ").alias("whole"), F.when(n == 0, "fresh").when(n == 1, "processed").otherwise("any").alias("kind"), (of == "hot").alias("animals"),
        of.isin("cold", "new").alias("vegan_scope"), F.when(of == "red", F.array(F.lit("gizmo"))).otherwise(F.array().cast("array<string>")).alias("exempt"),
    )
    return class_matches(labels, rules, classes, spark.createDataFrame(GUARD_WORDS, "group string, word string"), without_flavour(F.col("name"), ["with"]), "a-z", "bcs")
