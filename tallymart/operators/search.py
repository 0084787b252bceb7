"""Search beside BM25: identifiers kept whole, cosine, filtered retrieval, proposals from neighbours, label truth."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.market import PRODUCTS, products, table
from .retrieval import BM25, NEAR, VOTES, asked_and_docs, asked_terms, best_sums, bm25_parts, label_votes, nearest


def index_tokens(text: Column) -> Column:
    """Words, and dotted numbers and hyphenated names both whole and in their parts."""
    whole = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))
    return F.flatten(F.transform(whole, lambda w: F.when(w.rlike("[.-]"), F.concat(F.array(w), F.split(w, "[.-]"))).otherwise(F.array(w))))


@query(
    "r03_index_tokens",
    r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(html), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS w FROM pages), t AS (SELECT w AS token FROM w UNION ALL SELECT unnest(regexp_split_to_array(w, '[.-]')) FROM w WHERE regexp_matches(w, '[.-]'))
SELECT token, count(*) AS n FROM t GROUP BY token""",
)
def r03_index_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.explode(index_tokens(F.col("html"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double, null for a zero vector; in the JVM."""
    d = lambda v: v.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda t, z: t + z)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


@query(
    "r07_cosine_to_centre",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM x GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(v, c), 6) AS sim FROM e JOIN c USING (label)""",
)
def r07_cosine_to_centre(spark, sf_dir):
    """Each vector's cosine to the mean of its label's; labels are few, their means have 64 numbers."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return e.join(centres, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("c")), 6).alias("sim"))


@query(
    "r08_filtered_retrieval",
    f"WITH {BM25} SELECT q, doc_id, round(score, 6) AS score FROM bm JOIN documents USING (doc_id) WHERE regexp_matches(source, '[02468]$') QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc_id) <= 5",
)
def r08_filtered_retrieval(spark, sf_dir):
    """The five best documents of the sources that a pattern admits; scores use the statistics of all documents."""
    docs, questions = asked_and_docs(spark, sf_dir)
    admitted = table(spark, sf_dir, "documents").filter(F.col("source").rlike("[02468]$")).select("doc_id")
    asked = asked_terms(questions)
    parts = bm25_parts(docs, asked).join(admitted, "doc_id", "left_semi")
    return best_sums(asked, parts, 5).select("q", "doc_id", "score")


@query("o03_search_order", f"WITH {PRODUCTS}, s AS (SELECT gtin, name, CASE WHEN name = 'red ring' THEN 3 WHEN starts_with(name, 'red') THEN 2 WHEN contains(name, 'ring') THEN 1 END AS score FROM products) SELECT gtin, name, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, name, gtin LIMIT 30")
def o03_search_order(spark, sf_dir):
    """The thirty results of one search, best first: an exact name, a first word, a word."""
    name = F.col("name")
    score = F.when(name == "red ring", 3).when(name.startswith("red"), 2).when(name.contains("ring"), 1)
    s = products(spark, sf_dir).select("gtin", "name", score.alias("score")).filter("score IS NOT NULL")
    return s.orderBy(F.col("score").desc(), "name", "gtin").limit(30)


@query(
    "r13_proposals",
    f"""WITH {VOTES} SELECT q, w.label, confidence, w.label = e.label AS accepted FROM won w JOIN embeddings e ON e.vec_id = w.q WHERE confidence >= 0.2""",
)
def r13_proposals(spark, sf_dir):
    """Labels that neighbours propose with enough confidence, and whether the row's own label agrees."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("q"), F.col("label").alias("own"))
    x = label_votes(nearest(spark, sf_dir)).filter("confidence >= 0.2").join(own, "q")
    return x.select("q", "label", "confidence", (F.col("label") == F.col("own")).alias("accepted"))


@query(
    "r14_cross_class",
    f"""WITH {NEAR} SELECT n.q, n.vec_id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY n.q ORDER BY n.place) AS nth FROM near n JOIN embeddings e ON e.vec_id = n.q WHERE n.label <> e.label QUALIFY nth <= 5""",
)
def r14_cross_class(spark, sf_dir):
    """The nearest neighbours of another label."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("q"), F.col("label").alias("own"))
    w = Window.partitionBy("q").orderBy("place")
    x = nearest(spark, sf_dir).join(own, "q").filter("label <> own").withColumn("nth", F.row_number().over(w)).filter("nth <= 5")
    return x.select("q", "vec_id", F.round("sim", 6).alias("sim"), "nth")


@query(
    "r15_label_truth",
    "SELECT d.doc_id, CASE WHEN d.doc_id % 12 = 0 THEN 'verified' WHEN l.quality IS NOT NULL THEN 'q' || l.quality ELSE d.lang END AS truth, CASE WHEN d.doc_id % 12 = 0 THEN 'record' WHEN l.quality IS NOT NULL THEN 'label' WHEN d.lang IS NOT NULL THEN 'field' END AS source FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def r15_label_truth(spark, sf_dir):
    """A verified record before a reviewed label before the row's own field."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    records = d.filter("doc_id % 12 = 0").select("doc_id", F.lit("verified").alias("record"))
    x = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").join(records, "doc_id", "left")
    label = F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), "quality"))
    source = F.when(F.col("record").isNotNull(), "record").when(label.isNotNull(), "label").when(F.col("lang").isNotNull(), "field")
    return x.select("doc_id", F.coalesce("record", label, "lang").alias("truth"), source.alias("source"))
