"""Names as keys: cleaning, stems, skeletons, units, markers, cores, codes in text, addresses, departments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_score, covers, percentage, similarity, text_key, tokens
from ..registry import query
from ..sources.market import OFFERS, PRODUCTS, offers, products, table
from .joins import first_reason

#: What text_key() does to Latin text, without look-behind: dots between digits are set aside first.
KEY = r"""trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\x{0591}-\x{05C7}"''`\x{05F3}\x{05F4}]', '', 'g'), '[^\p{L}\p{N}%.]+', ' ', 'g'), '(\p{N})\.(\p{N})', '\1@\2', 'g'), '(\p{N})\.(\p{N})', '\1@\2', 'g'), '.', ' '), '@', '.'), ' +', ' ', 'g'))"""


@query("f01_text_key", f"SELECT doc_id, md5({KEY}) AS key_md5, len({KEY})::INT AS key_length FROM documents WHERE text IS NOT NULL")
def f01_text_key(spark, sf_dir):
    """The key of every whole document."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", text_key(F.col("text")).alias("k"))
    return d.select("doc_id", F.md5("k").alias("key_md5"), F.length("k").alias("key_length"))


def stemmed(key: Column, stop: list[str], suffixes: list[str], least: int = 3) -> Column:
    """Words of a key without stop words, each less the first of the suffixes that leaves ``least`` characters; stop words out again."""
    def stem(w: Column) -> Column:
        out = F.when(F.lit(False), w)
        for s in suffixes:
            out = out.when(w.endswith(s) & (F.length(w) >= len(s) + least), F.substring(w, 1, F.length(w) - len(s)))
        return out.otherwise(w)

    kept = lambda words: F.filter(words, lambda w: (w != "") & ~w.isin(*stop)) if stop else F.filter(words, lambda w: w != "")
    return kept(F.transform(kept(F.split(key, " ")), stem))


@query(
    "f02_stemmed_tokens",
    r"""WITH w AS (SELECT lang, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) AS w FROM documents),
s AS (SELECT lang, CASE WHEN w LIKE '%tion' AND len(w) >= 7 THEN w[:-5] WHEN w LIKE '%en' AND len(w) >= 5 THEN w[:-3] ELSE w END AS stem FROM w WHERE w NOT IN ('', 'the', 'and', 'of'))
SELECT lang, stem, count(*) AS n FROM s WHERE stem NOT IN ('', 'the', 'and', 'of') GROUP BY ALL""",
)
def f02_stemmed_tokens(spark, sf_dir):
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    d = table(spark, sf_dir, "documents").select("lang", F.explode(stemmed(key, ["the", "and", "of"], ["tion", "en"])).alias("stem"))
    return d.groupBy("lang", "stem").agg(F.count("*").alias("n"))


def skeleton(key: Column, drop: str = "וי") -> Column:
    """A key without two letters that are written or left out at will."""
    return F.translate(key, drop, "")


@query("f03_skeletons", "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) SELECT translate(w, 'ae', '') AS skeleton, count(*) AS n, min(w) AS first FROM w GROUP BY 1 HAVING count(*) > 1")
def f03_skeletons(spark, sf_dir):
    """Words that differ by the letters a and e alone."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return words.groupBy(skeleton(F.col("w"), "ae").alias("skeleton")).agg(F.count("*").alias("n"), F.min("w").alias("first")).filter("n > 1")


def display_name(name: Column) -> Column:
    """A name to show: no leading promotion word or marks, single spaces, no trailing quotes."""
    c = F.regexp_replace(name, r"^(?:(?i:sale|promo|new)[ :!-]+)", "")
    c = F.regexp_replace(c, r"^[*#.,!\- ]+", "")
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " ")), "[\"'`]+$", "")


@query(
    "f04_display_names",
    r"""SELECT conv_id, turn, md5(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(text, '^(?:(?i:sale|promo|new)[ :!-]+)', ''), '^[*#.,!\- ]+', ''), '[ \t\r\n]+', ' ', 'g')), '["''`]+$', '')) AS shown FROM conversations""",
)
def f04_display_names(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(display_name(F.col("text"))).alias("shown"))


def unit_key(unit: Column, spellings: dict[str, str]) -> Column:
    """A unit's one spelling: lower case, no dots or quotes, looked up in a table of spellings; others stay as they are."""
    c = F.trim(F.regexp_replace(F.lower(unit), "[.\"'״]", ""))
    pairs = [F.lit(x) for kv in spellings.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c) if pairs else c


@query("f05_units", f"WITH {PRODUCTS} SELECT CASE lower(department) WHEN 'economy' THEN 'pack' WHEN 'large' THEN 'kg' WHEN 'small' THEN 'g' ELSE lower(department) END AS unit, count(*) AS n FROM products GROUP BY 1")
def f05_units(spark, sf_dir):
    return products(spark, sf_dir).groupBy(unit_key(F.col("department"), {"economy": "pack", "large": "kg", "small": "g"}).alias("unit")).agg(F.count("*").alias("n"))


NAMES = "n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', -1) AS family FROM part)"


@query(
    "f08_name_similarity",
    f"""WITH {NAMES}, p AS (SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name) AS distance, 1 - levenshtein(a.name, b.name) / greatest(len(a.name), len(b.name)) AS ch FROM n a JOIN n b ON a.family = b.family AND a.name < b.name)
SELECT a, b, distance::INT AS distance, floor(ch * 1000 + 1e-6)::BIGINT AS char_score, floor((0.5 / 3 + 0.25 / 2 + 0.25 * ch) * 1000 + 1e-6)::BIGINT AS score FROM p""",
)
def f08_name_similarity(spark, sf_dir):
    """Edit distance, character score and similarity of distinct names that share their last word (thousandths)."""
    n = products(spark, sf_dir).select("name", "family").distinct()
    p = n.alias("x").join(n.alias("y"), "family").filter("x.name < y.name").select(F.col("x.name").alias("a"), F.col("y.name").alias("b"))
    a, b = F.col("a"), F.col("b")
    return p.select("a", "b", F.levenshtein(a, b).alias("distance"), F.floor(char_score(a, b) * 1000 + 1e-6).alias("char_score"), F.floor(similarity(a, b) * 1000 + 1e-6).alias("score"))


def unit_sizes(rows: DataFrame, buckets: DataFrame, most: int = 20000) -> DataFrame:
    """rows(chain, bucket, quantity, weighed, ...), buckets(chain, bucket, unit, counts, scale) -> size, size_unit, pack.

    A chain's own bucket wins over that of chain null. A counting bucket gives the pack's number, another an amount times its
    scale. Weighed rows, amounts of zero or less and those over ``most`` have no size.
    """
    own, any_ = buckets.filter("chain IS NOT NULL"), buckets.filter("chain IS NULL").drop("chain")
    cols = ["unit", "counts", "scale"]
    x = rows.join(own.select("chain", "bucket", F.struct(*cols).alias("_own")), ["chain", "bucket"], "left").join(any_.select("bucket", F.struct(*cols).alias("_any")), "bucket", "left")
    x = x.withColumn("_b", F.coalesce("_own", "_any"))
    amount = F.col("quantity") * F.col("_b.scale")
    fit = ~F.col("weighed") & ~F.col("_b.counts") & (amount > 0) & (amount <= most)
    out = x.withColumns({"size": F.when(fit, amount), "size_unit": F.when(fit, F.col("_b.unit")), "pack": F.when(~F.col("weighed") & F.col("_b.counts"), F.col("quantity"))})
    return out.drop("_own", "_any", "_b")


@query(
    "f10_unit_sizes",
    f"""WITH {OFFERS}, {PRODUCTS}, x AS (SELECT chain, gtin, size % 7 = 0 AS weighed, department AS b, size AS q FROM offers JOIN products USING (gtin)),
y AS (SELECT *, CASE WHEN b = 'LARGE' THEN CASE WHEN chain = 3 THEN 1 ELSE 1000 END WHEN b = 'MEDIUM' THEN 100 WHEN b = 'SMALL' THEN 1 END * q AS amount FROM x)
SELECT chain, gtin, CASE WHEN NOT weighed AND amount <= 20000 THEN amount END::BIGINT AS size, CASE WHEN NOT weighed AND amount <= 20000 THEN CASE WHEN b = 'MEDIUM' THEN 'ml' ELSE 'g' END END AS size_unit, CASE WHEN NOT weighed AND b = 'ECONOMY' THEN q END::BIGINT AS pack FROM y""",
)
def f10_unit_sizes(spark, sf_dir):
    buckets = spark.createDataFrame(
        [(None, "LARGE", "g", False, 1000), (3, "LARGE", "g", False, 1), (None, "MEDIUM", "ml", False, 100), (None, "SMALL", "g", False, 1), (None, "ECONOMY", None, True, 1)],
        "chain int, bucket string, unit string, counts boolean, scale long",
    )
    items = products(spark, sf_dir).select("gtin", F.col("department").alias("bucket"), F.col("size").cast("long").alias("quantity"), (F.col("size") % 7 == 0).alias("weighed"))
    return unit_sizes(offers(spark, sf_dir).select("chain", "gtin").join(items, "gtin"), buckets).select("chain", "gtin", "size", "size_unit", "pack")


def sizes_agree(a: Column, b: Column, pct: int = 25) -> Column:
    """Whether two sizes of one unit differ by no more than pct of the larger; null if either is."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * (100 - pct)


@query("f11_size_tolerance", f"WITH {PRODUCTS}, m AS (SELECT name, floor(median(size))::INT AS mid FROM products GROUP BY name) SELECT gtin, (greatest(size, mid) * 100 // least(size, mid))::BIGINT AS ratio, least(size, mid) * 100 >= greatest(size, mid) * 75 AS agrees FROM products JOIN m USING (name)")
def f11_size_tolerance(spark, sf_dir):
    """Each product's size against the middle one of its class (no pairs of products are made)."""
    p = products(spark, sf_dir).select("gtin", "name", "size")
    x = p.join(p.groupBy("name").agg(F.floor(F.median("size")).cast("int").alias("mid")), "name")
    return x.select("gtin", F.expr("greatest(size, mid) * 100 div least(size, mid)").alias("ratio"), sizes_agree(F.col("size"), F.col("mid")).alias("agrees"))


@query("f18_percentages", r"SELECT page_id, nullif(regexp_extract(html, '([0-9]+(?:\.[0-9]+)?) ?%', 1), '')::DOUBLE AS pct FROM pages")
def f18_percentages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", percentage(F.col("html")).alias("pct"))


@query(
    "f19_marker_signatures",
    f"""WITH {NAMES} SELECT name, concat_ws(',', CASE WHEN name LIKE 'cold%' THEN 'chilled' END, CASE WHEN regexp_matches(name, 'ring|rod') THEN 'metal' END, CASE WHEN regexp_matches(name, '^(red|blue)') THEN 'tinted' END) AS signature FROM n""",
)
def f19_marker_signatures(spark, sf_dir):
    """Which marker groups a distinct name belongs to, sorted: one column per group of the rule table, no join."""
    groups = {"metal": "ring|rod", "tinted": "^(red|blue)", "chilled": "^cold"}
    marks = F.array_compact(F.array(*[F.when(F.col("name").rlike(p), g) for g, p in sorted(groups.items())]))
    return products(spark, sf_dir).select("name").distinct().select("name", F.array_join(F.array_sort(marks), ",").alias("signature"))


def take_out(name: Column, words: list[str]) -> Column:
    """words of a vocabulary, the longest first, found in a name and blanked so that no part of one counts again -> struct(rest, found)."""
    longest = F.array(*[F.lit(w) for w in sorted(set(words), key=lambda w: (-len(w), w))])
    none = F.struct(F.concat(F.lit(" "), name, F.lit(" ")).alias("rest"), F.array().cast("array<string>").alias("found"))
    def step(acc: Column, w: Column) -> Column:
        hit = F.contains(acc["rest"], F.concat(F.lit(" "), w, F.lit(" ")))
        rest = F.when(hit, F.replace(acc["rest"], F.concat(F.lit(" "), w, F.lit(" ")), F.lit("  "))).otherwise(acc["rest"])
        return F.struct(rest.alias("rest"), F.when(hit, F.concat(acc["found"], F.array(w))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(longest, none, step, lambda acc: F.struct(F.trim(F.regexp_replace(acc["rest"], " +", " ")).alias("rest"), F.array_sort(acc["found"]).alias("found")))


@query(
    "f20_variants",
    f"""WITH {NAMES} SELECT name, trim(regexp_replace(regexp_replace(regexp_replace(' ' || name || ' ', ' red ring | cold ', '  '), ' (old|new) ', '  '), ' +', ' ', 'g')) AS rest,
  CASE WHEN name = 'red ring' THEN 'red ring' WHEN name LIKE 'cold %' THEN 'cold' WHEN name LIKE 'old %' THEN 'old' WHEN name LIKE 'new %' THEN 'new' WHEN name LIKE 'red %' THEN 'red' ELSE '' END AS variant FROM (SELECT * FROM n WHERE name NOT LIKE 'red %' OR name = 'red ring')
UNION ALL SELECT name, split_part(name, ' ', 2), 'red' FROM n WHERE name LIKE 'red %' AND name <> 'red ring'""",
)
def f20_variants(spark, sf_dir):
    """Variant words of distinct names; ``red ring`` counts once, and its ``red`` not again."""
    n = products(spark, sf_dir).select("name").distinct()
    return n.withColumn("v", take_out(F.col("name"), ["red ring", "red", "cold", "old", "new"])).select("name", "v.rest", F.array_join("v.found", ",").alias("variant"))


def without_flavour(name: Column, markers: list[str]) -> Column:
    """A name less each flavour marker and the word after it."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, rf"(?:^| )(?:{'|'.join(markers)}) [^ ]+", " "), " +", " "))


@query("f21_flavours", f"WITH {NAMES} SELECT name || ' with ' || family AS name, CASE WHEN name LIKE 'new %' THEN 'with ' || family ELSE name END AS plain FROM n")
def f21_flavours(spark, sf_dir):
    x = products(spark, sf_dir).select(F.concat("name", F.lit(" with "), "family").alias("name")).distinct()
    plain = F.when(F.col("name").startswith("new "), without_flavour(F.col("name"), ["new"])).otherwise(without_flavour(F.col("name"), ["with"]))
    return x.select("name", plain.alias("plain"))


@query("f34_core_names", f"WITH {NAMES} SELECT name, CASE WHEN split_part(name, ' ', 1) IN ('large', 'small') THEN family ELSE name END AS core FROM n")
def f34_core_names(spark, sf_dir):
    """Names less the words of packaging; a name of such words alone stays whole."""
    words = F.filter(F.split("name", " "), lambda w: ~w.isin("large", "small"))
    return products(spark, sf_dir).select("name").distinct().select("name", F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.col("name")).alias("core"))


@query("f22_without_maker", f"WITH {PRODUCTS} SELECT DISTINCT brand || ' ' || name || ' Ltd' AS name, brand AS maker, name || ' Ltd' AS plain FROM products")
def f22_without_maker(spark, sf_dir):
    """A maker's name goes from a product's, by literal text; not if fewer than two words would stay. Distinct pairs only."""
    x = products(spark, sf_dir).select(F.concat_ws(" ", "brand", "name", F.lit("Ltd")).alias("name"), F.col("brand").alias("maker")).distinct()
    rest = F.trim(F.regexp_replace(F.replace(F.concat(F.lit(" "), "name", F.lit(" ")), F.concat(F.lit(" "), "maker", F.lit(" ")), F.lit(" ")), " +", " "))
    return x.select("name", "maker", F.when(F.size(F.split(rest, " ")) >= 2, rest).otherwise(F.col("name")).alias("plain"))


@query("f29_clean_brands", "SELECT regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g') AS brand, count(*) AS n FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM part WHERE p_brand = 'Brand#1' HAVING count(*) > 0")
def f29_clean_brands(spark, sf_dir):
    """Brands in one spelling; fillers (here ``brand 1``) are none."""
    clean = F.trim(F.regexp_replace(F.lower("brand"), "[^a-z0-9]+", " "))
    return products(spark, sf_dir).groupBy(F.when(~clean.isin("brand 1", "", "unknown"), clean).alias("brand")).agg(F.count("*").alias("n"))


def attributes(name: Column, vocabulary: list[tuple[str, str, str, str | None]]) -> Column:
    """vocabulary of (key, value, pattern, negation) -> array of struct(key, value): a negation in the name rules its value out first."""
    made = [F.when(name.rlike(p) & (~name.rlike(no) if no else F.lit(True)), F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))) for k, v, p, no in vocabulary]
    return F.array_compact(F.array(*made))


@query(
    "f30_attributes",
    f"""WITH {PRODUCTS}, a AS (SELECT gtin, 'state' AS key, 'cold' AS value FROM products WHERE name LIKE 'cold %' AND family <> 'gear' UNION ALL SELECT gtin, 'state', 'hot' FROM products WHERE name LIKE 'hot %' UNION ALL SELECT gtin, 'colour', head FROM products WHERE head IN ('red', 'blue'))
SELECT key, value, count(*) AS n FROM a GROUP BY ALL""",
)
def f30_attributes(spark, sf_dir):
    """Attributes are worked out once for each distinct name."""
    words = [("state", "cold", "^cold ", " gear$"), ("state", "hot", "^hot ", None), ("colour", "red", "^red ", None), ("colour", "blue", "^blue ", None)]
    per = products(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"))
    return per.select(F.inline(attributes(F.col("name"), words)), "n").groupBy("key", "value").agg(F.sum("n").alias("n"))


@query("f33_size_text", f"WITH {PRODUCTS} SELECT gtin, CASE WHEN size % 10 = 0 THEN '6 x ' || size || ' g' WHEN size >= 30 THEN (size // 10) || '.' || (size % 10) || ' kg' ELSE size || ' g' END AS text FROM products")
def f33_size_text(spark, sf_dir):
    """Packs as count times size; amounts from 30 on in the next unit (tenths)."""
    s = F.col("size")
    text = F.when(s % 10 == 0, F.concat(F.lit("6 x "), s, F.lit(" g"))).when(s >= 30, F.format_string("%d.%d kg", F.floor(s / 10), s % 10)).otherwise(F.concat(s, F.lit(" g")))
    return products(spark, sf_dir).select("gtin", text.alias("text"))


@query("f31_fingerprints", f"WITH {PRODUCTS} SELECT department, sha256(string_agg(name, ',' ORDER BY name)) AS print FROM (SELECT DISTINCT department, name FROM products) GROUP BY 1")
def f31_fingerprints(spark, sf_dir):
    """A digest of each department's classes; a department has few."""
    d = products(spark, sf_dir).groupBy("department").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return d.select("department", F.sha2(F.array_join("names", ","), 256).alias("print"))


@query(
    "f27_class_tree",
    f"""WITH {PRODUCTS}, c AS (SELECT department, name, head, count(*) OVER (PARTITION BY department, head) AS k, min((len(name), name)) OVER (PARTITION BY department, head) AS m FROM (SELECT DISTINCT department, name, head FROM products))
SELECT department, name, CASE WHEN k >= 2 THEN head ELSE name END AS family, CASE WHEN k >= 2 THEN m[2] ELSE name END AS family_name FROM c""",
)
def f27_class_tree(spark, sf_dir):
    """Classes of one prefix in a department are a family, if two or more; it has its shortest class's name."""
    c = products(spark, sf_dir).select("department", "name", "head").distinct()
    fam = c.groupBy("department", "head").agg(F.count("*").alias("k"), F.min(F.struct(F.length("name").alias("l"), "name")).getField("name").alias("shortest"))
    x = c.join(fam, ["department", "head"])
    return x.select("department", "name", F.when(F.col("k") >= 2, F.col("head")).otherwise(F.col("name")).alias("family"), F.when(F.col("k") >= 2, F.col("shortest")).otherwise(F.col("name")).alias("family_name"))


@query(
    "f26_departments",
    f"""WITH {PRODUCTS} SELECT gtin, CASE WHEN gtin % 30 = 0 THEN 'reviewed' WHEN family = 'widget' AND department <> 'PROMO' THEN 'widgets' WHEN head = 'hot' THEN 'heat' WHEN regexp_matches(name, 'gear|bolt') AND head <> 'new' THEN 'parts' ELSE 'general' END AS department FROM products""",
)
def f26_departments(spark, sf_dir):
    """A reviewed label, else the class's department unless that is refused, else the first keyword rule, else general."""
    labels = products(spark, sf_dir).filter("gtin % 30 = 0").select("gtin", F.lit("reviewed").alias("label"))
    x = products(spark, sf_dir).join(labels, "gtin", "left")
    by_class = F.when((F.col("family") == "widget") & (F.col("department") != "PROMO"), "widgets")
    by_word = F.when(F.col("name").rlike("^hot "), "heat").when(F.col("name").rlike("gear|bolt") & ~F.col("name").rlike("^new "), "parts")
    return x.select("gtin", F.coalesce("label", by_class, by_word, F.lit("general")).alias("department"))


@query("f35_item_ids", f"WITH {OFFERS} SELECT chain, gtin, CASE WHEN chain % 3 = 0 THEN 'item-' || gtin || '-' || chain WHEN chain % 3 = 1 THEN lpad(gtin::VARCHAR, 13, '0') END AS item_id FROM offers")
def f35_item_ids(spark, sf_dir):
    """A storefront's item id by the chain's template; null where the chain has none."""
    templates = offers(spark, sf_dir).select("chain").distinct().withColumn("template", F.when(F.col("chain") % 3 == 0, "item-{code}-{chain}").when(F.col("chain") % 3 == 1, "{code13}"))
    made = F.replace(F.replace(F.replace("template", F.lit("{code}"), F.col("gtin").cast("string")), F.lit("{chain}"), F.col("chain").cast("string")), F.lit("{code13}"), F.lpad(F.col("gtin").cast("string"), 13, "0"))
    return offers(spark, sf_dir).select("chain", "gtin").join(templates, "chain").select("chain", "gtin", made.alias("item_id"))


@query("f40_text_to_embed", f"WITH {PRODUCTS} SELECT gtin, CASE WHEN gtin % 2 = 0 THEN name || ' ' || lower(brand) ELSE name || ' ' || brand || ' ' || name END AS text FROM products")
def f40_text_to_embed(spark, sf_dir):
    """The unified name and the longest chain name, unless one begins the other."""
    longest = F.when(F.col("gtin") % 2 == 0, F.concat_ws(" ", "name", F.lower("brand"))).otherwise(F.concat_ws(" ", "brand", "name"))
    x = products(spark, sf_dir).withColumn("longest", longest)
    text = F.when(F.col("longest").startswith(F.col("name")), F.col("longest")).when(F.col("name").startswith(F.col("longest")), F.col("name")).otherwise(F.concat_ws(" ", "name", "longest"))
    return x.select("gtin", text.alias("text"))


@query("f43_codes_in_text", r"WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{3,}')) AS code FROM documents) SELECT code, count(*) AS n, min(doc_id) AS first_doc FROM c GROUP BY code")
def f43_codes_in_text(spark, sf_dir):
    """Runs of three digits or more in whole texts, with the document that has one first."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{3,}"), F.lit(0))).alias("code"))
    return c.groupBy("code").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("f16_local_days", "SELECT ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Jerusalem')::DATE AS day, count(*) AS n FROM events GROUP BY 1")
def f16_local_days(spark, sf_dir):
    """Events by calendar day on the clock of the shops."""
    ts = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Jerusalem")
    return table(spark, sf_dir, "events").groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


@query("f15_price_dates", "SELECT l_orderkey AS cart, l_linenumber AS line, l_shipdate::DATE AS day FROM lineitem")
def f15_price_dates(spark, sf_dir):
    """The first ten characters of a stamp, if they are a date."""
    stamp = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00"))
    day = F.substring(stamp, 1, 10)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cart"), F.col("l_linenumber").alias("line"), F.try_to_date(day, "yyyy-MM-dd").alias("day"))


@query("f17_money", "SELECT l_returnflag AS flag, sum(round((l_extendedprice * 1000)::BIGINT / 10)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY 1")
def f17_money(spark, sf_dir):
    """Amounts to whole cents, halves up, by way of DECIMAL."""
    cents = (F.round(F.col("l_extendedprice").cast("decimal(18,4)"), 2) * 100).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum(cents).alias("cents"))


@query(
    "u08_covered_names",
    f"""WITH {NAMES} SELECT a.name AS a, b.name AS b, len(list_intersect(string_split(a.name, ' '), string_split(b.name, ' '))) AS shared, starts_with(a.name, 'old') AND starts_with(b.name, 'old') AS covered FROM n a JOIN n b ON a.family = b.family AND a.name < b.name""",
)
def u08_covered_names(spark, sf_dir):
    """Shared words of distinct names, and whether each word of one begins, or is begun by, a word of the other."""
    n = products(spark, sf_dir).select("name", "family").distinct()
    p = n.alias("x").join(n.alias("y"), "family").filter("x.name < y.name").select(F.col("x.name").alias("a"), F.col("y.name").alias("b"))
    ta, tb = tokens(F.col("a")), tokens(F.col("b"))
    return p.select("a", "b", F.size(F.array_intersect(ta, tb)).alias("shared"), (covers(ta, tb) & covers(tb, ta)).alias("covered"))


@query("u05_marker_sets", f"WITH {PRODUCTS}, m AS (SELECT name, list_sort(list(DISTINCT department)) AS s FROM products GROUP BY name) SELECT len(s) AS n_departments, count(*) AS n, count(*) FILTER (list_contains(s, 'PROMO') AND list_contains(s, 'LARGE')) AS n_superset FROM m GROUP BY 1")
def u05_marker_sets(spark, sf_dir):
    """Classes by the number of departments they stand in, and how many hold two given ones."""
    m = products(spark, sf_dir).groupBy("name").agg(F.collect_set("department").alias("s"))
    holds = F.size(F.array_except(F.array(F.lit("PROMO"), F.lit("LARGE")), "s")) == 0
    return m.groupBy(F.size("s").alias("n_departments")).agg(F.count("*").alias("n"), F.count_if(holds).alias("n_superset"))


@query(
    "f28_addresses",
    """SELECT c_custkey AS customer, n_name AS city FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def f28_addresses(spark, sf_dir):
    """The city of a free-text address: its last part that names one, the longest alias where several fit. Parts meet aliases by equality."""
    nation = table(spark, sf_dir, "nation")
    aliases = nation.select(F.lower("n_name").alias("alias"), F.col("n_name").alias("city")).unionByName(nation.select(F.concat(F.lower("n_name"), F.lit(" city")).alias("alias"), F.col("n_name").alias("city")))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    address = F.concat("c_name", F.lit(" st, "), "n_name", F.when(F.col("c_custkey") % 2 == 0, " City").otherwise(""))
    parts = c.select(F.col("c_custkey").alias("customer"), F.posexplode(F.split(F.lower(address), ", *")).alias("pos", "alias"))
    found = parts.join(aliases, "alias").groupBy("customer").agg(F.max(F.struct("pos", F.length("alias").alias("l"), "city")).alias("x"))
    return found.select("customer", "x.city")
