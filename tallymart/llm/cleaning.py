"""Quality rules, line first: lines that fail a rule go, then documents that lost too much, in DataFrame functions only.

Every line with a word is judged by three groups of rules, the first that it fails is its reason:

- ``navigation``: two words or more that are separators (``|``, bullets, arrows), at least one in five; or at most six
  words, no closing mark at the end and a word of a menu (``home``, ``login``, ``next`` ...);
- ``boilerplate``: at most 40 words with a phrase of licences, notices or page furniture (``all rights reserved`` ...);
- ``punctuation``: symbols (``#*$%&|<>``) at least three and one for three words; two words or more, one in five, that end in ``!!`` or ``??``;
  no letter or digit at all; five words or more in capitals only; or three words or more, under 20, without a closing mark at
  the end.

Lines without a word are neutral and stay. A document is kept if it passes the base rules (50 words or more, at most half of
them in three-word windows that occur twice in it) and the failing lines hold at most ``max_lost`` percent of its words.

Null text has no words and stays null; null and empty text fail the base. Each row is judged by itself: repeated rows get the
same result, ids play no part, an empty table gives no rows, columns of any name pass through ``cleaned``. A text of any length
is one row's arrays: windows are 64-bit hashes, sorted only where some repeat, so that the work grows with its words (times their
logarithm), and nothing is shuffled.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let, table

SIGN, MAX_LOST, MIN_WORDS, MAX_REPEATED = "[#*$%&|<>]", 30, 50, 50
REASONS = ["navigation", "boilerplate", "punctuation"]
#: Words and phrases of menus, phrases of notices, separators, closing marks.
MENU_WORDS = ["home", "menu", "login", "register", "search", "next", "previous", "sitemap", "share", "reply"]
MENU = r"(?i)(log in|sign in|sign up|read more|back to top|contact us|about us)"
NOTICE = [
    "all rights reserved", "copyright", "©", "licensed under", "released under", "privacy policy", "terms of use", "terms of service", "cookie",
    "enable javascript", "subscribe to", "newsletter", "lorem ipsum", "powered by", "click here", "creative commons", "general public license",
]
ALONE = ["|", "||", "/", "•", "·", "»", "›", "→", ">", ">>"]
CLOSING = [*".!?…。！？:;,)]\"'”’»"]


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)


def judged(line: Column) -> Column:
    """A line (body, words, signs) -> body, the number of its words, reason (null for a line that stays)."""
    body, ws = line["body"], line["words"]
    words = F.size(ws)
    doubled = F.size(F.filter(ws, lambda w: F.endswith(w, F.lit("!!")) | F.endswith(w, F.lit("??"))))
    alone = F.size(F.filter(ws, lambda w: w.isin(ALONE)))
    closed = F.right(F.get(ws, words - 1), F.lit(1)).isin(CLOSING)
    menu = F.exists(ws, lambda w: F.lower(w).isin(MENU_WORDS)) | body.rlike(MENU)
    notice = let(F.lower(body), lambda x: any_of([F.contains(x, F.lit(p)) for p in NOTICE]))
    why = (
        F.when(words == 0, None)
        .when(let(alone, lambda n: (n >= 2) & (5 * n >= words)) | (words <= 6) & ~closed & menu, "navigation")
        .when((words <= 40) & notice, "boilerplate")
        .when((line["signs"] >= 3) & (3 * line["signs"] >= words) | let(doubled, lambda n: (n >= 2) & (5 * n >= words)), "punctuation")
        .when(~body.rlike(r"[\p{L}\p{N}]") | (words >= 5) & body.rlike(r"\p{Lu}") & ~body.rlike(r"\p{Ll}"), "punctuation")
        .when((words >= 3) & (words < 20) & ~closed, "punctuation")
    )
    return F.struct(body.alias("body"), words.alias("words"), why.alias("reason"))


def repeated_words(rows: DataFrame, words: str) -> DataFrame:
    """rows with an array of words -> in its place n_repeat_words: words in three-word windows that occur twice or more.

    A column a step, so that each array is made once: the windows' hashes, whether any repeats, the places of those that do.
    """
    n = F.size(words)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.get(words, i)
    rows = rows.withColumn("_tm_h", F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))).drop(words)
    some = F.size(F.array_distinct("_tm_h")) < F.size("_tm_h")
    rows = rows.withColumn("_tm_s", F.when(some, F.sort_array(F.transform("_tm_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_tm_h")
    at = lambda i: F.get("_tm_s", i)["h"]
    twice = F.filter("_tm_s", lambda x, i: F.coalesce(x["h"] == at(i - 1), F.lit(False)) | F.coalesce(x["h"] == at(i + 1), F.lit(False)))
    rows = rows.withColumn("_tm_p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_tm_s")
    covered = F.transform("_tm_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_tm_p", i + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_tm_p")


def measured(docs: DataFrame, keep_lines: bool = False) -> DataFrame:
    """docs with text -> instead of it n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the number of failing lines by
    reason, n_lost_words (words in them); and _tm_lines, the lines as judged, if they are to be kept."""
    text = F.coalesce("text", F.lit(""))
    line = lambda x: F.struct(x.alias("body"), F.array_remove(F.split(x, WHITE), "").alias("words"), F.regexp_count(x, F.lit(SIGN)).alias("signs"))
    rows = docs.withColumn("_tm_lines", F.transform(F.split(text, "\n"), line))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumns(
        {"_tm_words": F.flatten(F.col("_tm_lines.words")), "n_symbols": total(F.col("_tm_lines.signs")), "_tm_lines": F.transform("_tm_lines", judged)}
    )
    # The measures of the lines are taken here, so that neither lines nor text travel through the steps of the windows unless asked for.
    own = F.filter("_tm_lines", lambda x: x["words"] > 0)
    failing = lambda why: F.size(F.filter("_tm_lines", lambda x: x["reason"] == why)).cast("long")
    rows = rows.withColumns({
        "n_words": F.size("_tm_words").cast("long"),
        "word_chars": F.length(F.array_join("_tm_words", "")).cast("long"),
        "n_dup_lines": let(F.transform(own, lambda x: x["body"]), lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
        "n_lost_words": total(F.transform(F.filter("_tm_lines", lambda x: x["reason"].isNotNull()), lambda x: x["words"])),
        **{f"n_{why}": failing(why) for why in REASONS},
    })
    rows = rows.drop("text") if keep_lines else rows.drop("text", "_tm_lines")
    rows = repeated_words(rows, "_tm_words")
    # A generator, through which Spark moves no filter: moved down, one on a measure would hold all the steps above in one expression,
    # each array made again for each of its elements.
    return rows.select(F.inline_outer(F.array(F.struct(*rows.columns))))


def verdicts(rows: DataFrame, max_lost: int = MAX_LOST) -> DataFrame:
    """Of measured rows: base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("n_lost_words") <= max_lost * F.col("n_words")))


def cleaned(docs: DataFrame, max_lost: int = MAX_LOST) -> DataFrame:
    """The documents kept, their text without the lines that failed; other columns as they are."""
    # Columns of any name pass: the measures are taken beside the document, which travels as one struct.
    rows = verdicts(measured(docs.select(F.struct(*docs.columns).alias("_tm_doc"), F.col("text")), True), max_lost).filter("kept")
    left = F.array_join(F.transform(F.filter("_tm_lines", lambda x: x["reason"].isNull()), lambda x: x["body"]), "\n")
    return rows.select(*[left.alias("text") if c == "text" else F.col("_tm_doc")[c].alias(c) for c in docs.columns])


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = verdicts(measured(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[f"n_{why}" for why in REASONS], "n_lost_words"
    )


def sql_text(s: str) -> str:
    return s.replace("'", "''")


def sql_list(xs: list[str]) -> str:
    return ", ".join(f"'{sql_text(x)}'" for x in xs)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
c AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM k, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS body FROM d),
n AS (SELECT r, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws FROM l),
m AS (SELECT r, body, len(ws) AS words, len(body) - len(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS signs,
             len(list_filter(ws, lambda w: ends_with(w, '!!') OR ends_with(w, '??'))) AS doubled, len(list_filter(ws, lambda w: w IN ({sql_list(ALONE)}))) AS alone,
             right(ws[len(ws)], 1) IN ({sql_list(CLOSING)}) AS closed,
             len(list_filter(ws, lambda w: lower(w) IN ({sql_list(MENU_WORDS)}))) > 0 OR regexp_matches(body, '{sql_text(MENU)}') AS menu FROM n),
v AS (SELECT r, body, words, CASE WHEN words = 0 THEN NULL
               WHEN alone >= 2 AND 5 * alone >= words OR words <= 6 AND NOT closed AND menu THEN 'navigation'
               WHEN words <= 40 AND len(list_filter([{sql_list(NOTICE)}], lambda p: contains(lower(body), p))) > 0 THEN 'boilerplate'
               WHEN signs >= 3 AND 3 * signs >= words OR doubled >= 2 AND 5 * doubled >= words OR NOT regexp_matches(body, '[\p{{L}}\p{{N}}]')
                 OR words >= 5 AND regexp_matches(body, '\p{{Lu}}') AND NOT regexp_matches(body, '\p{{Ll}}') OR words BETWEEN 3 AND 19 AND NOT closed THEN 'punctuation' END AS reason FROM m),
s AS (SELECT r, count(*) FILTER (words > 0) - count(DISTINCT body) FILTER (words > 0) AS n_dup_lines, coalesce(sum(words) FILTER (reason IS NOT NULL), 0)::BIGINT AS n_lost_words,
             count(*) FILTER (reason = 'navigation') AS n_navigation, count(*) FILTER (reason = 'boilerplate') AS n_boilerplate, count(*) FILTER (reason = 'punctuation') AS n_punctuation
      FROM v GROUP BY r),
a AS (SELECT doc_id, len(ws) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_navigation, n_boilerplate, n_punctuation, n_lost_words FROM w LEFT JOIN s USING (r) LEFT JOIN c USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * n_lost_words <= {MAX_LOST} * n_words AS kept FROM a
"""
