"""Quotation linking: conversations in reply order and without quotes, in DataFrame functions only.

A line's quote level is its number of leading `>` (spaces between them don't count). The lines of level 0 are a
message's own words, the others are quoted: level 1 from the message it answers, level 2 from what that one answered,
and so on. Lines are normalised (lower case, runs of signs other than letters and digits as one space). Neighbouring lines of
one level are a passage; lines without a letter or digit end one. Passages are hashed, and a quoted one is linked to the own
passage of equal hash and text; where none has it, as people quote parts and answer in between, its lines are linked one by one to own
lines, in a passage or not. A link goes to the latest earlier message of the conversation that has the passage or line; if
none has, to the first message (by conv_id, then turn) of all other conversations that has it.

A message replies to the earlier message that most of its level-1 lines come from, the latest of equal ones; without
such lines to the message before it; the first message to none. Reply order is by the turn of the message replied to,
then by turn, so that each message follows the one it answers and replies to the same message stand together. ``position``
is a message's place in it, from 1.

Null text has no lines and gives an empty text; lines without a letter or digit are never linked, but quoted ones are
dropped. A message is known by conv_id and turn; equal rows of one message count once, the lines of others are put together. Where
one of the two is null, each row with another role or text is a message of its own. A null conv_id is a conversation of its own;
messages with a null turn come first in theirs. An empty table gives no rows. Other columns, of whatever name, play no part. A text of
any length is one row, its lines are arrays made once.

The message before and the place in reply order come from sums over ranges of all messages in order. Quoted and own lines of a
conversation meet in a running maximum by line over buckets of 64 turns, never as pairs. The first place of a line over
all conversations, and the first in another conversation than that, are minima, combined before the shuffle and written, so that
adaptive execution splits the join of a line that a third of all messages have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import before, let, table, written

QUOTE = r"^[ \t]*((>[ \t]*)*)"
BUCKET = 64
#: What a message is known by: part tells rows without conv or turn apart.
MESSAGE = ["conv", "turn", "part"]


def parsed(text: Column) -> Column:
    """(level, body, plain) of each line; plain is null for lines without letters or digits."""

    def line(x):
        marks = F.regexp_extract(x, QUOTE, 1)
        plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(x, QUOTE, "")), r"[^\p{L}\p{N}]+", " "))
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), x.alias("body"), F.when(plain != "", plain).alias("plain"))

    return F.transform(F.split(text, "\n"), line)


def passages(lines: str) -> Column:
    """Of a column of parsed lines: (level, parts) of each run of neighbouring lines of one level, parts being the normalised lines."""
    at = lambda i: F.get(lines, i)
    cut = lambda i, j: at(j).isNull() | at(j)["plain"].isNull() | (at(j)["level"] != at(i)["level"])
    places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: at(i)["plain"].isNotNull())
    ends = lambda step: F.filter(places, lambda i: cut(i, i + step))
    run = lambda a, b: F.struct(at(a)["level"].alias("level"), F.transform(F.slice(lines, a + 1, b - a + 1), lambda x: x["plain"]).alias("parts"))
    return F.zip_with(ends(-1), ends(1), run)


def previous_turns(messages: DataFrame) -> DataFrame:
    """messages(conv, turn, part), one row each -> also before, the turn of the message before (null for the first)."""
    m = messages.select(*MESSAGE, F.floor(F.col("turn") / BUCKET).alias("bucket"))
    lasts = m.groupBy("conv", "bucket").agg(F.max("turn").alias("last"))
    carried = lasts.select("conv", "bucket", F.lag("last").over(Window.partitionBy("conv").orderBy("bucket")).alias("carried"))
    inside = m.withColumn("lag", F.lag("turn").over(Window.partitionBy("conv", "bucket").orderBy("turn", "part")))
    joined = inside.alias("m").join(written(carried).alias("c"), F.col("m.conv").eqNullSafe(F.col("c.conv")) & F.col("m.bucket").eqNullSafe(F.col("c.bucket")))
    return joined.select(*[f"m.{x}" for x in MESSAGE], F.coalesce("lag", "carried").alias("before"))


def units_of(base: DataFrame) -> DataFrame:
    """Passages, and the lines of those of several lines: MESSAGE, level, unit (the text), whole (the passage's), loose (a line), n (lines)."""
    runs = base.select(*MESSAGE, F.inline(passages("lines")))
    whole = F.array_join("parts", "\n")
    one = lambda unit, loose, n: F.struct(unit.alias("unit"), F.lit(loose).alias("loose"), F.lit(n).cast("long").alias("n"))
    lines = F.when(F.size("parts") > 1, F.transform("parts", lambda x: one(x, True, 1))).otherwise(F.array().cast("array<struct<unit:string,loose:boolean,n:bigint>>"))
    runs = runs.select(*MESSAGE, "level", F.xxhash64(whole).alias("whole"), F.concat(F.array(one(whole, False, F.size("parts"))), lines).alias("units"))
    return runs.select(*MESSAGE, "level", "whole", F.inline("units")).withColumn("key", F.xxhash64("unit"))


def linked(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages, and links (MESSAGE, level, from_conv, from_turn, n_lines): where quoted lines come from."""
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    part = F.when(F.col("conv").isNull() | F.col("turn").isNull(), F.xxhash64("role", "text")).otherwise(0)
    base = written(
        rows.groupBy("conv", "turn", part.alias("part")).agg(F.array_sort(F.collect_set(F.struct("role", "text"))).alias("parts"))
        .select(*MESSAGE, F.get("parts", F.lit(0))["role"].alias("role"), F.array_join(F.col("parts.text"), "\n").alias("text"))
        .withColumn("lines", parsed(F.col("text")))
    )
    units = written(units_of(base))
    same = ["key", "unit"]
    quoted = written(units.filter("level > 0").groupBy(*MESSAGE, "level", *same, "whole", "loose").agg(F.sum("n").alias("n")))
    own = units.filter("level = 0").join(written(quoted.select(*same).distinct()), same, "left_semi").select("conv", "turn", *same).distinct()
    own = written(own)
    both = quoted.unionByName(own, allowMissingColumns=True).withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    said = F.when(F.col("level").isNull(), F.col("turn"))
    lasts = both.groupBy("conv", *same, "bucket").agg(F.max(said).alias("last"))
    past = Window.partitionBy("conv", *same).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whose = [F.col(c).alias(f"_{c}") for c in ("conv", *same, "bucket")]
    lasts = written(lasts.select(*whose, F.max("last").over(past).alias("carried")).filter("carried IS NOT NULL"))
    latest = Window.partitionBy("conv", *same, "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    inside = written(both.withColumn("near", F.max(said).over(latest)).filter("level IS NOT NULL"))
    inside = inside.join(lasts, [F.col("conv").eqNullSafe(F.col("_conv")), *[F.col(c) == F.col(f"_{c}") for c in (*same, "bucket")]], "left")
    inside = inside.select(*MESSAGE, "level", *same, "whole", "loose", "n", F.when(F.col("turn").isNotNull(), F.coalesce("near", "carried")).alias("from_turn"))
    inside = written(inside)
    # The first place of all, and the first in another conversation than that: one of the two lies outside any given conversation.
    place = F.min(F.struct("conv", "turn"))
    first = written(own.groupBy(*same).agg(place.alias("first")))
    second = own.join(first, same).filter(~F.col("conv").eqNullSafe(F.col("first.conv"))).groupBy(*same).agg(place.alias("second"))
    anywhere = written(first.join(second, same, "left"))
    chosen = F.when(F.col("first.conv").eqNullSafe(F.col("conv")), F.col("second")).otherwise(F.col("first"))
    other = inside.filter("from_turn IS NULL").drop("from_turn").join(anywhere, same).withColumn("from", chosen).filter("from IS NOT NULL")
    names = [*MESSAGE, "level", "whole", "loose", "n"]
    links = inside.filter("from_turn IS NOT NULL").select(*names, F.col("conv").alias("from_conv"), "from_turn").unionByName(
        other.select(*names, F.col("from.conv").alias("from_conv"), F.col("from.turn").alias("from_turn"))
    )
    links = written(links)
    # Lines speak only where their passage as a whole found nothing.
    told = links.filter("NOT loose").select(*[F.col(c).alias(f"_{c}") for c in (*MESSAGE, "level", "whole")]).distinct()
    lines = links.filter("loose").join(told, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*MESSAGE, "level", "whole")], "left_anti")
    return base, links.filter("NOT loose").unionByName(lines).groupBy(*MESSAGE, "level", "from_conv", "from_turn").agg(F.sum("n").alias("n_lines"))


def placed(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, order_key) -> also position: the place in the conversation by order_key, from 1."""
    ranked = before(messages.withColumn("_one", F.lit(1)), [F.col("conv_id"), F.col("order_key")], _rank="_one").drop("_one")
    ranked = written(ranked)
    first = written(ranked.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_rank").alias("_first")))
    out = ranked.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return out.withColumn("position", (F.col("_rank") - F.col("_first") + 1).cast("long")).drop("_conv", "_rank", "_first")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to (turn), reply_conv, n_quoted, n_linked, text without quotes, order_key (reply_to, turn), position."""
    base, links = linked(conversations)
    links = written(links)
    best = (
        links.filter("level = 1").groupBy(*MESSAGE)
        .agg(F.max(F.struct((F.col("conv").eqNullSafe(F.col("from_conv"))).alias("inside"), "n_lines", "from_turn", "from_conv")).alias("best"))
        .select(*[F.col(c).alias(f"b_{c}") for c in MESSAGE], "best")
    )
    found = links.groupBy(*[F.col(c).alias(f"l_{c}") for c in MESSAGE]).agg(F.sum("n_lines").alias("n_linked"))
    earlier = previous_turns(base).select(*[F.col(c).alias(f"p_{c}") for c in MESSAGE], "before")
    same = lambda a: [F.col(c).eqNullSafe(F.col(f"{a}_{c}")) for c in MESSAGE]
    out = base.join(earlier, same("p"), "left").join(best, same("b"), "left").join(found, same("l"), "left")
    inside = F.col("best.inside")
    reply = F.when(F.col("best").isNull(), F.col("before")).otherwise(F.col("best.from_turn"))
    own = let(F.col("lines"), lambda ls: F.transform(F.filter(ls, lambda x: x["level"] == 0), lambda x: x["body"]))
    out = out.select(
        F.col("conv").alias("conv_id"), "turn", "role",
        reply.alias("reply_to"),
        F.when(F.col("best").isNull(), F.when(F.col("before").isNotNull(), F.col("conv"))).otherwise(F.col("best.from_conv")).alias("reply_conv"),
        F.when(F.col("best").isNull(), F.when(F.col("before").isNull(), "first").otherwise("previous")).otherwise(F.when(inside, "quoted").otherwise("quoted elsewhere")).alias("reply_kind"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.trim(F.array_join(own, "\n")).alias("text"),
        F.struct(F.when(F.col("best").isNull() | inside, reply).alias("reply_to"), "turn").alias("order_key"),
    )
    return placed(written(out))


def op2_quotes(spark, sf_dir: str) -> DataFrame:
    out = reply_ordered(table(spark, sf_dir, "conversations"))
    more = {"n_chars": F.length("text").cast("long"), "text_sha256": F.sha2("text", 256)}
    return out.withColumns(more).drop("order_key")


ORACLE = r"""
WITH m AS (SELECT conv_id, turn, coalesce((list_sort(list(DISTINCT (coalesce(role, ''), coalesce(text, '')))))[1][1], '') AS role,
                  array_to_string(list_transform(list_sort(list(DISTINCT (coalesce(role, ''), coalesce(text, '')))), lambda x: x[2]), chr(10)) AS text
           FROM conversations GROUP BY conv_id, turn),
l AS (SELECT conv_id, turn, line, pos, len(regexp_replace(regexp_extract(line, '^[ \t]*((>[ \t]*)*)', 1), '[^>]', '', 'g')) AS level,
             trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*((>[ \t]*)*)', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS key
      FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m)),
e AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY pos) AS run FROM l WHERE key <> ''),
g AS (SELECT conv_id, turn, level, run, string_agg(key, chr(10) ORDER BY pos) AS whole, count(*) AS n FROM e GROUP BY ALL),
u AS (SELECT conv_id, turn, level, whole AS unit, whole, false AS loose, n FROM g UNION ALL SELECT conv_id, turn, level, key, whole, true, 1 FROM e JOIN g USING (conv_id, turn, level, run) WHERE n > 1),
q AS (SELECT conv_id, turn, level, unit, whole, loose, sum(n) AS n FROM u WHERE level > 0 GROUP BY ALL),
o AS (SELECT DISTINCT conv_id, turn, unit FROM u WHERE level = 0),
i AS (SELECT q.*, (SELECT max(o.turn) FROM o WHERE o.conv_id = q.conv_id AND o.unit = q.unit AND o.turn < q.turn) AS from_turn FROM q),
f AS (SELECT unit, min((conv_id, turn)) AS first FROM o GROUP BY unit),
h AS (SELECT unit, min((conv_id, turn)) AS second FROM o JOIN f USING (unit) WHERE o.conv_id <> first[1] GROUP BY unit),
x AS (SELECT i.*, CASE WHEN first[1] <> i.conv_id THEN first ELSE second END AS away FROM i LEFT JOIN f USING (unit) LEFT JOIN h USING (unit)),
y AS (SELECT conv_id, turn, level, whole, loose, n, CASE WHEN from_turn IS NULL THEN away[1] ELSE conv_id END AS from_conv, coalesce(from_turn, away[2]) AS from_turn FROM x WHERE from_turn IS NOT NULL OR away IS NOT NULL),
k AS (SELECT * FROM y WHERE NOT loose OR NOT EXISTS (FROM y w WHERE NOT w.loose AND w.conv_id = y.conv_id AND w.turn = y.turn AND w.level = y.level AND w.whole = y.whole)),
s AS (SELECT conv_id, turn, level, from_conv, from_turn, sum(n) AS n_lines FROM k GROUP BY ALL),
b AS (SELECT conv_id, turn, max((conv_id = from_conv, n_lines, from_turn, from_conv)) AS best FROM s WHERE level = 1 GROUP BY ALL),
n AS (SELECT conv_id, turn, sum(n_lines) AS n_linked FROM s GROUP BY ALL),
t AS (SELECT conv_id, turn, count(*) FILTER (level > 0) AS n_quoted, trim(coalesce(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY pos), '')) AS own FROM l GROUP BY ALL),
p AS (SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM m)
SELECT p.conv_id, p.turn, role, CASE WHEN best IS NULL THEN before ELSE best[3] END AS reply_to,
       CASE WHEN best IS NOT NULL THEN best[4] WHEN before IS NOT NULL THEN p.conv_id END AS reply_conv,
       CASE WHEN best IS NOT NULL THEN CASE WHEN best[1] THEN 'quoted' ELSE 'quoted elsewhere' END WHEN before IS NULL THEN 'first' ELSE 'previous' END AS reply_kind,
       coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked, len(own)::BIGINT AS n_chars, sha256(own) AS text_sha256, own AS text,
       row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN best IS NULL THEN before WHEN best[1] THEN best[3] END NULLS FIRST, turn NULLS FIRST) AS position
FROM p LEFT JOIN b USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn)
"""
