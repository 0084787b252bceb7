"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order (by a hash of the id), served up to ``epochs`` times. A
document's virtual finish time is its source's words up to and including it, divided by the source's target. All turns of
all documents are put in one global order of finish time by a range sort, which is cut at the total budget: every
source gets its share, whatever its size.

No order is ever gathered in one task: running sums inside a source are made of sums of 4,096 hash buckets and a running
sum inside one bucket, so that a source with a third of all rows is dealt over thousands of buckets; sources are ranked and
filled up over ranges; of the sorted turns only the range in which the budget runs out is summed up row by row. The
driver gets a sum for each range and the first turn that is over the budget.

Null text has size 0 and is never taken; a null source is a source of its own, ordered last. Rows with equal doc_id and
size in one source are ties: their running sums take in all of them, so that they get one finish time and the cut takes all of
them or none. An empty table gives an empty result. Very long texts are counted whole. Columns with clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import before, table, word_count, written

RANGE_ROWS = 1 << 20


def source_targets(sizes: DataFrame, weights=(5, 2, 1), epochs: int = 3) -> DataFrame:
    """(source, source_size) -> also sid, target: the total shared by weight, none above epochs times its size.

    Filling up: with sources ordered by cap over weight, the level is that at the first source which stays under its
    cap when all before it are full.
    """
    s = before(sizes.select("source", "source_size", F.lit(1).alias("one")), [F.col("source").asc_nulls_last()], sid="one").drop("one").withColumns(
        {
            "weight": F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")),
            "cap": F.col("source_size") * epochs,
        }
    )
    full = F.col("cap") / F.col("weight")
    s = written(before(s, [full, F.col("sid")], caps="cap", weights="weight"))
    total = s.agg(F.sum("source_size"), F.sum("weight")).first()
    s = s.withColumn("level", (F.lit(total[0] or 0) - F.col("caps")).cast("double") / (F.lit(total[1] or 0) - F.col("weights")))
    first = s.filter(F.col("level") <= full).agg(F.min(F.struct(full.alias("full"), "sid", "level"))["level"]).first()[0]
    return s.select("sid", "source", "source_size", F.least(F.col("cap").cast("double"), F.lit(first).cast("double") * F.col("weight")).alias("target"))


def queued(docs: DataFrame, weights=(5, 2, 1), epochs: int = 3, salt: str = "mix", size: str | None = None) -> DataFrame:
    """doc_id, tkey (a hash of the text), source, size, h, sid, source_size, target, upto: each document's place in its source's queue."""
    base = written(
        docs.select(
            "doc_id",
            (F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")).alias("tkey"),
            "source",
            (word_count(F.col("text")) if size is None else F.col(size).cast("long")).alias("size"),
            F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))).alias("h"),
        ).withColumn("bucket", F.substring("h", 1, 3))
    )
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = written(source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, epochs))
    back = lambda x: x.withColumnRenamed("source", "_source").join(sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    earlier = (
        back(sums)
        .select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return written(
        back(base)
        .withColumn("inside", F.sum("size").over(inside))
        .join(earlier, ["sid", "bucket"])
        .withColumn("upto", F.col("before") + F.col("inside"))
        .drop("before", "inside", "bucket")
    )


ORDER = ["finish", "sid", "h", "doc_id", "turn", "size"]


def in_order(queue: DataFrame, epochs: int = 3, budget: int | None = None) -> tuple[DataFrame, dict | None]:
    """The turns of a queue (doc_id, tkey, size, sid, h, turn, finish, part) in global order of finish time, cut at the budget
    (None: all words); and the first turn over the budget, None if there is none. Ties with that turn are cut too."""
    facts = queue.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    budget = facts["size"] if budget is None else budget
    turns = queue.filter("size > 0").select(
        "doc_id", "tkey", "size", "sid", "h", F.inline(F.array(*[F.struct(F.lit(p).alias("turn"), finish(p).alias("finish")) for p in range(epochs)]))
    ).filter("finish <= 2")
    n = max(int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-facts["n"] * epochs // RANGE_ROWS))
    turns = written(turns.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id()))
    spent = 0
    for part, words in sorted(turns.groupBy("part").agg(F.sum("size")).collect()):  # a row for each range
        if spent + words > budget:
            break
        spent += words
    else:
        return turns, None
    running = F.sum("size").over(Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    last = turns.filter(F.col("part") == part).withColumn("spent", running).filter(F.col("spent") + spent > budget)
    last = last.agg(F.min(F.struct("finish", "sid", "h", "turn")).alias("x")).first()["x"].asDict()
    return turns.filter(earlier_than(last, F.col("finish"), F.col("turn"))), last


def earlier_than(last: dict, finish_time, turn):
    own = F.struct(finish_time.alias("f"), F.col("sid").alias("s"), F.col("h").alias("h"), turn.alias("t"))
    return own < F.struct(F.lit(last["finish"]).alias("f"), F.lit(last["sid"]).alias("s"), F.lit(last["h"]).alias("h"), F.lit(last["turn"]).alias("t"))


def mix(docs: DataFrame, weights=(5, 2, 1), epochs: int = 3, salt: str = "mix", size: str | None = None) -> DataFrame:
    """Per document doc_id, tkey, size, source, source_size, target, copies, taken. size: a column; else words of text."""
    queue = queued(docs, weights, epochs, salt, size)
    _, last = in_order(queue, epochs)
    hit = lambda p: finish(p) <= 2 if last is None else (finish(p) <= 2) & earlier_than(last, finish(p), F.lit(p))
    copies = sum((F.coalesce(hit(p), F.lit(False)).cast("int") for p in range(epochs)), F.lit(0))
    out = queue.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)))
    return out.select("doc_id", "tkey", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights=(5, 2, 1), epochs: int = 3) -> DataFrame:
    """docs with size, source_size, target, copies and taken; columns of these names are replaced."""
    facts = ["size", "source_size", "target", "copies", "taken"]
    found = mix(docs, weights, epochs).dropDuplicates(["doc_id", "tkey", "source"]).select(F.col("doc_id").alias("_tm_id"), F.col("tkey").alias("_tm_key"), F.col("source").alias("_tm_source"), *facts)
    docs = docs.drop(*facts)
    return docs.join(
        found, docs["doc_id"].eqNullSafe(F.col("_tm_id")) & (F.xxhash64(docs["text"]) == F.col("_tm_key")) & docs["source"].eqNullSafe(F.col("_tm_source"))
    ).drop("_tm_id", "_tm_key", "_tm_source")


def finish(turn: int):
    return (F.col("source_size") * turn + F.col("upto")).cast("double") / F.nullif(F.col("target"), F.lit(0.0))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '-')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, ([5, 2, 1])[sid % 3 + 1] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM c),
t AS (SELECT sid, source, source_size,
             least(cap::DOUBLE, weight * (SELECT arg_min(level, (cap / weight, sid)) FROM l WHERE level <= cap / weight)) AS target FROM l),
q AS (SELECT d.*, t.sid, t.source_size, t.target, sum(d.size) OVER (PARTITION BY t.sid ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.*, turn, (source_size * turn + upto)::DOUBLE / nullif(target, 0) AS finish FROM q, range(3) r(turn)),
o AS (SELECT doc_id, h, size, sum(size) OVER (ORDER BY finish, sid, h, doc_id, turn, size ROWS UNBOUNDED PRECEDING) AS spent FROM p WHERE size > 0 AND finish <= 2),
k AS (SELECT doc_id, count(*) AS copies FROM o WHERE spent <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(k.copies, 0))::BIGINT AS taken FROM q LEFT JOIN k USING (doc_id)
"""
