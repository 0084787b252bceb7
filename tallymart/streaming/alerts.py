"""Reports and prices that arrive over time, as Structured Streaming jobs.

Each job reads files as they come; the registered queries run what is there (availableNow) and read the sink, which
holds what the watermark has closed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..registry import query
from ..sources.market import PRICE_ROWS, STORES, price_rows, stores
from ..sources.scratch import shared_folder

LATE = "10 minutes"
REPORTS = "reports AS (SELECT event_id, (user_id % 14)::INT AS chain, ts, event_type <> 'error' AS ok, json_extract_string(props, '$.k')::INT AS k FROM events), mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS closed FROM reports)"


def report_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, chain, ts, ok, k from the events as they arrive, each file once."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return raw.select(
        "event_id", (F.col("user_id") % 14).cast("int").alias("chain"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def run(stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there, in append mode; the sink as a table."""
    path = shared_folder(stream.sparkSession)
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


@query("t03_structure_alerts", f"WITH {REPORTS} SELECT event_id, chain, ts FROM reports WHERE NOT ok AND k >= 90")
def t03_structure_alerts(spark, sf_dir):
    """Stateless: failures whose code tells of a changed site."""
    return run(report_stream(spark, sf_dir).filter("NOT ok AND k >= 90").select("event_id", "chain", F.col("ts").cast("timestamp_ntz").alias("ts")))


def last_ten(key, parts, state: GroupState):
    """Outcomes of a chain in order of arrival; a row for each report at which half of the last ten, three at least, had failed."""
    (chain,) = key
    held = list(state.get[0]) if state.exists else []
    rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
    out = []
    for event_id, ok in zip(rows["event_id"], rows["ok"]):
        held = [*held, int(not ok)][-10:]
        if len(held) >= 3 and 2 * sum(held) >= len(held):
            out.append((event_id, chain, sum(held), len(held)))
    state.update((held,))
    yield pd.DataFrame(out, columns=["event_id", "chain", "failed", "n"])


@query(
    "t04_failure_rate",
    f"""WITH {REPORTS}, w AS (SELECT *, count(*) FILTER (NOT ok) OVER r AS failed, count(*) OVER r AS n FROM reports WINDOW r AS (PARTITION BY chain ORDER BY ts, event_id ROWS 9 PRECEDING))
SELECT event_id, chain, failed, n FROM w WHERE n >= 3 AND failed * 2 >= n""",
)
def t04_failure_rate(spark, sf_dir):
    """A window of the last ten reports of a chain is a count, not a time: its state is those ten."""
    s = report_stream(spark, sf_dir).select("event_id", "chain", "ts", "ok")
    out = s.groupBy("chain").applyInPandasWithState(last_ten, "event_id long, chain int, failed long, n long", "held array<int>", "append", GroupStateTimeout.NoTimeout)
    return run(out)


#: A report that waits: 17 bytes. FAILED and NO_ID are its flags.
REPORT = np.dtype([("micros", "<i8"), ("event_id", "<i8"), ("flags", "i1")])
FAILED, NO_ID = 1, 2
#: Rows of one frame that a chain's reports come out in.
FRAME = 100_000


def last_ten_in_order(key, parts, state: GroupState):
    """As last_ten(), but in order of event time: reports wait in the state until the watermark has passed them, so that late ones still
    take their place; those that come after the watermark are dropped by Spark. A chain's state is the reports of the watermark's delay and
    ten outcomes. Reports are packed, in the state and here: the first batch of a stream has no watermark, so that all of it waits."""
    (chain,) = key
    held, waiting = (np.frombuffer(x, kind) for x, kind in zip(state.get if state.exists else (b"", b""), (np.int8, REPORT)))
    packed = [waiting]
    for rows in parts:
        packed.append(np.empty(len(rows), REPORT))
        for name in REPORT.names:
            packed[-1][name] = rows[name].to_numpy()
    waiting = np.concatenate(packed)
    del packed
    closed = state.getCurrentWatermarkMs()
    passed = waiting["micros"] < closed * 1000
    due, waiting = waiting[passed], waiting[~passed]
    order = np.lexsort((due["event_id"], due["flags"] & NO_ID, due["micros"]))
    outcomes = np.concatenate((held, due["flags"][order] & FAILED))
    state.update((outcomes[-10:].tobytes(), waiting.tobytes()))
    if len(waiting):
        state.setTimeoutTimestamp(max(int(waiting["micros"].min()) // 1000, closed + 1))
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(outcomes, dtype=np.int64)))
    for at in range(0, max(len(due), 1), FRAME):
        rows, end = due[order[at : at + FRAME]], len(held) + np.arange(at, min(at + FRAME, len(due))) + 1
        n = np.minimum(end, 10)
        failed = sums[end] - sums[end - n]
        hit = (n >= 3) & (2 * failed >= n)
        ids = pd.arrays.IntegerArray(rows["event_id"][hit], (rows["flags"][hit] & NO_ID) > 0)
        yield pd.DataFrame({"event_id": ids, "chain": pd.array([chain] * len(ids), dtype="Int32"), "failed": failed[hit], "n": n[hit]})


def failure_rates(reports: DataFrame, late: str = LATE) -> DataFrame:
    """A stream of event_id, chain, ts, ok -> event_id, chain, failed, n: the reports at which half of a chain's last ten by event time,
    three at least, had failed. A report counts once the watermark (``late`` behind the newest) has passed it, however the reports
    were cut into batches. One without a time never does; one without an outcome hasn't failed; one without an id comes after others of its time."""
    flags = F.when(~F.col("ok"), FAILED).otherwise(0) + F.when(F.col("event_id").isNull(), NO_ID).otherwise(0)
    packed = [F.unix_micros("ts").alias("micros"), F.coalesce(F.col("event_id").cast("long"), F.lit(0)).alias("event_id"), flags.cast("tinyint").alias("flags")]
    s = reports.filter("ts IS NOT NULL").select("chain", "ts", *packed).withWatermark("ts", late)
    out = "event_id long, chain int, failed long, n long"
    return s.groupBy("chain").applyInPandasWithState(last_ten_in_order, out, "held binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


@query(
    "t04_rate_by_event_time",
    f"""WITH {REPORTS}, w AS (SELECT *, count(*) FILTER (NOT ok) OVER r AS failed, count(*) OVER r AS n FROM reports WINDOW r AS (PARTITION BY chain ORDER BY ts, event_id ROWS 9 PRECEDING))
SELECT event_id, chain, failed, n FROM w WHERE n >= 3 AND failed * 2 >= n AND ts < (SELECT date_trunc('milliseconds', closed) FROM mark)""",
)
def t04_rate_by_event_time(spark, sf_dir):
    return run(failure_rates(report_stream(spark, sf_dir)))


@query(
    "t05_cool_down",
    f"""WITH {REPORTS}, f AS (SELECT chain, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 15 MINUTE, true)::INT AS new FROM reports WHERE NOT ok WINDOW w AS (PARTITION BY chain ORDER BY ts)),
s AS (SELECT chain, ts, sum(new) OVER (PARTITION BY chain ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM f)
SELECT chain, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY chain, no HAVING max(ts) + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM f)""",
)
def t05_cool_down(spark, sf_dir):
    """Failures of a chain within 15 minutes of its last one fold into one alert with a count. Failures alone move the watermark."""
    s = report_stream(spark, sf_dir).filter(~F.col("ok")).withWatermark("ts", LATE)
    out = s.groupBy(F.session_window("ts", "15 minutes"), "chain").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    return run(out.select("chain", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "n"))


@query(
    "t06_hourly_counts",
    f"""WITH {REPORTS} SELECT date_trunc('hour', ts) AS hour, chain, count(*) AS n, count(*) FILTER (NOT ok) AS failed FROM reports GROUP BY date_trunc('hour', ts), chain
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT closed FROM mark)""",
)
def t06_hourly_counts(spark, sf_dir):
    s = report_stream(spark, sf_dir).withWatermark("ts", LATE)
    out = s.groupBy(F.window("ts", "1 hour").alias("w"), "chain").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"))
    return run(out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "chain", "n", "failed"))


@query(
    "t02_newest_price",
    f"WITH {PRICE_ROWS} SELECT chain, gtin, max((day, price_c))[1] AS day, max((day, price_c))[2] AS price_c FROM price_rows GROUP BY ALL",
)
def t02_newest_price(spark, sf_dir):
    """The newest price of each chain and product, kept up as batches of days arrive.

    Every batch is reduced to a row a key and upserted into the current table, which is written under the batch's number:
    a batch that runs again writes the same table again.
    """
    landed, path = shared_folder(spark), shared_folder(spark)
    rows = price_rows(spark, sf_dir).select("chain", "gtin", "day", "price_c")
    rows.repartitionByRange(4, "day").write.parquet(landed)
    last = {"table": None}

    def upsert(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("chain", "gtin").agg(F.max(F.struct("day", "price_c")).alias("x"))
        if last["table"] is not None:
            new = new.unionByName(batch.sparkSession.read.parquet(last["table"])).groupBy("chain", "gtin").agg(F.max("x").alias("x"))
        new.write.mode("overwrite").parquet(f"{path}/{number}")
        last["table"] = f"{path}/{number}"

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(landed)
    stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(last["table"]).select("chain", "gtin", "x.day", "x.price_c")


@query(
    "t07_expired_reports",
    f"WITH {REPORTS} SELECT chain, count(*) AS n_live FROM reports WHERE ts > (SELECT max(ts) - INTERVAL 7 DAY FROM reports) GROUP BY chain",
)
def t07_expired_reports(spark, sf_dir):
    """Reports within their seven days of the newest one; older ones have expired."""
    rows = run(report_stream(spark, sf_dir).select("chain", "ts"))
    newest = rows.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("from"))
    return rows.join(F.broadcast(newest)).filter(F.col("ts") > F.col("from")).groupBy("chain").agg(F.count("*").alias("n_live"))


@query(
    "t08_missing_days",
    f"""WITH {REPORTS}, d AS (SELECT DISTINCT chain, ts::DATE AS day FROM reports WHERE NOT ok), a AS (SELECT DISTINCT ts::DATE AS day FROM reports), c AS (SELECT DISTINCT chain FROM reports)
SELECT c.chain, a.day FROM a CROSS JOIN c WHERE (c.chain, a.day) NOT IN (SELECT (chain, day) FROM d)""",
)
def t08_missing_days(spark, sf_dir):
    """Days on which a chain published nothing, of those on which any chain did: what came over the stream, against the grid of few chains and days."""
    rows = run(report_stream(spark, sf_dir).select("chain", "ok", F.to_date("ts").alias("day")))
    seen = rows.groupBy("chain", "day").agg(F.count_if(~F.col("ok")).alias("n"))
    chains = seen.agg(F.collect_set("chain").alias("all"))
    grid = seen.select("day").distinct().join(F.broadcast(chains)).select("day", F.explode("all").alias("chain"))
    return grid.join(seen.filter("n > 0"), ["chain", "day"], "left_anti").select("chain", "day")


@query(
    "t09_enriched_reports",
    f"""WITH {REPORTS}, {STORES}, s AS (SELECT chain, count(*) AS n_stores, count(*) FILTER (served) AS n_served FROM stores GROUP BY chain)
SELECT event_id, chain, ok, n_stores, n_served FROM reports JOIN s USING (chain) WHERE NOT ok""",
)
def t09_enriched_reports(spark, sf_dir):
    """A stream joined with a table of its chains."""
    s = stores(spark, sf_dir).groupBy("chain").agg(F.count("*").alias("n_stores"), F.count_if("served").alias("n_served"))
    return run(report_stream(spark, sf_dir).filter("NOT ok").join(s, "chain").select("event_id", "chain", "ok", "n_stores", "n_served"))
