"""Prices over time: changes, intervals, as-of lookups, snapshots, failure episodes, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.market import PRICE_ROWS, price_rows, table

DAYS = f"""{PRICE_ROWS}, days AS (SELECT chain, gtin, day, min(price_c) AS price_c FROM price_rows GROUP BY ALL)"""


def daily_prices(spark, sf_dir: str) -> DataFrame:
    """chain, gtin, day, price_c: the lowest price of a day."""
    return price_rows(spark, sf_dir).groupBy("chain", "gtin", "day").agg(F.min("price_c").alias("price_c"))


def intervals(days: DataFrame) -> DataFrame:
    """days(chain, gtin, day, price_c) -> valid_from, valid_to (exclusive; null while valid): a row for each run of one price."""
    w = Window.partitionBy("chain", "gtin").orderBy("day")
    changed = days.withColumn("before", F.lag("price_c").over(w)).filter(F.col("before").isNull() | (F.col("before") != F.col("price_c")))
    return changed.select("chain", "gtin", "price_c", F.col("day").alias("valid_from"), F.lead("day").over(w).alias("valid_to"))


INTERVALS = f"""{DAYS}, changed AS (SELECT * FROM (SELECT *, lag(price_c) OVER w AS before FROM days WINDOW w AS (PARTITION BY chain, gtin ORDER BY day)) WHERE before IS NULL OR before <> price_c),
intervals AS (SELECT chain, gtin, price_c, day AS valid_from, lead(day) OVER (PARTITION BY chain, gtin ORDER BY day) AS valid_to FROM changed)"""


@query("w13_price_intervals", f"WITH {INTERVALS} SELECT * FROM intervals")
def w13_price_intervals(spark, sf_dir):
    return intervals(daily_prices(spark, sf_dir))


@query("j24_price_as_of", f"WITH {INTERVALS} SELECT chain, gtin, price_c FROM intervals WHERE valid_from <= DATE '1998-06-30' AND (valid_to IS NULL OR valid_to > DATE '1998-06-30')")
def j24_price_as_of(spark, sf_dir):
    return intervals(daily_prices(spark, sf_dir)).filter("valid_from <= DATE '1998-06-30' AND (valid_to IS NULL OR valid_to > DATE '1998-06-30')").select("chain", "gtin", "price_c")


def upsert(current: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """staged rows replace those of equal key; the others stay."""
    return current.join(staged.select(*keys), keys, "left_anti").unionByName(staged)


@query(
    "h01_current_prices",
    f"""WITH {DAYS}, o AS (SELECT chain, gtin, arg_max(price_c, day) AS price_c, max(day) AS day FROM days WHERE day < DATE '1999-01-01' GROUP BY ALL),
s AS (SELECT chain, gtin, arg_max(price_c, day) AS price_c, max(day) AS day FROM days WHERE day >= DATE '1999-01-01' GROUP BY ALL)
SELECT * FROM o WHERE (chain, gtin) NOT IN (SELECT (chain, gtin) FROM s) UNION ALL SELECT * FROM s""",
)
def h01_current_prices(spark, sf_dir):
    days = daily_prices(spark, sf_dir)
    last = lambda x: x.groupBy("chain", "gtin").agg(F.max_by("price_c", "day").alias("price_c"), F.max("day").alias("day"))
    return upsert(last(days.filter("day < DATE '1999-01-01'")), last(days.filter("day >= DATE '1999-01-01'")), ["chain", "gtin"])


@query(
    "h02_closed_intervals",
    f"""WITH {DAYS}, o AS (SELECT chain, gtin, arg_max(price_c, day) AS price_c, max(day) AS day FROM days WHERE day < DATE '1999-01-01' GROUP BY ALL),
s AS (SELECT chain, gtin, arg_min(price_c, day) AS price_c, min(day) AS day FROM days WHERE day >= DATE '1999-01-01' GROUP BY ALL)
SELECT o.chain, o.gtin, o.price_c, o.day AS valid_from, s.day AS valid_to FROM o JOIN s USING (chain, gtin) WHERE o.price_c <> s.price_c""",
)
def h02_closed_intervals(spark, sf_dir):
    """Old prices that the first load of 1999 closes, because it has another price."""
    days = daily_prices(spark, sf_dir)
    old = days.filter("day < DATE '1999-01-01'").groupBy("chain", "gtin").agg(F.max_by("price_c", "day").alias("price_c"), F.max("day").alias("valid_from"))
    new = days.filter("day >= DATE '1999-01-01'").groupBy("chain", "gtin").agg(F.min_by("price_c", "day").alias("new_c"), F.min("day").alias("valid_to"))
    return old.join(new, ["chain", "gtin"]).filter("price_c <> new_c").drop("new_c")


@query(
    "a30_changes_per_load",
    f"WITH {INTERVALS} SELECT valid_from AS day, count(*) AS n FROM intervals GROUP BY ALL",
)
def a30_changes_per_load(spark, sf_dir):
    return intervals(daily_prices(spark, sf_dir)).groupBy(F.col("valid_from").alias("day")).agg(F.count("*").alias("n"))


@query(
    "w01_newest_file",
    f"WITH {PRICE_ROWS} SELECT store, gtin % 3 AS kind, max(day) AS day FROM price_rows GROUP BY ALL",
)
def w01_newest_file(spark, sf_dir):
    """The newest file of each store and kind: one pass, no window, as only the day is asked for."""
    return price_rows(spark, sf_dir).groupBy("store", (F.col("gtin") % 3).alias("kind")).agg(F.max("day").alias("day"))


@query(
    "w03_cheapest_offer",
    f"WITH {PRICE_ROWS} SELECT gtin, chain, min((price_c, store))[1] AS price_c, min((price_c, store))[2] AS store FROM price_rows GROUP BY ALL",
)
def w03_cheapest_offer(spark, sf_dir):
    return price_rows(spark, sf_dir).groupBy("gtin", "chain").agg(F.min(F.struct("price_c", "store")).alias("x")).select("gtin", "chain", "x.price_c", "x.store")


@query(
    "w07_last_points",
    f"""WITH {PRICE_ROWS}, d AS (SELECT chain, day, sum(price_c)::BIGINT AS total_c FROM price_rows GROUP BY ALL)
SELECT chain, day, total_c FROM d QUALIFY row_number() OVER (PARTITION BY chain ORDER BY day DESC) <= 30""",
)
def w07_last_points(spark, sf_dir):
    d = price_rows(spark, sf_dir).groupBy("chain", "day").agg(F.sum("price_c").alias("total_c"))
    w = Window.partitionBy("chain").orderBy(F.col("day").desc())
    return d.withColumn("rn", F.row_number().over(w)).filter("rn <= 30").drop("rn")


@query(
    "s19_last_good_snapshot",
    f"""WITH {PRICE_ROWS}, d AS (SELECT chain, max(day) AS day FROM price_rows GROUP BY chain), t AS (SELECT max(day) AS today FROM price_rows)
SELECT chain, day, CASE WHEN day = today THEN 'ok' ELSE 'failed' END AS status, count(*) AS n_rows FROM price_rows JOIN d USING (chain, day), t GROUP BY ALL""",
)
def s19_last_good_snapshot(spark, sf_dir):
    """Each chain's rows of the newest day; `failed` where another chain has a newer one."""
    rows = price_rows(spark, sf_dir)
    days = rows.groupBy("chain", "day").agg(F.count("*").alias("n_rows"))
    newest = days.groupBy("chain").agg(F.max_by(F.struct("day", "n_rows"), "day").alias("x")).select("chain", "x.day", "x.n_rows")
    today = days.agg(F.max("day").alias("today"))
    return newest.join(F.broadcast(today)).select("chain", "day", F.when(F.col("day") == F.col("today"), "ok").otherwise("failed").alias("status"), "n_rows")


@query(
    "a29_content_groups",
    f"""WITH {PRICE_ROWS}, r AS (SELECT DISTINCT store, gtin % 40 AS code, pct FROM price_rows),
f AS (SELECT store, md5(string_agg(code || ':' || pct, ',' ORDER BY code || ':' || pct)) AS print FROM r GROUP BY store)
SELECT print, count(*) AS n_stores, min(store) AS first_store FROM f GROUP BY print""",
)
def a29_content_groups(spark, sf_dir):
    """Stores with one list of (code, discount), whatever its order; a store's list is bounded by its codes."""
    r = price_rows(spark, sf_dir).select("store", F.concat_ws(":", F.col("gtin") % 40, "pct").alias("x")).distinct()
    f = r.groupBy("store").agg(F.md5(F.array_join(F.array_sort(F.collect_list("x")), ",")).alias("print"))
    return f.groupBy("print").agg(F.count("*").alias("n_stores"), F.min("store").alias("first_store"))


@query(
    "a31_completeness",
    f"""WITH {PRICE_ROWS}, k AS (SELECT chain, count(DISTINCT store) AS n_known FROM price_rows GROUP BY chain),
m AS (SELECT chain, date_trunc('month', day)::DATE AS month, count(DISTINCT store) AS n_loaded FROM price_rows GROUP BY ALL)
SELECT chain, month, n_loaded, n_known FROM m JOIN k USING (chain) WHERE n_loaded * 10 < n_known * 9""",
)
def a31_completeness(spark, sf_dir):
    """Months in which under 90 % of a chain's stores were loaded."""
    seen = price_rows(spark, sf_dir).select("chain", "store", F.trunc("day", "month").alias("month")).distinct()
    known = seen.groupBy("chain").agg(F.count_distinct("store").alias("n_known"))
    return seen.groupBy("chain", "month").agg(F.count("*").alias("n_loaded")).join(known, "chain").filter("n_loaded * 10 < n_known * 9")


@query(
    "u03_missing_chains",
    f"""WITH {PRICE_ROWS} SELECT d.month, c.chain FROM (SELECT DISTINCT date_trunc('week', day)::DATE AS month FROM price_rows) d CROSS JOIN (SELECT DISTINCT chain FROM price_rows) c
EXCEPT SELECT date_trunc('week', day)::DATE, chain FROM price_rows""",
)
def u03_missing_chains(spark, sf_dir):
    """Weeks for which a chain has no row: the expected grid of weeks and chains, both few, less what is there."""
    seen = price_rows(spark, sf_dir).select(F.date_trunc("week", "day").cast("date").alias("month"), "chain").distinct()
    chains = seen.agg(F.sort_array(F.collect_set("chain")).alias("all"))
    grid = seen.select("month").distinct().join(F.broadcast(chains)).select("month", F.explode("all").alias("chain"))
    return grid.join(seen, ["month", "chain"], "left_anti")


@query(
    "j26_snapshot_diff",
    f"""WITH {PRICE_ROWS}, a AS (SELECT gtin, max(pct) AS old FROM price_rows WHERE day < DATE '1998-01-01' GROUP BY gtin), b AS (SELECT gtin, max(pct) AS new FROM price_rows WHERE day >= DATE '1998-01-01' GROUP BY gtin)
SELECT old, new, count(*) AS n, CASE WHEN old IS NULL THEN 'gained' WHEN new IS NULL THEN 'lost' WHEN old = new THEN 'same' ELSE 'moved' END AS kind FROM a FULL JOIN b USING (gtin) GROUP BY ALL""",
)
def j26_snapshot_diff(spark, sf_dir):
    rows = price_rows(spark, sf_dir)
    one = lambda where, name: rows.filter(where).groupBy("gtin").agg(F.max("pct").alias(name))
    both = one("day < DATE '1998-01-01'", "old").join(one("day >= DATE '1998-01-01'", "new"), "gtin", "full_outer")
    kind = F.when(F.col("old").isNull(), "gained").when(F.col("new").isNull(), "lost").when(F.col("old") == F.col("new"), "same").otherwise("moved")
    return both.groupBy("old", "new", kind.alias("kind")).agg(F.count("*").alias("n"))


REPORTS = "reports AS (SELECT event_id, (user_id % 14)::INT AS chain, ts, event_type <> 'error' AS ok FROM events)"


def reports(spark, sf_dir: str) -> DataFrame:
    """event_id, chain, ts, ok: hand-off reports."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 14).cast("int").alias("chain"), "ts", (F.col("event_type") != "error").alias("ok"))


@query(
    "w10_failure_rate",
    f"""WITH {REPORTS}, w AS (SELECT *, count(*) FILTER (NOT ok) OVER r AS failed, count(*) OVER r AS n FROM reports WINDOW r AS (PARTITION BY chain ORDER BY ts, event_id ROWS 9 PRECEDING))
SELECT event_id, chain, failed, n FROM w WHERE n >= 3 AND failed * 2 >= n""",
)
def w10_failure_rate(spark, sf_dir):
    """Reports at which half or more of the chain's last ten, three at least, had failed."""
    w = Window.partitionBy("chain").orderBy("ts", "event_id").rowsBetween(-9, 0)
    out = reports(spark, sf_dir).withColumns({"failed": F.count_if(~F.col("ok")).over(w), "n": F.count("*").over(w)})
    return out.filter("n >= 3 AND failed * 2 >= n").select("event_id", "chain", "failed", "n")


@query(
    "w11_failure_episodes",
    f"""WITH {REPORTS}, i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY chain ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM reports)
SELECT chain, island::BIGINT AS island, min(ts) AS failing_since, count(*) AS attempts FROM i WHERE NOT ok GROUP BY chain, island""",
)
def w11_failure_episodes(spark, sf_dir):
    """Runs of failures between two successes: when each began, and how many there were."""
    w = Window.partitionBy("chain").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    i = reports(spark, sf_dir).withColumn("island", F.sum(F.col("ok").cast("int")).over(w))
    return i.filter(~F.col("ok")).groupBy("chain", "island").agg(F.min("ts").alias("failing_since"), F.count("*").alias("attempts"))
