"""The best few of a group within a range of sizes and of prices, for many asks at once and without pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written

#: Rows (stock and asks) that meet in a task, and (ask, size) pairs that it looks at together.
CELL, BATCH = 200_000, 1_000_000


def _bucket(price: Column) -> Column:
    """A number that grows with the price: its bits and the six highest of them."""
    bits = F.length(F.bin(price))
    return F.when(price < 0, -1).otherwise(bits * 64 + F.call_function("shiftright", price, F.greatest(bits - 6, F.lit(0))))


def _cells(stock: DataFrame, asks: DataFrame, group: list[str], cell: int) -> DataFrame:
    """group -> gid, its rows (load), and the prices at which its second and later chunks begin, so that a chunk holds about ``cell`` rows."""
    prices = stock.select(*group, F.col("price_c").alias("p")).unionByName(asks.select(*group, F.col("low").alias("p")))
    counts = prices.groupBy(*group, _bucket(F.col("p")).alias("b")).agg(F.count("*").alias("n"), F.min("p").alias("p"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("b")) - F.col("n")
    chunks = counts.withColumn("chunk", F.floor(before / cell)).groupBy(*group, "chunk").agg(F.min("p").alias("p"), F.sum("n").alias("n"))
    out = chunks.groupBy(*group).agg(F.sum("n").alias("load"), F.array_sort(F.collect_list("p")).alias("starts"))
    return written(out.select(*group, "load", F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))).alias("starts"), F.monotonically_increasing_id().alias("gid")))


def _codes(known: np.ndarray, *asked: np.ndarray):
    """The distinct values of ``known``, in order, as numbers; of others the number of the first that is not less."""
    values = np.unique(known)
    return len(values), *[np.searchsorted(values, x) for x in (known, *asked)]


def _found(stock: pa.Table, asks: pa.Table, most: int, distance: Callable | None):
    """Batches of (ask row, stock row, n): the ``most`` least stock rows of each ask by x (or by how far the size is, then x); n, on
    the first of them, counts all that the ask lets in. Within a cell and size, prices are sorted and the least of any run is read
    from a table of the least of all runs of 1, 2, 4 ... rows."""
    a = {c: asks[c].to_numpy() for c in ("gid", "chunk", "size_from", "size_to", "low", "past", "base_size")}
    s = {c: stock[c].to_numpy() for c in ("gid", "chunk", "size", "price_c", "n")}
    fields = stock["x"].combine_chunks()
    ranked = pa.table({str(i): fields.field(i) for i in range(fields.type.num_fields)})
    rank = np.empty(len(fields), np.int64)
    rank[pc.sort_indices(ranked, sort_keys=[(c, "ascending") for c in ranked.column_names], null_placement="at_start").to_numpy()] = np.arange(len(fields))
    n_gids, gid, a_gid = _codes(s["gid"], a["gid"])
    has = np.isin(a["gid"], s["gid"])
    cells, cell, a_cell = _codes(s["chunk"] * n_gids + gid, a["chunk"] * n_gids + np.minimum(a_gid, n_gids - 1))
    has &= np.isin(a["chunk"] * n_gids + np.minimum(a_gid, n_gids - 1), s["chunk"] * n_gids + gid)
    n_sizes, size, size_from, size_past = _codes(s["size"], a["size_from"], a["size_to"] + 1)
    n_prices, price, low, past = _codes(s["price_c"], a["low"], a["past"])
    order = np.lexsort((price, size, cell))
    key = (cell * n_sizes + size)[order]
    segments, seg = np.unique(key, return_inverse=True)
    place = seg * (n_prices + 1) + price[order]
    rank, sizes, upto = rank[order], s["size"][order], np.concatenate(([0], np.cumsum(s["n"][order])))
    at = np.empty(len(rank), np.int64)
    at[rank] = np.arange(len(rank))
    least = [rank]
    while 2 ** len(least) <= np.bincount(seg).max():
        half = 2 ** (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))

    def best(i, j):
        out, level = np.empty(len(i), np.int64), np.frexp(j - i)[1] - 1
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(least[k][i[m]], least[k][j[m] - 2**k])
        return out

    first = np.searchsorted(segments, a_cell * n_sizes + size_from)
    wide = np.where(has, np.maximum(np.searchsorted(segments, a_cell * n_sizes + size_past) - first, 0), 0)
    total = np.cumsum(wide)
    cuts = np.searchsorted(total, np.arange(BATCH, (total[-1] if len(total) else 0) + BATCH, BATCH), side="right")
    for lo, hi in zip((0, *cuts), (*cuts, len(wide))):
        w = wide[lo:hi]
        ask = np.repeat(np.arange(lo, hi), w)
        of = np.arange(len(ask)) - np.repeat(np.cumsum(w) - w, w) + first[ask]
        i, j = (np.searchsorted(place, of * (n_prices + 1) + end[ask]) for end in (low, past))
        n = np.bincount(ask - lo, weights=upto[j] - upto[i], minlength=hi - lo).astype(np.int64)
        for turn in range(most):
            ask, i, j = (v[i < j] for v in (ask, i, j))
            if not len(ask):
                break
            r = best(i, j)
            far = np.zeros(len(ask))
            if distance is not None and len(ask):
                far = distance(sizes[i], a["base_size"][ask])
            by = np.lexsort((r, far, ask))
            top = by[np.concatenate(([True], ask[by][1:] != ask[by][:-1]))]
            yield ask[top], order[at[r[top]]], n[ask[top] - lo] if turn == 0 else np.zeros(len(top), np.int64)
            right, left = at[r[top]] + 1, j[top].copy()
            j[top] = at[r[top]]
            ask, i, j = np.concatenate((ask, ask[top])), np.concatenate((i, right)), np.concatenate((j, left))


def by_ratio(keep: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Sizes are alike where the smaller is at least keep percent of the larger; others are as far as the larger over the smaller."""

    def far(size: np.ndarray, base: np.ndarray) -> np.ndarray:
        other = (size * 100 < base * keep) | (base * 100 < size * keep)
        return np.where(other, np.maximum(size, base) / np.where(other, np.minimum(size, base), 1), 0.0)

    return far


def best_in_range(stock: DataFrame, asks: DataFrame, group: list[str], most: int = 1, distance: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, cell: int = CELL) -> DataFrame:
    """stock(group, size, price_c, n, x: a struct to rank by), asks(group, id: a struct, base_size, size_from, size_to, low, past) -> id,
    base_size, n_ok, size, price_c, x: the ``most`` least offers of the ask's group with size_from <= size <= size_to and low <= price_c < past.

    With ``distance`` (arrays of sizes and of base sizes -> how far apart) nearer sizes come before x; see by_ratio(). n_ok are numbers of all offers let in (n summed), to be summed over an ask's rows; an ask without any has no row. Numbers are
    whole; rows with a null among them are no one's.

    Each offer is shuffled once to its cell, a range of prices of its group, each ask to the cells that its prices lie in (one, unless
    the group has more than ``cell`` rows); small cells share a task's turn. Only the best of each cell come out.
    """
    stock = stock.select(*group, F.col("size").cast("long"), F.col("price_c").cast("long"), F.col("n").cast("long"), "x").dropna(subset=[*group, "size", "price_c"])
    asks = asks.select(*group, "id", *[F.col(c).cast("long") for c in ("base_size", "size_from", "size_to", "low", "past")]).dropna(subset=[*group, "base_size", "size_from", "low", "past"]).filter("low < past")
    cells = _cells(stock, asks, group, cell)
    n_bins = int((cells.agg(F.sum("load")).first()[0] or 0) // cell) + 1
    n_bins = max(n_bins, 2 * stock.sparkSession.sparkContext.defaultParallelism)
    chunk = lambda p: F.size(F.filter("starts", lambda s: s <= p)).cast("long")
    names = lambda df: [c for c in df.columns if c not in (*group, "starts", "load")]
    # Names anew, for both sides come from the cells.
    binned = lambda df: df.select(*[F.col(c).alias(f"_{c}") for c in names(df)], F.pmod(F.hash("gid", "chunk"), F.lit(n_bins)).alias("_bin")).toDF(*names(df), "bin")
    left = binned(stock.join(cells, group).withColumn("chunk", chunk(F.col("price_c"))))
    right = binned(asks.join(cells, group).withColumn("chunk", F.explode(F.sequence(chunk(F.col("low")), chunk(F.col("past") - 1)))))
    whole = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    schema = T.StructType([T.StructField("id", asks.schema["id"].dataType), *whole("base_size", "n_ok", "size", "price_c"), T.StructField("x", stock.schema["x"].dataType)])

    def run(offers: pa.Table, asked: pa.Table) -> pa.Table:
        offers, asked = offers.combine_chunks(), asked.combine_chunks()
        parts = list(_found(offers, asked, most, distance)) if len(offers) and len(asked) else []
        ask, row, n = (np.concatenate(v) for v in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        mine, theirs = asked.select(["id", "base_size"]).take(pa.array(ask)), offers.select(["size", "price_c", "x"]).take(pa.array(row))
        return pa.table({"id": mine["id"], "base_size": mine["base_size"], "n_ok": pa.array(n, pa.int64()), **{c: theirs[c] for c in theirs.column_names}})

    return left.groupBy("bin").cogroup(right.groupBy("bin")).applyInArrow(run, schema)
