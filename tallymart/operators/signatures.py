"""Refusals and caveats of stand-ins, counted without a pair of products: marks are judged once each, sizes and prices are counted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.scratch import written
from .joins import STOCKED, stocked

#: What a verdict reads of a product beside its kind of sale, department, size, brand and price.
MARKS = ("multipack", "forms", "diets", "required", "percent", "variants")
#: Refusals of two products by their sizes and marks, in order; FLAVOUR is refused unless the brand is the same.
REASONS = ("size", "pack", "form", "diet", "required", "percent", "variant")
LET_IN, FLAVOUR = len(REASONS), REASONS.index("variant")
#: Sizes of a pair: alike, one unknown (weighed goods), another one let in, the wanted one unknown, refused.
ALIKE, UNKNOWN, OTHER, UNSURE, APART = range(5)
#: Rows that meet in a task, and (wish, kind of offer) pairs looked at together.
CELL, BATCH = 200_000, 1_000_000


def size_relation(a: np.ndarray, b: np.ndarray, weighed: bool, missing: bool, size_pct: int, size_times: int) -> np.ndarray:
    """One of the five for each pair of sizes a (down) and b (across), NaN where unknown: a size may differ by size_pct of the larger, for a
    product that is ``missing`` up to size_times as OTHER; an unknown wanted size is then UNSURE. Weighed goods are never apart."""
    a, b = a[:, None], b[None, :]
    known, keep = ~(np.isnan(a) | np.isnan(b)), 100 - size_pct
    alike = known & ~((a * 100 < b * keep) | (b * 100 < a * keep))
    if weighed:
        return np.where(known, ALIKE, UNKNOWN)
    out = np.where(alike, ALIKE, APART)
    if missing:
        out[~alike & known & (a <= b * size_times) & (b <= a * size_times)] = OTHER
        out[np.broadcast_to(np.isnan(a), out.shape)] = UNSURE
    return out


def mark_reason(a: list[dict], b: list[dict]) -> np.ndarray:
    """[wanted mark, mark in stock, multipack matters] -> the first of REASONS after ``size`` that refuses, else LET_IN. ``required`` is
    one that the candidate lacks, ``percent`` both known and apart, the others differ."""
    sides = [[{**m, **{c: frozenset(m[c]) for c in ("forms", "diets", "required", "variants")}} for m in side] for side in (a, b)]
    differ = lambda c: np.array([[x[c] != y[c] for y in sides[1]] for x in sides[0]])
    percent = [np.array([np.nan if m["percent"] is None else m["percent"] for m in side], float) for side in sides]
    pack = np.array([[None not in (x["multipack"], y["multipack"]) and x["multipack"] != y["multipack"] for y in sides[1]] for x in sides[0]])
    lacks = np.array([[not x["required"] <= y["required"] for y in sides[1]] for x in sides[0]])
    rules = [("form", differ("forms")), ("diet", differ("diets")), ("required", lacks), ("percent", abs(percent[0][:, None] - percent[1][None, :]) > 1e-9), ("variant", differ("variants"))]
    out = np.full((len(a), len(b)), LET_IN)
    for reason, holds in reversed(rules):
        out[holds] = REASONS.index(reason)
    return np.stack([out, np.where(pack, REASONS.index("pack"), out)], axis=2)


def _judged(offers: dict, wishes: dict, marks: dict[int, dict], weighed: bool, missing: bool, size_pct: int, size_times: int) -> Iterator[tuple]:
    """Batches of (wish, reason, caveats, n, n_ok) of one block: arrays mark, size, brand, low, past (NaN price: whole range) of the wishes and mark,
    size, brand, price (-1: none) of the offers. Caveats are 1 for unsure, 2 for another size, 4 for another flavour."""
    (a_marks, a_mark), (b_marks, b_mark) = (np.unique(x["mark"], return_inverse=True) for x in (wishes, offers))
    (a_sizes, a_size), (b_sizes, b_size) = (np.unique(x["size"], return_inverse=True) for x in (wishes, offers))
    relation = size_relation(a_sizes, b_sizes, weighed, missing, size_pct, size_times)
    reason = mark_reason([marks[m] for m in a_marks], [marks[m] for m in b_marks])
    of = lambda rel: reason[:, :, 1 if rel in (ALIKE, OTHER) else 0]
    brands = np.unique(offers["brand"])
    b_brand = np.searchsorted(brands, offers["brand"])
    nb, ns = len(b_marks), len(b_sizes)

    # Counts by reason: offers by mark and size, the sizes of a relation to the wanted one together, the marks of a reason together.
    held = np.bincount(b_mark * ns + b_size, minlength=nb * ns).reshape(nb, ns)
    by_reason = np.zeros((len(a_marks), len(a_sizes), len(REASONS)), np.int64)
    for rel in range(5):
        some = held @ (relation == rel).T.astype(np.int64)
        if rel == APART:
            by_reason[:, :, 0] += some.sum(axis=0)
        else:
            for r in range(1, len(REASONS)):
                by_reason[:, :, r] += (of(rel) == r).astype(np.int64) @ some
    n = by_reason[a_mark, a_size]

    # What is let in, by its caveats: runs of offers of one mark and size (for another flavour of the brand too), sorted by price.
    for flavour in (False, True) if missing else (False,):
        run = (b_brand if flavour else 0) * nb * ns + b_mark * ns + b_size
        order = np.lexsort((offers["price"], run))
        prices = np.unique(offers["price"])
        place = run[order] * (len(prices) + 1) + np.searchsorted(prices, offers["price"][order])
        at = lambda run, price: np.searchsorted(place, run * (len(prices) + 1) + price)  # noqa: E731, B023
        wish = np.arange(len(a_mark))
        if flavour:
            mine = np.searchsorted(brands, wishes["brand"])
            wish = wish[(wishes["brand"] >= 0) & (mine < len(brands)) & (brands[np.minimum(mine, len(brands) - 1)] == wishes["brand"])]
        low, past, none = np.searchsorted(prices, wishes["low"]), np.searchsorted(prices, wishes["past"]), np.searchsorted(prices, 0)
        kinds, kind = np.unique(a_mark * len(a_sizes) + a_size, return_inverse=True)
        lists = []
        for m, z in zip(kinds // len(a_sizes), kinds % len(a_sizes)):
            rel = relation[z]
            ok = reason[m][:, np.isin(rel, (ALIKE, OTHER)).astype(int)] == (FLAVOUR if flavour else LET_IN)
            mark, size = np.nonzero(ok & (rel != APART) & (rel != OTHER if flavour else True))
            lists.append((mark * ns + size, (rel[size] == UNSURE) * 1 + (rel[size] == OTHER) * 2 + 4 * flavour))
        start = np.concatenate(([0], np.cumsum([len(x) for x, _ in lists])))
        runs, caveats = (np.concatenate(v) for v in zip(*lists))
        width = np.diff(start)[kind[wish]]
        total = np.cumsum(width)
        cuts = np.unique(np.searchsorted(total, np.arange(BATCH, (total[-1] if len(total) else 0) + BATCH, BATCH), side="right"))
        for lo, hi in zip((0, *cuts), (*cuts, len(wish))):
            w, some = width[lo:hi], wish[lo:hi]
            i = np.repeat(np.arange(hi - lo), w)
            slot = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + start[kind[some]][i]
            who = some[i]
            run = runs[slot] + (mine[who] * nb * ns if flavour else 0)
            first, priced, last = at(run, 0), at(run, none), at(run, len(prices))
            inside = np.where(wishes["priced"][who], at(run, past[who]) - at(run, low[who]) + priced - first, last - first)
            cell = i * 8 + caveats[slot]
            all_, ok = (np.bincount(cell, weights=v, minlength=8 * (hi - lo)).astype(np.int64) for v in (last - first, inside))
            full = np.flatnonzero(all_)
            yield some[full // 8], np.full(len(full), LET_IN), full % 8, all_[full], ok[full]
            if flavour:
                n[:, FLAVOUR] -= np.bincount(some[full // 8], weights=all_[full], minlength=len(n)).astype(np.int64)
    who, r = np.nonzero(n)
    yield who, r, np.zeros(len(who), np.int64), n[who, r], np.zeros(len(who), np.int64)


def verdict_counts(rows: DataFrame, key: str, missing: bool, size_pct: int = 25, size_times: int = 3, price_times: int = 3, cell: int = CELL) -> DataFrame:
    """rows(chain, gtin, key, in_stock, price_c, weighed, department, size, brand and MARKS) -> chain, gtin, reason, caveat, n: for each
    offer out of stock its candidates (all of its ``key`` that the chain has in stock) by what becomes of them.

    Reasons in order: ``form-of-sale``, ``category``, ``size`` (unless weighed: an unknown one, or one too far; see size_relation()), ``pack``
    (one of several against one, both sizes known), ``form``, ``diet`` (other sets), ``required``, ``percent``, ``variant`` (other sets), ``price``
    (over price_times dearer or cheaper), ``ok``. For a product that is ``missing``, other sizes are let in with the caveat ``other-size``, any
    with ``size-unconfirmed`` where the wanted one is unknown, and another variant of the brand with ``other-flavour`` unless the size is another
    one already. A price that is null or not positive refuses nothing. Null lists count as empty; a null key, department or kind of sale
    has no candidates. An offer without a candidate has no row; chain and gtin tell offers apart.

    No pair of products is made. Offers and wishes of a chain, key, kind of sale and department meet as columns; each is shuffled once.
    A block of over ``cell`` rows is dealt out: its counts are sums over its parts. Distinct marks of a block are judged by pairs.
    """
    lists = ("forms", "diets", "required", "variants")
    rows = rows.withColumns({c: F.array_sort(F.coalesce(c, F.array().cast("array<string>"))) for c in lists})
    rows = rows.withColumns({"size": F.col("size").cast("double"), "price_c": F.when(F.col("price_c") > 0, F.col("price_c").cast("long"))})
    block = ["chain", key, "weighed", "department"]
    rows = written(rows.select("chain", "gtin", key, "weighed", "department", "in_stock", "size", "price_c", "brand", F.struct(*MARKS).alias("mark")))
    stock, wanted = rows.filter("in_stock"), rows.filter(~F.col("in_stock"))
    per = lambda by, name: stock.groupBy(*by).agg(F.count("*").alias(name))
    blocks = stock.groupBy(*block).agg(F.count("*").alias("n")).join(wanted.groupBy(*block).agg(F.count("*").alias("k")), block)
    blocks = written(blocks.select(*block, F.ceil(F.col("n") / cell).cast("int").alias("parts"), F.ceil(F.col("k") / cell).cast("int").alias("shares"), F.monotonically_increasing_id().alias("gid"), (F.col("n") + F.col("k")).alias("load")))
    n_bins = max(int((blocks.agg(F.sum("load")).first()[0] or 0) // cell) + 1, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    dealt = lambda n: F.pmod(F.xxhash64("gtin"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["gid", "weighed", "part", "share", "size", "brand", "mark", "price_c"]
    binned = lambda df, *more: df.select(*[F.col(c).alias(f"_{c}") for c in (*columns, *more)], F.pmod(F.hash("gid", "part", "share"), F.lit(n_bins)).alias("_bin")).toDF(*columns, *more, "bin")
    left = binned(stock.join(blocks, block).withColumn("part", dealt("parts")).withColumn("share", every("shares")))
    right = binned(wanted.join(blocks, block).withColumn("share", dealt("shares")).withColumn("part", every("parts")), "chain", "gtin")
    names = ["", *["+".join(w for i, w in enumerate(("size-unconfirmed", "other-size", "other-flavour")) if k >> i & 1) for k in range(1, 8)]]

    def run(offers: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if len(offers) and len(asked):
            both = [t.combine_chunks() for t in (offers, asked)]
            col = [{c: t[c].to_numpy(zero_copy_only=False) for c in ("gid", "part", "share")} | {"size": t["size"].fill_null(float("nan")).to_numpy(), "price": t["price_c"].fill_null(-1).to_numpy(), "weighed": t["weighed"].to_numpy(zero_copy_only=False)} for t in both]
            for name in ("brand", "mark"):
                # The same numbers on both sides; no brand is -1.
                texts = [[repr(v) if v is not None else None for v in t[name].to_pylist()] if name == "mark" else t[name].to_pylist() for t in both]
                number = {v: i for i, v in enumerate(dict.fromkeys(x for side in texts for x in side if x is not None))}
                for c, side in zip(col, texts):
                    c[name] = np.array([number.get(v, -1) for v in side], np.int64)
                if name == "mark":
                    marks = {}
                    for c, t in zip(col, both):
                        codes, at = np.unique(c["mark"], return_index=True)
                        marks |= dict(zip(codes.tolist(), t["mark"].take(pa.array(at)).to_pylist()))
            for c in col:
                c["key"] = np.char.add(np.char.add(c["gid"].astype(str), "/"), np.char.add(np.char.add(c["part"].astype(str), "/"), c["share"].astype(str)))
            keys, at = np.unique(np.concatenate([c["key"] for c in col]), return_inverse=True)
            ids = at[: len(offers)], at[len(offers) :]
            groups = [(np.argsort(i, kind="stable"), np.searchsorted(np.sort(i), np.arange(len(keys) + 1))) for i in ids]
            for k in range(len(keys)):
                o, w = (order[ends[k] : ends[k + 1]] for order, ends in groups)
                if len(o) and len(w):
                    there = {c: v[o] for c, v in col[0].items()}
                    here = {c: v[w] for c, v in col[1].items()}
                    here |= {"low": -(-here["price"] // price_times), "past": here["price"] * price_times + 1, "priced": here["price"] >= 0}
                    parts += [(w[who], *rest) for who, *rest in _judged(there, here, marks, bool(there["weighed"][0]), missing, size_pct, size_times)]
        who, reason, caveat, n, ok = (np.concatenate(v) for v in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
        told = np.array([*REASONS, "ok"], object)[reason]
        mine = asked.select(["chain", "gtin"]).take(pa.array(who, pa.int64()))
        return pa.table({"chain": mine["chain"], "gtin": mine["gtin"], "reason": pa.array(told, pa.string()), "caveat": pa.array(np.array(names, object)[caveat], pa.string()), "n": pa.array(n, pa.int64()), "ok": pa.array(ok, pa.int64())})

    kind = lambda c: rows.schema[c].dataType.simpleString()
    met = left.groupBy("bin").cogroup(right.groupBy("bin")).applyInArrow(run, f"chain {kind('chain')}, gtin {kind('gtin')}, reason string, caveat string, n long, ok long")
    row = lambda reason, caveat, n: F.struct(reason.alias("reason"), caveat.alias("caveat"), n.alias("n"))
    let_in = F.array(row(F.lit("ok"), F.col("caveat"), F.col("ok")), row(F.lit("price"), F.lit(""), F.col("n") - F.col("ok")))
    late = met.select("chain", "gtin", F.inline(F.when(F.col("reason") == "ok", let_in).otherwise(F.array(row(F.col("reason"), F.col("caveat"), F.col("n"))))))

    outer = wanted.join(per(["chain", key], "n_all"), ["chain", key]).join(per(["chain", key, "weighed"], "n_alike"), ["chain", key, "weighed"], "left").join(per(block, "n_here"), block, "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    early = F.array(row(F.lit("form-of-sale"), F.lit(""), F.col("n_all") - count("n_alike")), row(F.lit("category"), F.lit(""), count("n_alike") - count("n_here")))
    out = outer.select("chain", "gtin", F.inline(early)).unionByName(late).filter("n > 0")
    return out.groupBy("chain", "gtin", "reason", "caveat").agg(F.sum("n").alias("n"))


def _sql(missing: bool) -> str:
    apart = "NOT a.weighed AND NOT coalesce(NOT (a.size * 4 < b.size * 3 OR b.size * 4 < a.size * 3), false)"
    unsure = f"({apart} AND a.size IS NULL)" if missing else "false"
    other = f"({apart} AND coalesce(a.size <= 3 * b.size AND b.size <= 3 * a.size, false))" if missing else "false"
    soft = f"(a.variant <> b.variant AND NOT {other} AND a.brand = b.brand)" if missing else "false"
    return f"""WITH {STOCKED}, s AS (SELECT chain, gtin, family, price_c, in_stock, gtin % 10 = 0 AS weighed, department, CASE WHEN size % 7 > 0 THEN size END AS size, gtin % 4 = 0 AS multipack, head IN ('hot', 'cold') AS form, gtin % 5 = 1 AS diet,
  head IN ('large', 'small') AS required, CASE WHEN gtin % 3 > 0 THEN gtin % 3 END AS percent, CASE WHEN head IN ('red', 'blue') THEN head ELSE '' END AS variant, brand FROM stocked),
j AS (SELECT a.chain, a.gtin, CASE WHEN a.weighed <> b.weighed THEN 'form-of-sale' WHEN a.department <> b.department THEN 'category' WHEN {apart} AND NOT {unsure} AND NOT {other} THEN 'size' WHEN a.size IS NOT NULL AND b.size IS NOT NULL AND a.multipack <> b.multipack THEN 'pack'
  WHEN a.form <> b.form THEN 'form' WHEN a.diet <> b.diet THEN 'diet' WHEN a.required AND NOT b.required THEN 'required' WHEN a.percent <> b.percent THEN 'percent' WHEN a.variant <> b.variant AND NOT {soft} THEN 'variant'
  WHEN b.price_c > 3 * a.price_c OR b.price_c * 3 < a.price_c THEN 'price' ELSE 'ok' END AS reason,
  concat_ws('+', CASE WHEN {unsure} THEN 'size-unconfirmed' END, CASE WHEN {other} THEN 'other-size' END, CASE WHEN {soft} THEN 'other-flavour' END) AS caveat
  FROM s a JOIN s b ON a.chain = b.chain AND a.family = b.family AND b.in_stock WHERE NOT a.in_stock)
SELECT chain, gtin, reason, CASE WHEN reason = 'ok' THEN caveat ELSE '' END AS caveat, count(*) AS n FROM j GROUP BY ALL"""


def signed(rows: DataFrame) -> DataFrame:
    """rows as stocked() with the marks that verdicts read, from the products' own words and codes."""
    g, head = F.col("gtin"), F.col("head")
    some = lambda holds, word: F.when(holds, F.array(word)).otherwise(F.array().cast("array<string>"))
    return rows.withColumns(
        {
            "weighed": g % 10 == 0, "size": F.when(F.col("size") % 7 > 0, F.col("size")), "multipack": g % 4 == 0, "forms": some(head.isin("hot", "cold"), F.lit("served")), "diets": some(g % 5 == 1, F.lit("kosher")),
            "required": some(head.isin("large", "small"), F.lit("sorted")), "percent": F.when(g % 3 > 0, (g % 3).cast("double")), "variants": some(head.isin("red", "blue"), head),
        }
    )


@query("c01_refusals", _sql(False))
def c01_refusals(spark, sf_dir):
    """For each offer out of stock the offers of its family by the first of ten rules that refuses them, for a cheaper offer's strict rules."""
    return verdict_counts(signed(stocked(spark, sf_dir)), "family", missing=False)


@query("c02_softened", _sql(True))
def c02_softened(spark, sf_dir):
    """The same for a line that would stay empty: what is let in with which caveat."""
    return verdict_counts(signed(stocked(spark, sf_dir)), "family", missing=True)
