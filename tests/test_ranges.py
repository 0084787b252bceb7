"""The best in a range of sizes and prices against all pairs, in many cells and in one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.operators import quality, ranges


@pytest.mark.parametrize("cell, most, ratio", [(7, 1, None), (7, 4, 75), (100_000, 1, None), (100_000, 4, 75)])
def test_best_in_range_against_all_pairs(spark, cell, most, ratio):
    """Prices from 0 to a million in groups of many chunks, ties, nulls in ranks (first) and keys (no one's), empty ranges, groups without offers."""
    rng = random.Random(4)
    price = lambda: rng.choice([0, 1, 2, 3, 63, 64, 65, rng.randint(1, 300), rng.randint(1, 1 << 20)])
    stock = [(rng.choice("aab"), rng.choice([1, 2, 3, 8, 9, 12, 40]), price(), rng.randint(1, 3), (rng.choice([None, 0, 1]), g)) for g in range(400)] + [(None, 1, 5, 1, (0, 900)), ("a", 1, None, 1, (0, 901))]
    asks = [(rng.choice("aabc"), (i,), *rng.choice([(3, 1, 9), (9, 8, 12), (40, 40, 40), (4, 4, 7), (2, None, None)]), *sorted((price(), price()))) for i in range(300)] + [(None, (900,), 3, 1, 9, 0, 99)]
    s = spark.createDataFrame(stock, "k string, size int, price_c long, n int, x struct<a:int,item:long>")
    q = spark.createDataFrame(asks, "k string, id struct<i:long>, base_size int, size_from int, size_to int, low long, past long")
    want, counts = set(), {}
    for k, (i,), base, lo, hi, low, past in asks:
        ok = [r for r in stock if k is not None and lo is not None and r[0] == k and lo <= r[1] <= hi and r[2] is not None and low <= r[2] < past]
        far = lambda r: 0 if ratio is None or min(r[1], base) * 100 >= max(r[1], base) * ratio else max(r[1], base) / min(r[1], base)  # noqa: E731, B023
        order = sorted(ok, key=lambda r: (far(r), -1 if r[4][0] is None else r[4][0], r[4][1]))  # noqa: B023
        want |= {(i, r[4][1]) for r in order[:most]}
        if ok:
            counts[i] = sum(r[3] for r in ok)
    got = ranges.best_in_range(s, q, ["k"], most, ratio and ranges.by_ratio(ratio), cell).collect()
    sums = {}
    for r in got:
        sums[r.id.i] = sums.get(r.id.i, 0) + r.n_ok
    assert sums == counts and want <= {(r.id.i, r.x["item"]) for r in got}
    assert len(got) == len(want) or cell < 100_000
    assert ranges.best_in_range(s.limit(0), q, ["k"], most, ratio and ranges.by_ratio(ratio), cell).count() == 0 and ranges.best_in_range(s, q.filter(F.lit(False)), ["k"], most, ratio and ranges.by_ratio(ratio), cell).count() == 0


def test_substitutes_meet_no_pairs(spark):
    """One class of 40,000 offers, a wish in stock under its own code, an odd number of nearest sizes: the five nearest without 400 million pairs."""
    sold = spark.range(20000).selectExpr("1 AS chain", "id AS gtin", "'a' AS concept", "int(id % 40) + 1 AS size", "100 + id * 37 % 5000 AS price_c")
    wanted = spark.range(20000).selectExpr("1 AS chain", "id + if(id < 9, 0, 50000) AS gtin", "'a' AS concept", "int(id % 50) + 1 AS size", "100 + id * 31 % 5000 AS base_c")
    got = {}
    for r in quality.substitutes(wanted, sold).collect():
        got.setdefault(r.gtin, []).append((r.place, r["item"], r.price_c))
    g = np.arange(20000)
    size, price = g % 40 + 1, 100 + g * 37 % 5000
    for i in (0, 1, 5, 8, 9, 77, 4321, 19999):
        code, s, p = i + (50000 if i >= 9 else 0), i % 50 + 1, 100 + i * 31 % 5000
        ok = np.flatnonzero((size * 4 >= s * 3) & (size * 3 <= s * 4) & (price <= 3 * p) & (price * 3 >= p) & (g != code))
        order = ok[np.lexsort((ok, price[ok], abs(size[ok] - s)))][:5]
        assert sorted(got.get(code, [])) == [(n, int(x), int(price[x])) for n, x in enumerate(order, 1)]
