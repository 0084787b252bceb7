"""Refusals and caveats against all pairs."""

import random
from collections import Counter

import pytest

from tallymart.operators import signatures

SCHEMA = (
    "chain int, gtin long, family string, in_stock boolean, price_c long, weighed boolean, department string, size int, multipack boolean, forms array<string>, diets array<string>, required array<string>, percent double, variants array<string>, brand string"
)


def verdict(a, b, missing):
    """From the docstrings, a pair at a time."""
    if a["weighed"] != b["weighed"]:
        return "form-of-sale", ""
    if a["department"] != b["department"]:
        return "category", ""
    sets = lambda x, c: set(x[c] or [])
    caveats = []
    x, y = a["size"], b["size"]
    if not a["weighed"] and not (x is not None and y is not None and y * 100 >= x * 75 and x * 100 >= y * 75):
        if missing and x is None:
            caveats.append("size-unconfirmed")
        elif missing and y is not None and x <= 3 * y and y <= 3 * x:
            caveats.append("other-size")
        else:
            return "size", ""
    if x is not None and y is not None and a["multipack"] != b["multipack"]:
        return "pack", ""
    for c, reason in (("forms", "form"), ("diets", "diet")):
        if sets(a, c) != sets(b, c):
            return reason, ""
    if sets(a, "required") - sets(b, "required"):
        return "required", ""
    if a["percent"] is not None and b["percent"] is not None and abs(a["percent"] - b["percent"]) > 1e-9:
        return "percent", ""
    if sets(a, "variants") != sets(b, "variants"):
        if not (missing and a["brand"] is not None and a["brand"] == b["brand"] and "other-size" not in caveats):
            return "variant", ""
        caveats.append("other-flavour")
    p, q = a["price_c"], b["price_c"]
    if p and p > 0 and q and q > 0 and (q > 3 * p or q * 3 < p):
        return "price", ""
    return "ok", "+".join(caveats)


@pytest.mark.parametrize("missing", [False, True])
def test_counts_against_all_pairs(spark, missing):
    """Nulls in every mark, lists in another order, prices null and zero, repeated marks; no candidate, no row."""
    rng = random.Random(11)
    one = rng.choice
    rows = [
        (one([1, 2]), g, one("aaab"), rng.random() < 0.6, one([None, 0, 1, 2, 3, 5, 7, 100, 250, 300]), rng.random() < 0.1, one("xxxxy"), one([None, 2, 3, 4, 4, 5, 12, 30]), rng.random() < 0.1,
         one([[], [], None, ["frozen"]]), one([[], []] + [["vegan"]]), one([[], None, ["p", "q"], ["q", "p"], ["p"]]), one([None, 3.0, 3.0, 5.0]), one([[], [], ["mint"], ["mint", "lime"]]), one([None, "B", "C"]))
        for g in range(400)
    ]
    rows.append((3, 9999, "a", False, 5, False, "x", 2, False, [], [], [], None, [], "B"))
    df = spark.createDataFrame(rows, SCHEMA)
    dicts = [dict(zip(df.columns, r)) for r in rows]
    want = Counter()
    for a in dicts:
        for b in dicts:
            if not a["in_stock"] and b["in_stock"] and a["chain"] == b["chain"] and a["family"] == b["family"]:
                want[(a["chain"], a["gtin"], *verdict(a, b, missing))] += 1
    got = {tuple(r)[:4]: r.n for r in signatures.verdict_counts(df, "family", missing).select("chain", "gtin", "reason", "caveat", "n").collect()}
    assert got == dict(want)
    assert {"ok", "price", "size", "pack", "form", "diet", "required", "percent", "variant", "category", "form-of-sale"} <= {k[2] for k in got}
    assert signatures.verdict_counts(df.limit(0), "family", missing).count() == 0


def test_blocks_dealt_out_count_the_same(spark):
    """A block of more rows than a task takes is dealt out, offers and wishes; the written table is no longer than the input."""
    rng = random.Random(5)
    rows = [(1, g, "a", g % 2 == 0, rng.randint(1, 9), False, "x", rng.randint(1, 30), False, [], [], [], None, [rng.choice("pq")], rng.choice("BC")) for g in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = lambda cell: {tuple(r) for r in signatures.verdict_counts(df, "family", True, cell=cell).collect()}
    assert counts(40) == counts(100_000) and sum(r[4] for r in counts(40)) == 150 * 150
