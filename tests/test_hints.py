"""Hints to take more of a line."""

from tallymart.operators import pricing


def test_lines_are_not_repeated_for_each_unit(spark, capsys):
    rule = "array(named_struct('type', 'multi', 'min_qty', 3L, 'total_c', 200L, 'unit_c', null, 'percent', null, 'amount_c', null, 'free_qty', null, 'max_qty', null, 'club', false))"
    lines = spark.sql(f"SELECT id AS cart, 1 AS line, id % 3 + 1 AS qty, 100L AS price_c, false AS weighed, CAST({rule} AS array<{pricing.RULE}>) AS rules FROM range(6)")
    lines = lines.unionByName(lines.filter("cart = 1"))  # a line in two rows has one hint
    hint = pricing.take_more_hint(pricing.line_prices(lines))
    assert {(r.cart, r.add) for r in hint.collect()} == {(1, 1), (4, 1)} and hint.count() == 2
    hint.explain()
    assert "Generate" not in capsys.readouterr().out
