"""Feeds written and scanned again."""

import glob
import os

from tallymart.sources import feeds, files


def test_xml_files_hold_a_bounded_number_of_elements(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "PER_FILE", 200)
    monkeypatch.setattr(feeds, "shared_folder", lambda _: str(tmp_path / "out"))
    rows = feeds.s02_flat_promotions(spark, "/root/testdata/sf0.001")
    found = glob.glob(os.path.join(tmp_path, "out", "*.xml*")) or glob.glob(os.path.join(tmp_path, "out", "part-*"))
    n = [open(f).read().count("<Promotion>") for f in found]
    assert max(n) <= 200 and sum(n) == rows.count() == feeds.promo_rows(spark, "/root/testdata/sf0.001").count()
    assert files.PER_FILE <= 100_000
