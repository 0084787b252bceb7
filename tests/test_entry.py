"""The registry: every query has a callable, the SQL names queries, and the rest works without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90


def test_without_the_training_data_folders(tmp_path):
    for name in ("tallymart", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tallymart/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["b13_basket_comparison", "j05_resolution", "w13_price_intervals", "a13_class_cards", "t05_cool_down", "g10_same_product_clusters", "r05_bm25"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = e.queries()[name](spark, str(DATA))
    mine = sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    rel = con.execute(e.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    theirs = sorted(str(tuple(r[columns.index(c)] for c in sorted(columns))) for r in rel.fetchall())
    assert sorted(columns) == sorted(df.columns) and mine == theirs
