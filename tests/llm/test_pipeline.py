"""The pipeline's stages against brute force, each on what the one before kept."""

import random

import pytest
from pyspark.sql import functions as F
from test_native import brute_lines, brute_windows
from test_simhash import brute_similar

import corpus_pipeline
from tallymart.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ba", "to", "ri", "nu", "sel", "mo"]) for _ in range(rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randrange(14, 30))) for i in range(5)]
    legal = "\n".join(text(6) for _ in range(4))
    rows = [(0, None, None, None, None), (1, "", "xx", "s", 0), (2, "12 !?", "xx", "s", 5)]
    for i in range(10, 150):
        body = "\n".join(text(rng.randrange(3, 12)) for _ in range(rng.randrange(1, 20)))
        if i % 9 == 0:
            body += "\n" + legal
        if i % 13 == 0:
            body = items[i % 5][1] + " " + body
        rows.append((i, body, "xx", f"s{i % 3}", len(body)))
    for i in range(150, 170):
        near = rows[i - 100][1].split(" ")
        if len(near) > 60:
            near[rng.randrange(len(near))] = "zzz"
        rows.append((i, " ".join(near), "yy", "s0", 1))
    return rows, items


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows, items = corpus()
    sf = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(sf)).write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        out.append((name, docs.columns, docs.collect()))
    return rows, items, out, str(sf)


def test_stages(stages):
    rows, items, out, _ = stages
    assert [name for name, _, _ in out] == ["language", "lines", "near_duplicates", "decontaminate", "mix"]
    assert all(columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, columns, _ in out[:-1])
    kept = {r[0]: r for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    assert {r.doc_id: tuple(r) for r in out[0][2]} == kept

    lines = brute_lines([(i, r[1]) for i, r in kept.items()])
    lines = {i: t for i, t in lines.items() if t.strip(" ") or t == kept[i][1]}
    assert {r.doc_id: r.text for r in out[1][2]} == lines
    assert all(r.n_chars == len(r.text) for r in out[1][2] if r.text != kept[r.doc_id][1])

    near = brute_similar(sorted(lines.items()))
    firsts = {i: t for i, t in lines.items() if near[i] == i}
    assert {r.doc_id: r.text for r in out[2][2]} == firsts and len(firsts) < len(lines)

    hits = brute_windows(list(firsts.items()), items)
    clean = {i: t for i, t in firsts.items() if not hits[i][4]}
    assert {r.doc_id: r.text for r in out[3][2]} == clean and len(clean) < len(firsts)

    mixed = {r.doc_id: r for r in out[4][2]}
    assert {i: r.text for i, r in mixed.items()} == clean
    assert set(mixed) == set(clean) and all(mixed[i]["size"] == len(t.split()) for i, t in clean.items())
    total = sum(r["size"] for r in mixed.values())
    assert 0.8 * total <= sum(r.taken for r in mixed.values()) <= total and all(r.taken <= 3 * r["size"] for r in mixed.values())


def test_run_is_the_stages(spark, stages):
    _, _, out, sf = stages
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, out[-1][2]))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows_through_all_stages(spark, tmp_path):
    """Repeated rows, null ids, ids that repeat with other texts, and columns with the names that the operators use."""
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n))
    rows = [(i, text(60), "xx", "s", 1) for i in range(20)]
    rows += [rows[3], rows[3], (3, text(50), "xx", "s", 1), (None, text(40), "xx", None, 1), (None, text(45), None, None, 1), (None, rows[5][1], "xx", "s", 1), (None, None, None, None, None)]
    names = ["size", "taken", "copies", "_part", "tkey", "h", "fp", "root", "gone", "marks", "runs", "n_words", "finish", "component_id", "score", "lang_pred"]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(k) for k, c in enumerate(names)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert name == "mix" or docs.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *names]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in docs.collect())
    want = sorted((-1 if r[0] is None else r[0], r[1]) for r in rows if r[1] and r != rows[-2])
    assert got == want
    assert len({(r.doc_id, r.text): r.copies for r in docs.collect()}) == len({(r.doc_id, r.text, r.copies) for r in docs.collect()})


def test_unlabelled_and_strange_languages(spark):
    docs = spark.createDataFrame([(i, "abc abd bca cab " * 9, "xx") for i in range(30)] + [(90, "ФЫВ ЯЧС", "xx"), (91, "12", "xx")], "doc_id long, text string, lang string")
    kept = lambda d, **k: {r.doc_id for r in langid.keep_known(d, **k).collect()}
    learned = docs.withColumn("lang", F.when(F.col("doc_id") < 90, F.col("lang")))
    assert kept(learned, min_score=0.2) == set(range(30)) and kept(learned, langs=("yy",)) == set()
    assert kept(docs.withColumn("lang", F.lit(None).cast("string"))) == {*range(30), 90}
