import gzip
import hashlib
import io

import pytest

from pyspark.sql import functions as F

from tallymart.llm import warc

SCHEMA = "page_id long, url string, html string"


def rows():
    big = "é" * 200_000 + "<p>\r\n\r\nWARC/1.1\r\n</p>"
    return [
        (1, "http://a/1", big), (2, "http://a/2", "small"), (3, None, "small"), (4, "http://a/4\r\nX: y", None), (5, "http://a/5", ""),
        (6, "http://a/6", big), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "x" * 1000), (10, "u", "x" * 1000), (10, "u", "x" * 1000), (None, "u", "x" * 1000),
    ]


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_round_trip(spark, tmp_path, chunk):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3).withColumns({"payload": F.lit(1), "first": F.lit(2), "digest": F.lit("x")})
    index, folder = warc.archive(pages, str(tmp_path))
    got = {}
    for r in warc.read(index, folder, chunk).orderBy("record_id", "chunk_no").collect():
        got.setdefault((r.record_id, r.page_id and int(r.page_id)), []).append(r)
    assert index.agg({"records": "sum"}).first()[0] == len(rows())
    for (_, page), parts in got.items():
        last = parts[-1]
        want = next(h or "" for i, _, h in rows() if i == page).encode()
        assert [p.last for p in parts][-1] and last.payload_bytes == len(want) and last.payload_digest == hashlib.sha1(want).hexdigest()
        assert all(len(p.data) <= chunk for p in parts)
        if last.record_type == "response" and page != 10:
            assert b"".join(p.data for p in parts) == want and [p.chunk_no for p in parts] == list(range(len(parts)))
    kinds = {p: (parts[-1].record_type, parts[-1].refers_to and int(parts[-1].refers_to)) for (_, p), parts in got.items()}
    assert kinds == {
        1: ("revisit", 6), 6: ("response", None), 9: ("revisit", 10), 10: ("response", None), None: ("revisit", 10),
        **{i: ("response", None) for i in (2, 3, 4, 5, 7, 8)},
    }


def test_files_are_gzip_members(spark, tmp_path):
    index, folder = warc.archive(spark.createDataFrame(rows()[:2], SCHEMA).coalesce(1), str(tmp_path))
    data = gzip.decompress(open(f"{folder}/{index.first().path}", "rb").read())
    assert data.count(b"WARC-Type: response\r\n") == 2 and data.endswith(b"\r\n\r\n")


def test_broken_archives_and_empty(spark, tmp_path):
    index, folder = warc.archive(spark.createDataFrame(rows()[:1], SCHEMA), str(tmp_path))
    packed = open(f"{folder}/{index.filter('records > 0').first().path}", "rb").read()
    with pytest.raises(ValueError):
        list(warc.chunks_of(warc.Unpacked(io.BytesIO(packed[:-50]))))
    plain = gzip.decompress(packed).replace("é".encode(), b"\xc3\xa8", 1)
    with pytest.raises(ValueError, match="digest"):
        list(warc.chunks_of(io.BytesIO(plain)))
    index, folder = warc.archive(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert warc.read(index, folder).count() == 0


def test_text_ids_many_archives_and_large_payload(spark, tmp_path):
    """Ids with signs that headers use; an archive every few records, each read by a task of its own; 60 MB in one payload."""
    ids = ['a"b', "ü:\r\nx", "", None, " z "]
    pages = spark.createDataFrame([(i, "u", f"{i}" * 50 + "<p>") for i in ids], "page_id string, url string, html string")
    large = spark.range(1).select(F.lit("large").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("0123456789"), 6_000_000).alias("html"))
    records = warc.with_revisits(pages.unionByName(large).repartition(2))
    index = warc.write(records, str(tmp_path), archive_bytes=1)
    table = warc.read(index, str(tmp_path))
    assert index.count() >= 6 and table.rdd.getNumPartitions() == index.count()
    assert {r.page_id for r in table.filter("last").collect()} == {*ids, "large"}
    one = table.filter("page_id = 'large'").agg(F.sum(F.octet_length("data")).alias("n"), F.max(F.octet_length("data")).alias("most"), F.max("payload_digest").alias("sha")).first()
    assert one.n == 60_000_000 and one.most == warc.CHUNK and one.sha == hashlib.sha1(b"0123456789" * 6_000_000).hexdigest()
