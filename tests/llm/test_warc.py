import base64
import gzip
import hashlib
import io
import re

import duckdb
import pytest

from tessera.llm.queries import OP4_SQL, op4_warc
from tessera.llm.warc import arc_date, archive_pages, convert, read_arc, read_warc, split_http, write_arc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a.example/ ü", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nx\n\ny"), ("", "0.0.0.0", "2001", "-", b""), ("http://b/", "::1", "20010203", "text/plain", b"\nhttp://c/ 1 2 3 4\n")]
    data = write_arc("x.arc", records, version)
    got = list(read_arc(io.BytesIO(data)))
    assert [r.content for r in got] == [r[4] for r in records]
    assert [r.fields["ip"] for r in got] == [r[1] for r in records]
    assert got[0].fields["url"] == "http://a.example/%20%C3%BC" and got[1].fields["url"] == "-"
    for r in got:
        assert data[r.offset :].split(b"\n", 1)[0].split(b" ")[-1] == str(len(r.content)).encode()


@pytest.mark.parametrize("data", [b"http://x 1 2 3 4\n", b"filedesc://x 0 1 t 3\n9 0\n", write_arc("x", [("u", "i", "d", "m", b"abc")])[:-3], write_arc("x", []) + b"broken line\n"])
def test_broken_arcs_are_refused(data):
    with pytest.raises(ValueError):
        list(read_arc(io.BytesIO(data)))


def test_dates_and_heads():
    assert arc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert arc_date("20010203") == "2001-02-03T00:00:00Z"
    assert arc_date("x") == arc_date("20011399000000") == "1970-01-01T00:00:00Z"
    assert split_http(b"HTTP/1.1 200 OK\r\n\r\n\r\n\r\nz") == (b"HTTP/1.1 200 OK\r\n\r\n", b"\r\n\r\nz")
    assert split_http(b"gopher text") == (b"", b"gopher text")


def test_urls_with_spaces_and_gzip(spark):
    arc = b"filedesc://f 0.0.0.0 19960101000000 text/plain 9\n1 0 org\n\n\nhttp://x/a b 1.1.1.1 19990101000000 text/html 5\nhello\n"
    df = spark.createDataFrame([("d/f.arc.gz", bytearray(gzip.compress(arc)))], "path string, content binary")
    (r,) = convert(df).collect()
    assert (r.url, r.date, bytes(r.payload), r.page_id) == ("http://x/a b", "1999-01-01T00:00:00Z", b"hello", None)


def brute(rows):
    keeper = {}
    for i, _, h in rows:
        keeper[h or ""] = max(keeper.get(h or "", i), i)
    return sorted(
        (i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if keeper[h or ""] == i else "revisit", None if keeper[h or ""] == i else keeper[h or ""])
        for i, _, h in rows
    )


def result(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_query_equals_brute_force_and_sql(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = result(op4_warc(spark, sf))
    assert got == brute(rows)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
        assert sorted(c.sql(OP4_SQL).fetchall()) == got


@pytest.mark.parametrize("version", [1, 2])
def test_copies_nulls_and_files(spark, tmp_path, version):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (9, "http://c/ d", "same"), (3, "http://d/", None), (4, "", ""), (5, "u", "HTTP/1.1 x\r\n\r\n"), (6, "u", "é\r\n\r\nWARC/1.1\r\n"), (7, "u", "z" * 9_000_000), (8, "u", "z" * 9_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as head", "2 as keeper").repartition(3)
    assert result(archive_pages(df, version=version, path=f"file://{tmp_path}/w")) == brute(rows)
    seen = 0
    for p in (tmp_path / "w").glob("part-*"):
        data = gzip.decompress(p.read_bytes())
        for fields, block in read_warc(io.BytesIO(data)):
            assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["warc-record-id"])
            seen += fields["warc-type"] in ("response", "revisit")
            if fields["warc-type"] == "revisit":
                assert split_http(block)[1] == b"" and fields["warc-profile"]
    assert seen == len(rows)
    small = {r.page_id: r.record_type for r in archive_pages(df, min_bytes=5).collect()}
    assert small[1] == small[2] == small[9] == small[3] == "response" and small[7] == "revisit"


def test_empty_table_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, "v", "y")], "page_id long, url string, html string")
    assert archive_pages(df.limit(0)).count() == 0
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in archive_pages(df).collect() if True)
    assert got == [(0, "response", None), (0, "revisit", 1), (1, "response", None), (1, "revisit", 1)]


def test_files_close_by_size_with_a_member_for_each_record(spark, tmp_path):
    import zlib

    from tessera.llm.warc import arcs_of_pages, convert, read_warcs, write_warcs

    rows = [(i, f"http://a/{i}", f"{i} " + "".join(chr(33 + (i * j) % 90) for j in range(3000))) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    write_warcs(convert(arcs_of_pages(df)), f"file://{tmp_path}/w", file_bytes=4000)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 3
    for p in files:
        data, kinds = p.read_bytes(), []
        while data:
            d = zlib.decompressobj(31)
            member = d.decompress(data) + d.flush()
            data = d.unused_data
            kinds += [f["warc-type"] for f, _ in read_warc(io.BytesIO(member))] or [None]
        # One record in each member; an empty member ends the file.
        assert kinds[0] == "warcinfo" and kinds[-1] is None and set(kinds[1:-1]) == {"response"}
    assert read_warcs(spark, f"file://{tmp_path}/w").count() == len(rows)
