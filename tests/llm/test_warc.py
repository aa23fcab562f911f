import gzip
import hashlib
import io
import re

import pytest

from lexigrid.llm.warc import WarcError, load, members, qualified, read, record, round_trip, shared_dir, write

SCHEMA = "page_id long, url string, html string, digest string"


def test_pages_come_back_as_they_went(spark):
    long, short = "<p>" + "é" * 200, "<p>short"
    rows = [(5, "http://a/", long, "x"), (3, "http://b/", long, "x"), (9, None, long, "x"), (9, None, long, "x"), (1, "u\r\nv", short, "x"), (2, "u", short, "x"), (4, "u", None, "x"), (6, "u", "", "x"), (3, "http://c/", "other" * 50, "x"), (None, "u", long, "x"), (7, "u", "x" * 99, "x"), (8, "u", "x" * 99, "x")]
    got = round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        first = min((p for p, _, h, _ in rows if h == html and p is not None), default=None)
        revisit = len(body) >= 100 and i is not None and first is not None and i > first
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(bytes(r.payload).decode() == dict((p, h or "") for p, _, h, _ in rows if p not in (3,)).get(r.page_id, r.payload.decode()) for r in got if r.record_type == "response")
    assert round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_archives_are_one_gzip_member_for_each_record(spark):
    folder = f"{shared_dir(spark)}/plain"
    made = write(spark.createDataFrame([(i, "u", "x" * (300 + i), "") for i in range(20)], SCHEMA).coalesce(1), folder, archive_bytes=1000)
    paths = [r.path for r in made.collect()]
    assert len(paths) > 1
    data = open(paths[0], "rb").read()
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == data.count(b"\x1f\x8b\x08")
    assert load(made, folder).count() == 20
    with open(paths[0], "wb") as f:
        f.write(data[:-5])
    with pytest.raises(Exception, match="ends inside a member|incorrect|WarcError"):
        load(made, folder).collect()


@pytest.mark.parametrize("stretch", [1, 7, 1 << 16])
def test_the_reader_takes_any_stretch_and_checks(stretch):
    parts = [record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{i}>")], b"body%d" % i * i) for i in range(4)]
    stream = io.BytesIO(b"".join(parts))
    assert [b for _, b in read(stream.read, stretch)] == [b"body%d" % i * i for i in range(4)]
    bad = gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\nWARC-Block-Digest: sha256:00\r\n\r\nabc\r\n\r\n")
    with pytest.raises(WarcError, match="digest"):
        list(read(io.BytesIO(bad).read, stretch))
    with pytest.raises(WarcError, match="longer"):
        list(read(io.BytesIO(gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n")).read, stretch))
    with pytest.raises(WarcError, match="shorter"):
        list(read(io.BytesIO(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")).read, stretch))
    with pytest.raises(WarcError, match="inside"):
        list(read(io.BytesIO(parts[3][:-4]).read, stretch))


def test_records_have_the_headers_that_the_standard_asks_for(spark):
    rows = [(i, "http://a/", "x" * 300, "") for i in range(2)]
    made = write(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{shared_dir(spark)}/headers")
    with open(made.first().path, "rb") as f:
        for member in members(f.read):
            head = b"".join(member).split(b"\r\n\r\n")[0].decode().split("\r\n")
            names = dict(x.split(": ", 1) for x in head[1:])
            assert head[0] == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Target-URI", "WARC-Payload-Digest"} <= set(names)
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", names["WARC-Date"])
            assert names["Content-Type"] == "application/http; msgtype=response"
            assert (names["WARC-Type"] == "revisit") == ("WARC-Profile" in names)


def test_pages_fill_many_archives_and_very_long_ones_come_back(spark):
    rows = [(i, f"http://{i}/", str(i) * 400, "") for i in range(40)] + [(99, "u", "long " * 400_000, "")]
    got = round_trip(spark.createDataFrame(rows, SCHEMA).coalesce(2), archive_bytes=500).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: html for i, _, html, _ in rows}


def test_folders_lie_in_sparks_file_system(spark):
    assert qualified(spark, "/some/where").startswith("file:/") and qualified(spark, "file:///x") == "file:/x"
