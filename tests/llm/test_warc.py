import base64
import gzip
import hashlib

from marlstone.llm import warc


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [(3, "http://a/3", "<p>x</p>"), (1, "http://a/1\r\nX: y", "<p>x</p>"), (2, None, None), (4, "http://a/4", ""), (5, "http://b/5", "é" * 70_000), (6, "http://b/6", "é" * 70_000), (None, "http://b/7", "alone"), (8, "u", "WARC/1.1\r\n\r\nWARC/1.1")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p") for r in rows], "page_id bigint, url string, html string, payload string")


def brute(rows, least):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "").encode() == data and j is not None), default=None)
        again = len(data) >= least and first is not None and i != first
        out.append((i, len(data), sha(data), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    for least in (0, 3):
        assert sorted(map(tuple, warc.round_trip(pages(spark, PAGES), least).collect()), key=str) == brute(PAGES, least)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_filters_and_payloads(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.archive_pages(pages(spark, PAGES), folder)
    whole = warc.read_archives(spark, folder)
    assert {r["page_id"]: r["payload"] for r in whole.where("record_type = 'response'").collect()}[5] == bytearray("é".encode() * 70_000)
    assert {r["page_id"] for r in whole.where("record_type = 'revisit'").collect()} == {3, 4, 6}
    assert [r["page_id"] for r in whole.where("target_uri like 'http://b/%' and page_id in (6, 1)").collect()] == [6]
    assert warc.read_archives(spark, folder, payload=False).where("payload is not null").count() == 0


def test_headers_come_first_and_unwanted_blocks_stay_unread(tmp_path):
    records = [warc.compose(i, f"http://x/{i}", b"p" * 300_000, 300_000, sha(b"p" * 300_000), None, "1970-01-01T00:00:00Z") for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.member, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    assert gzip.decompress((tmp_path / "a.warc.gz").read_bytes()) == b"".join(records)
    reader = warc.WarcReader({"path": f"file://{tmp_path}", "split_bytes": "400000"})
    reader.tests.append(("in", "x-page-id", ("2", "4")))
    found = [v for p in reader.partitions() for b in reader.read(p) for v in b.column("page_id").to_pylist()]
    assert sorted(found) == [2, 2, 4, 4]


def test_members_without_length_and_other_writers(tmp_path):
    record = warc.compose(1, "http://x/", b"hi", 2, sha(b"hi"), None, "1970-01-01T00:00:00Z")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    reader = warc.WarcReader({"path": f"file://{tmp_path}", "payload": "true", "verify": "true"})
    assert [v for p in reader.partitions() for b in reader.read(p) for v in b.column("payload").to_pylist()] == [b"hi", b"hi"]


def test_every_split_of_plain_archives_gives_all_records(tmp_path):
    bodies = [b"x", b"", b"a\r\n\r\nWARC/1.1\r\n\r\nb", b"y" * 40]
    records = b"".join(warc.compose(i, None, b, len(b), sha(b), None, "1970-01-01T00:00:00Z") for i, b in enumerate(bodies))
    for version in (b"1.0", b"1.1"):
        data = records.replace(b"WARC/1.1\r\nWARC-Type", b"WARC/" + version + b"\r\nWARC-Type")
        (tmp_path / "a.warc").write_bytes(data)
        for split in range(1, len(data) + 1):
            reader = warc.WarcReader({"path": f"file://{tmp_path}", "split_bytes": str(split)})
            parts = reader.partitions() if split > 40 else [warc.Archive(f"file://{tmp_path}/a.warc", s, e) for s, e in ((0, split), (split, len(data)))]
            assert [v for p in parts for b in reader.read(p) for v in b.column("payload").to_pylist()] == bodies


def test_one_member_for_all_records_and_odd_addresses(spark, tmp_path):
    import gzip

    urls = ["http://a/ ", "http://b/\r\nx", None]
    records = [warc.compose(i, u, b"payload %d" % i, 9, warc.digest(b"payload %d" % i), None, "2020-01-01T00:00:00Z") for i, u in enumerate(urls)]
    for name, data in (("one", gzip.compress(b"".join(records))), ("each", b"".join(map(gzip.compress, records))), ("mixed", gzip.compress(b"".join(records[:2])) + warc.member(records[2])), ("own", b"".join(map(warc.member, records)))):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.warc.gz").write_bytes(data)
        rows = warc.read_archives(spark, f"file://{folder}", verify=True).collect()
        assert [(r["page_id"], r["target_uri"], bytes(r["payload"])) for r in sorted(rows, key=lambda r: r["page_id"])] == [(i, u, b"payload %d" % i) for i, u in enumerate(urls)]
        assert warc.read_archives(spark, f"file://{folder}").where("target_uri = 'http://a/ '").count() == 1


def test_a_long_payload_in_time(spark, tmp_path):
    import time

    body = bytes(range(256)) * 160_000
    data = warc.member(warc.compose(1, "http://a/", body, len(body), warc.digest(body), None, "2020-01-01T00:00:00Z"))
    (tmp_path / "x.warc.gz").write_bytes(data)
    import pyarrow.fs as pafs

    began = time.time()
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.warc.gz")) as source:
        [(head, block)] = [(h, b()) for h, b in warc._packed_records(warc._Bytes(source, 0))]
    assert block.endswith(body) and time.time() - began < 5


def test_joins_of_hot_keys(spark):
    from pyspark.sql import functions as F

    from marlstone.llm._shared import left_join_counted

    left = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 30), ("c", 31), (None, 32)], "k string, x int")
    right = spark.createDataFrame([("a", 20, "A"), ("b", 1, "B")], "k string, n int, v string")
    got = left_join_counted(left, right, "k", "n", F.lit(8), hot=10, most_bytes=0).select("k", "x", "v").collect()
    assert sorted((r["x"], r["v"]) for r in got) == [*((i, "A") for i in range(20)), (30, "B"), (31, None), (32, None)]
