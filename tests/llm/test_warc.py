import base64
import hashlib
import os

import pytest

from tableguard.llm import queries, warc


def folder(path):
    return f"file://{path}"


PAGES = [(5, "http://a.example/x y\r\nz", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "http://b.example/", "<p>same</p>"), (1, "http://c.example/é", None), (2, "u", ""), (4, "u", "é😀\r\n\r\nWARC/1.1\r\n" * 3), (7, "big", "0123456789" * 400_000), (None, "n", "<p>null key</p>")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, record_type string").repartition(2)
    manifest = warc.write(df, folder(tmp_path / "a"))
    rows = warc.read(manifest).collect()
    assert sum(r.records for r in manifest.collect()) == len(PAGES) == len(rows)
    firsts = {}
    for page, _, html in PAGES:
        if page is not None:
            firsts[html or ""] = min(page, firsts.get(html or "", page))
    for r in rows:
        page, url, html = next(p for p in PAGES if p[0] == r.page_id)
        body = (html or "").encode()
        first = firsts.get(html or "", page)
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.record_type == ("response" if first == page else "revisit") and r.refers_to == (None if first == page else first)
        assert r.payload == (body if first == page else None)


def test_archive_layout(tmp_path):
    import zstandard as z

    a = warc.Archive(folder(tmp_path / "x.warc.zst"))
    records = [warc._record(k, f"http://e.example/{k}", f"<p>page {k}</p>".encode() * 50, "D", None, 0) for k in range(200)]
    for r in records:
        a.add(r)
    a.close()
    raw = (tmp_path / "x.warc.zst").read_bytes()
    size = int.from_bytes(raw[4:8], "little")
    assert raw[:4] == warc.MAGIC and list(warc.records(a.path)) == records
    d = z.ZstdCompressionDict(raw[8 : 8 + size])
    assert d.dict_id() != 0 and len(raw) < sum(map(len, records)) / 4
    first = z.ZstdDecompressor(dict_data=d).decompressobj()
    assert first.decompress(raw[8 + size :]) == records[0] and z.get_frame_parameters(raw[8 + size :]).dict_id == d.dict_id()


def test_cut_archive_is_an_error(tmp_path):
    a = warc.Archive(folder(tmp_path / "x.warc.zst"))
    a.add(os.urandom(5000))
    a.close()
    path = tmp_path / "x.warc.zst"
    whole = path.read_bytes()
    for left in (5, 100, 4000):
        path.write_bytes(whole[:-left])
        with pytest.raises(ValueError, match="cut off"):
            list(warc.records(a.path))


def test_small_payloads_are_never_revisited(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", "tiny") for k in range(3)], "page_id long, url string, html string")
    assert {r.record_type for r in warc.read(warc.write(df, folder(tmp_path), least=5)).collect()} == {"response"}


def test_many_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    df = spark.createDataFrame([(k, "u", f"page {k} " * 40) for k in range(100)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(df, folder(tmp_path))
    assert manifest.count() > 5 and warc.read(manifest).count() == 100


def test_each_archive_is_read_by_a_task_of_its_own(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, "u", f"page {k} " * 40) for k in range(100)], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    manifest = warc.write(df, folder(tmp_path))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    read = warc.read(manifest).select(F.spark_partition_id().alias("p")).collect()
    assert len(read) == 100 and len({r.p for r in read}) == manifest.count() >= 8


def test_text_keys(spark, tmp_path):
    keys = ["b", "a>\r\nx: y", "é %41", "a", None, ""]
    df = spark.createDataFrame([(k, "u", "same" if k in ("a", "b") else f"of {k}") for k in keys], "page_id string, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read(warc.write(df, folder(tmp_path)), kind="string").collect()}
    assert got == dict.fromkeys(keys) | {"b": "a"}


def test_empty_table(spark, tmp_path):
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder(tmp_path))).count() == 0


def test_oracle(spark, data, duck):
    from tests.conftest import same_rows

    same_rows(warc.op9_warc(spark, data), duck.execute(queries.oracle_sql()["op9_warc"]))
