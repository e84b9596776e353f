"""Legacy archives and WARC: formats byte by byte, and round trips."""

import base64
import gzip
import hashlib

import pytest

from meterlake.llm import warc


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def archive(version, records, name="old.arc"):
    return b"\n".join([warc.arc_head(version, name), *(warc.arc_record(version, name, k, u, p) for k, u, p in records)]) + b"\n"


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, lambda d: gzip.compress(d[:100]) + gzip.compress(d[100:])])
def test_records_are_found_by_declared_length(version, pack):
    payloads = [b"", b"<html>\n\nhttp://x 1.2.3.4 20010101000000 text/html 5\n</html>", b"\r\n\r\nWARC/1.1\r\n" * 3, "é日本".encode() * 40_000]
    data = pack(archive(version, [(i, "http://a.example/b c", p) for i, p in enumerate(payloads)]))
    rows = list(warc.parse_arc(data, True))
    assert rows[0][2] == version and rows[0][3] is None and rows[0][0] == "old.arc"
    assert [(r[2], r[3], r[7], r[10], r[11]) for r in rows[1:]] == [(version, "http://a.example/b%20c", i, len(p), digest(p)) for i, p in enumerate(payloads)]
    plain = archive(version, [(i, "http://a.example/b c", p) for i, p in enumerate(payloads)])
    assert all(plain[r[1]:].startswith(b"http://a.example/b%20c ") for r in rows[1:])


def test_unescaped_url_and_bare_payload():
    data = b"filedesc://x.arc 0.0.0.0 19990101000000 text/plain 8\n1 0 abc\n\nhttp://h/a b 1.2.3.4 1999 image/gif 4\nGIF8\ndns:h 1.2.3.4 19990101 text/dns 3\nh A\n"
    rows = list(warc.parse_arc(data, True))
    assert [(r[3], r[4], r[6], r[10]) for r in rows[1:]] == [("http://h/a b", "1.2.3.4", "image/gif", 4), ("dns:h", "1.2.3.4", "text/dns", 3)]


@pytest.mark.parametrize("tail", [b"http://h 1.2.3.4 19990101000000 text/html 99\nshort", b"not a header line\n"])
def test_a_broken_archive_ends_with_a_problem(tail):
    rows = list(warc.parse_arc(warc.arc_head(1, "x") + b"\n" + tail, True))
    assert rows[-1][-1] and all(r[-1] is None for r in rows[:-1])


def test_dates_and_ids():
    assert warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.warc_date("1999") == "1999-01-01T00:00:00Z"
    assert warc.warc_date("?") == warc.warc_date(None) == "1970-01-01T00:00:00Z"
    assert warc.record_id("a", 1) == warc.record_id("a", 1) != warc.record_id("a", 2)


def pages(spark):
    rows = [(5, "http://a/1", "same"), (3, "http://a/2", "same"), (9, None, "same"), (1, "http://b/ü x", None), (2, "http://b/2", ""), (4, "http://c", "é" * 50_000), (4, "http://c", "é" * 50_000), (7, "http://d", "\r\n\r\nWARC/1.1\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_conversion_keeps_every_record(spark, tmp_path):
    df, rows = pages(spark)
    warc.write_arc(df.repartition(3), str(tmp_path / "arc"), "page_id", "url", "html")
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = warc.read_warc(spark, str(tmp_path / "warc"), with_payload=True).collect()
    assert sorted((r["key"], r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((k, len((h or "").encode()), digest((h or "").encode())) for k, _, h in rows)
    by_digest = {}
    for k, _, h in rows:
        by_digest[h or ""] = min(k, by_digest.get(h or "", k))
    for r in got:
        first = next(v for h, v in by_digest.items() if digest(h.encode()) == r["payload_digest"])
        if r["record_type"] == "response":
            assert r["key"] == first and r["refers_to_key"] is None and digest(r["payload"]) == r["payload_digest"]
        else:
            assert r["record_type"] == "revisit" and r["refers_to_key"] == first
    ids = {r["record_id"]: r for r in got}
    assert len(ids) == len(got)
    assert all(ids[r["refers_to_id"]]["record_type"] == "response" for r in got if r["record_type"] == "revisit")
    assert sum(r["record_type"] == "response" for r in got) == len(by_digest)


def test_small_payloads_are_all_responses(spark, tmp_path):
    df, rows = pages(spark)
    warc.write_arc(df, str(tmp_path / "arc"), "page_id", "url", "html")
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), least_bytes=5)
    got = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert sorted(r["key"] for r in got if r["record_type"] == "revisit") == [4]


def test_empty_table(spark, tmp_path):
    df, _ = pages(spark)
    warc.write_arc(df.filter("false"), str(tmp_path / "arc"), "page_id", "url", "html")
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    assert warc.read_warc(spark, str(tmp_path / "warc")).count() == 0


def test_keys_of_64_bits_and_null_keys(spark, tmp_path):
    big, least = 2**63 - 1, -(2**63)
    assert [warc.record_key(x) for x in (str(big), str(least), str(big + 1), "x", "", None)] == [big, least, None, None, None, None]
    rows = [(None, "http://a/0", "same"), (big, "http://a/1", "same"), (10**18, "http://a/2", "same"), (least, "http://b", "other"), (None, "http://c", "third")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_arc(df, str(tmp_path / "arc"), "page_id", "url", "html")
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = {(r["url"], r["key"], r["record_type"], r["refers_to_key"]) for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert got == {("http://a/0", None, "revisit", 10**18), ("http://a/1", big, "revisit", 10**18), ("http://a/2", 10**18, "response", None), ("http://b", least, "response", None), ("http://c", None, "response", None)}


def test_clashing_columns_and_repeated_rows(spark, tmp_path, monkeypatch):
    from meterlake.llm import shared

    rows = [(i % 7 if i % 5 else None, f"http://h/{i}", ("same", "other", None)[i % 3], 9, b"k", "a", i, "p", "v") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key long, payload binary, archive string, offset long, problem string, value string")
    got = []
    for k, most in enumerate((100_000, 0)):  # decisions broadcast, or joined with hot digests spread
        monkeypatch.setattr(shared, "BROADCAST_ROWS", most)
        warc.write_arc(df, str(tmp_path / f"arc{k}"), "page_id", "url", "html")
        warc.convert(spark, str(tmp_path / f"arc{k}"), str(tmp_path / f"warc{k}"))
        got.append(sorted(map(str, warc.read_warc(spark, str(tmp_path / f"warc{k}")).select("url", "key", "record_type", "refers_to_key", "payload_digest").collect())))
    assert got[0] == got[1] and len(got[0]) == 40 and sum("response" in x for x in got[0]) == 3
