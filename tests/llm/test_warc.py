"""Archive conversion: parsing, writing, reading back."""

from __future__ import annotations

import base64
import hashlib

import pytest

from jobmix.llm.warc import (arc_head, arc_record, parse_arc, parse_warc, read_arc, read_warc, record_id, to_warc,
                             write_arc)


def sha(payload: str) -> str:
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_by_declared_fields_and_lengths(version):
    # A payload that looks like record borders must not confuse the reader.
    bodies = ["", "<p>é\n\nhttp://x 1.2.3.4 20200101000000 text/html 5\nhello", "a\r\n\r\nWARC/1.1\r\n\r\n"]
    content = arc_head(version) + b"\n" + b"\n".join(arc_record(version, i, f"http://h/{i}", b)
                                                     for i, b in enumerate(bodies)) + b"\n"
    records = list(parse_arc(content))
    assert [r["payload"].decode() for r in records] == bodies
    assert [r["URL"] for r in records] == [f"http://h/{i}" for i in range(3)]
    assert ("Result-code" in records[0]) == (version == 2)


def test_arc_url_with_blanks_and_records_without_http_head():
    content = arc_head(1) + b"\nhttp://a b/c 1.1.1.1 20200102030405 text/plain 3\nabc\n"
    (record,) = parse_arc(content)
    assert record["URL"] == "http://a b/c" and record["payload"] == b"abc" and record["http"] == b""


def test_cut_short_records_are_errors():
    with pytest.raises(ValueError, match="cut short"):
        list(parse_arc(arc_head(1) + b"\nu 1.1.1.1 20200102030405 text/plain 30\nabc\n"))
    with pytest.raises(ValueError, match="cut short"):
        list(parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError, match="not a WARC"):
        list(parse_warc(b"HTTP/1.1 200 OK\r\n\r\n"))


@pytest.mark.parametrize("per_file", [2, 4, 5000])
def test_round_trip(spark, tmp_path, per_file):
    same, tricky = "<p>same</p>", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\n\ny"
    pages = [(i, f"http://h/{i} ü", same, 1) for i in range(20)] + [
        (30, None, None, 1), (31, "", "", 1), (32, "http://t", tricky, 1), (33, "http://t", tricky, 1),
        (34, "http://u", "ünï\x00cödé" * 30_000, 1), (35, "http://u", "one", 1), (35, "http://u", "one", 1),
        (None, "http://n", same, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload long").repartition(3)
    arc = write_arc(df, str(tmp_path / "arc"), per_file)
    assert read_arc(spark, arc).count() == len(pages)
    out = read_warc(spark, to_warc(spark, arc, str(tmp_path / "warc"), per_file)).collect()
    holder = {}
    for page_id, _, html, _ in pages:
        if page_id is not None:
            holder[html or ""] = max(holder.get(html or "", page_id), page_id)
    want = []
    for page_id, _, html, _ in pages:
        first = page_id is None or holder[html or ""] == page_id
        want.append((page_id, len((html or "").encode()), sha(html or ""), "response" if first else "revisit",
                     None if first else holder[html or ""]))
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    by_page = {r.page_id: r for r in out}
    assert all(r.refers_to_record == by_page[r.refers_to].record_id for r in out if r.refers_to is not None)
    assert by_page[3].url == "http://h/3%20ü" and by_page[30].url == "about:blank"
    assert by_page[3].date == "2020-01-01T00:00:03Z"
    assert by_page[32].record_id == record_id(32, sha(tricky), "http://t")


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    arc = write_arc(pages, str(tmp_path / "arc"))
    assert read_warc(spark, to_warc(spark, arc, str(tmp_path / "warc"))).collect() == []


def test_equal_to_sql_also_without_page_ids(spark, tmp_path):
    import duckdb

    from jobmix.llm.warc import OP2_SQL, op2_warc
    pages = [(1, "u", "same"), (2, "u", "same"), (None, "u", "same"), (None, "u", "alone"), (3, "u", None), (4, "u", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    out = op2_warc(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        want = db.execute(f"SELECT {', '.join(names)} FROM ({OP2_SQL})").fetchall()
    assert sorted(map(tuple, out.select(names).collect()), key=str) == sorted(want, key=str)
    assert sum(r[3] == "revisit" for r in want) == 2
