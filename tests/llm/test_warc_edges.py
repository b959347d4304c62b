"""Archives of unusual tables, damaged archives, and merges over several ranges."""

import glob
import gzip

import pytest

from verdigris.llm import warc

SCHEMA = "page_id bigint, url string, html string, url_key string, offset int"


def written(spark, rows, path, per_file=3):
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), path, records_per_file=per_file)
    return [gzip.open(p).read() for p in sorted(glob.glob(f"{path}/*.gz"))]


def test_an_empty_table_and_clashing_columns(spark, tmp_path):
    written(spark, [], str(tmp_path / "e"))
    assert warc.capture_histories(spark, str(tmp_path / "e")).collect() == []
    written(spark, [(7, "http://a/", "x", "other", -5)], str(tmp_path / "c"))
    (row,) = warc.capture_histories(spark, str(tmp_path / "c")).collect()
    assert (row["page_id"], row["url_key"], row["offset"], row["payload_bytes"]) == (7, "a)/", 0, 1)


def test_repeated_rows_and_a_very_long_page(spark, tmp_path):
    long = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 100_000
    rows = [(1, "http://a/", long, None, None), (1, "http://a/", long, None, None), (2, "http://a/", long, None, None), (3, "u", "tiny", None, None), (3, "u", "tiny", None, None)]
    archives = written(spark, rows, str(tmp_path / "w"))
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.capture_histories(spark, str(tmp_path / "w")).collect())
    size = len(long.encode())
    assert got == [(1, "response", None, size), (1, "response", None, size), (2, "revisit", 1, size), (3, "response", None, 4), (3, "response", None, 4)]
    records = [r for data in archives for r in warc.parse_warc(data)]
    (revisit,) = [r["fields"] for r in records if r["fields"]["warc-type"] == "revisit"]
    assert revisit["warc-refers-to"] in {r["fields"]["warc-record-id"] for r in records if r["fields"]["x-page-id"] == "1"}
    for data in archives:
        assert all(data[r["offset"] :].startswith(b"WARC/1.1\r\n") for r in warc.parse_warc(data))


def test_damage_is_an_error(spark, tmp_path):
    (data,) = filter(None, written(spark, [(1, "http://a/", "payload " * 20, None, None)], str(tmp_path / "w")))
    assert len(list(warc.parse_warc(gzip.compress(data)))) == len(list(warc.parse_warc(data))) == 1
    for bad in (data[:40], data[:-60], data.replace(b"payload p", b"payload q", 1), b"x" + data):
        with pytest.raises(ValueError):
            list(warc.parse_warc(bad))


def test_one_url_over_many_ranges_is_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ENTRIES_PER_RANGE", 20)
    rows = [(i * 7919 % 400 if i % 5 else None, "http://hot/" if i % 3 else f"http://h{i % 11}/", f"text {i}", None, None) for i in range(400)]
    written(spark, rows, str(tmp_path / "w"), per_file=30)
    frame = warc.capture_histories(spark, str(tmp_path / "w"))
    assert frame.rdd.getNumPartitions() == 20
    out = [(r["url_key"], r["captured_at"], r["page_id"] is not None, r["page_id"] or 0, r["archive"], r["offset"]) for r in frame.collect()]
    assert out == sorted(out) and len(out) == 400
    assert max(frame.rdd.glom().map(len).collect()) < 100
