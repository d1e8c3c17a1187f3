"""Segments of long streams: their bytes and the time that cutting takes."""

import time

import pytest

from wireloom.plans.carriers import carrier


def _whole(rows, size):
    parts = [bytes.fromhex(r.payload_hex) for r in sorted(rows, key=lambda r: r.seq)]
    assert [len(p) for p in parts[:-1]] == [size] * (len(parts) - 1) and 0 < len(parts[-1]) <= size
    assert [r.len for r in sorted(rows, key=lambda r: r.seq)] == [len(p) for p in parts]
    return b"".join(parts)


@pytest.mark.parametrize("body", ["", "a", "é\r" * 200, None])
def test_http_segments_hold_the_whole_stream(spark, tmp_path, body):
    spark.createDataFrame([(3, "http://u/é", body), (4, None, body)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    segments = carrier(spark, str(tmp_path), "http_segments").collect()
    assert {r.page_id for r in segments} == (set() if body is None else {3})  # a page without text, or with a null address in its header, has no stream
    for r in carrier(spark, str(tmp_path), "http_streams").where("header_hex || body_hex IS NOT NULL").collect():
        assert _whole([s for s in segments if s.page_id == r.page_id], 256) == bytes.fromhex(r.header_hex + r.body_hex)


def test_tls_segments_hold_the_whole_stream(spark, tmp_path):
    rows = [(1, 0, "user", "é" * 9000), (1, 1, "bot", ""), (2, 3, None, "x" * 40), (2, 4, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    segments = carrier(spark, str(tmp_path), "tls_segments").collect()
    streams = carrier(spark, str(tmp_path), "tls_streams").where("stream_hex IS NOT NULL").collect()
    assert {(r.conv_id, r.turn) for r in segments} == {(r.conv_id, r.turn) for r in streams}
    for r in streams:
        assert _whole([s for s in segments if (s.conv_id, s.turn) == (r.conv_id, r.turn)], 150) == bytes.fromhex(r.stream_hex)


def test_cutting_takes_time_in_proportion_to_a_long_page(spark, tmp_path):
    """Cut out of hex text, every segment of a page cost the whole page: minutes for this one."""
    spark.createDataFrame([(3, "http://u", "héllo wörld " * 200_000)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    began = time.monotonic()
    n, total = carrier(spark, str(tmp_path), "http_segments").selectExpr("count(payload_hex)", "sum(length(payload_hex)) / 2").first()
    assert time.monotonic() - began < 20
    assert total == len(("HTTP/1.1 200 OK\r\nHost: h3.example\r\nCookie: id=3\r\n folded=21\r\nAccept: */*\r\n\r\n" + "héllo wörld " * 200_000).encode()) and n == -(-total // 256)


def test_readers_of_lengths_build_no_segment(spark, tmp_path):
    rows = [(1, "a\nb" * 700, "s"), (2, "é" * 497, "s"), (3, "", None), (4, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    segments = carrier(spark, str(tmp_path), "long_http_segments")
    plan = lambda c: segments.select(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "substr(bytes" in plan("payload_hex") and "substr(bytes" not in plan("len")
    found = segments.select("frame_no", "len", "payload_hex").collect()
    assert {r.frame_no // 1_000_000 for r in found} == {1, 2, 3, 4} and all(r.len == len(r.payload_hex) // 2 > 0 for r in found)
