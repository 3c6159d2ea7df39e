"""Archives: what is written is read back."""

from __future__ import annotations

import base64
import hashlib

import zstandard

from hitloom.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, bundle string"


def frame(spark, rows):
    return spark.createDataFrame([(p, u, h, "x", "y") for p, u, h in rows], SCHEMA)


def test_round_trip(spark):
    rows = [(i, f"http://a.b/{i}", f"<p>page {i % 50} é</p>\r\n\r\n" * (i % 9)) for i in range(300)]
    rows += [(1000, None, None), (1001, "http://x y/\n", ""), (None, "http://n", "<p>only null</p>"), (1002, "u", "z" * 600_000), (1002, "u", "z" * 600_000), (None, "http://n", "z" * 600_000)]
    got = warc.archive_round_trip(frame(spark, rows)).collect()
    first: dict[str, int] = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        revisit = (h or "") in first and p != first[h or ""]
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.archive_round_trip(frame(spark, [])).collect() == []


def test_frames_are_independent_and_seekable(spark, tmp_path):
    bundles = warc.write_bundles(frame(spark, [(i, f"u{i}", f"page {i} " * 400) for i in range(200)]), frame_bytes=5_000, bundle_bytes=6_000)
    rows = bundles.collect()
    assert len(rows) > 1
    for row in rows:
        data = bytes(row["data"])
        places = warc.frame_places(data)
        plain = [zstandard.ZstdDecompressor().decompress(data[a : a + n], max_output_size=m) for a, n, m in places]
        for entry in row["records"]:
            raw = plain[entry["frame"]][entry["offset"] : entry["offset"] + entry["length"]]
            fields, payload, size = warc.parse_record(raw)
            assert fields["WARC-Record-ID"].strip("<>") == entry["record_id"] and len(payload) == size
    paths = [r.path for r in warc.export(bundles, f"file://{tmp_path}").collect()]
    assert len(paths) == len(list(tmp_path.iterdir())) == len(rows)
