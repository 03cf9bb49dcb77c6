import base64
import hashlib
import io
import struct

import pytest
import zstandard

from tallyweave.llm.warc import frames, parsed, record, round_trip


def test_round_trip_returns_every_page(spark):
    html = ["<p>one</p>", "<p>one</p>", None, "", "é" * 200000, "<p>one</p>", "x\r\n\r\ny"]
    rows = [(i * 3, f"http://e.org/{i}" if i else None, h, "zz") for i, h in enumerate(html)] + [(None, "u", "<p>null id</p>", "zz"), (0, "again", "<p>one</p>", "zz")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, response string").repartition(3)
    found = round_trip(spark, pages).collect()
    best = {}
    for page, _, h, _ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if page is None else page)
    want = []
    for page, url, h, _ in rows:
        b = (h or "").encode()
        same = page is None or page == best[h or ""]
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        want.append((page, url, len(b), digest, "response" if same else "revisit", None if same else best[h or ""], b if same else b""))
    got = [(x.page_id, x.url, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, bytes(x.payload)) for x in found]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert round_trip(spark, pages.limit(0)).collect() == []


def test_dictionary_frames_and_damage():
    words = b"<html><body>common words of every page " * 20
    data = record(5, "http://a/", words, None)
    compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    archive = struct.pack("<II", 0x184D2A5D, len(words)) + words + compressor.compress(data) + struct.pack("<II", 0x184D2A50, 3) + b"abc" + compressor.compress(data)
    assert list(frames(io.BytesIO(archive))) == [data, data]
    packed = zstandard.ZstdCompressor().compress(words)
    assert list(frames(io.BytesIO(struct.pack("<II", 0x184D2A5D, len(packed)) + packed + compressor.compress(data)))) == [data]
    with pytest.raises(ValueError, match="within a frame"):
        list(frames(io.BytesIO(archive[:-2])))
    assert parsed(data, "x")[:5] == (5, "http://a/", len(words), parsed(data, "x")[3], "response")
    for bad in (data.replace(b"common", b"Common", 1), data[:-1], data.replace(b"WARC/1.1", b"WARC/9.9"), data.replace(b"WARC-Date", b"WARC-Dato")):
        with pytest.raises(ValueError):
            parsed(bad, "x")
