from __future__ import annotations

import base64
import hashlib
import random

from tessera.llm import media, warc


def test_every_page_of_a_table(spark, sf):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    last = {}
    for i, h in pages:
        last[h] = max(i, last.get(h, -1))
    got = {r.page_id: r for r in warc.op2_warc(spark, sf).collect()}
    for i, h in pages:
        r = got[i]
        first = last[h] == i
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first else "revisit", None if first else last[h], True)


def test_same_rows_as_sql(spark, sf):
    import oracle

    from tessera.llm import registry

    for name, sql in registry.ORACLE_SQL.items():
        assert oracle.differences(registry.QUERIES[name](spark, sf), oracle.connect(sf), sql) == ""


def test_features_of_a_table(spark, sf):
    """op3_media's digests against the texts themselves, and the stored form's against a stream made alone."""
    import zlib

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in media.op3_media(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, raw in docs.items():
        whole = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        stream = bytes(media.mux_bytes(whole))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest()) and r.feature


def test_odd_pages_in_small_chunks(spark):
    big = "é" * 5000
    rows = [(1, "u\r\nx", big, "a"), (2, None, big, "a"), (None, "a", "x", "a"), (3, "a", "x", None), (3, "a", "x", None), (None, None, None, ""), (5, "", "", ""), (6, "z\n", None, "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_no string")
    got = sorted((tuple(r) for r in warc.read(warc.write(warc.classified(df), 1000).cache()).collect()), key=str)
    assert all(r[-1] for r in got) and len(got) == 8
    assert [(r[0], r[2], r[4], r[5]) for r in got if r[2] > 1] == [(1, 10000, "revisit", 2), (2, 10000, "response", None)]
    assert [(r[0], r[4], r[5]) for r in got if r[2] == 1] == [(3, "response", None), (3, "response", None), (None, "revisit", 3)]
    assert [(r[0], r[4]) for r in got if r[2] == 0] == [(5, "revisit"), (6, "response"), (None, "revisit")]
    assert warc.read(warc.write(warc.classified(df.limit(0)))).count() == 0


def test_a_damaged_chunk_is_seen():
    head = warc.record_head(1, 0, "u", 5000, hashlib.sha1(b"x" * 5000).digest(), None)
    chunks = list(warc.record_chunks(head, memoryview(b"x" * 5000), 1000))
    for damage in (False, True):
        r = warc.Reader()
        for k, n, digest, data in chunks:
            r.add(k, n, digest, data.replace(b"xxx", b"xyx") if damage and k == 3 else data)
        assert r.row()[-1] is not damage


def test_streams_round_trip():
    rng = random.Random(3)
    for n in [0, 1, 64, 162, 163, 164, 176, 177, 183, 184, 185, 16383, 16384, 16385, 16546, 16547, 100000, *range(64, 12800, 64)]:
        payload = media.padded(rng.randbytes(n))
        stream = media.mux_bytes(payload)
        s = media.demux_bytes(stream)
        assert s.payload == payload and len(stream) % media.PACKET == 0
        assert not (s.counter_errors or s.bad_packets or s.bad_tables)
        assert [u[2] for u in s.units] == [k * media.UNIT_TICKS for k in range(len(s.units))] and all(u[3] for u in s.units)


def test_lost_and_damaged_packets_are_counted():
    stream = bytearray(media.mux_bytes(bytes(64000)))
    gone = bytes(stream[: 188 * 5] + stream[188 * 6 :])
    assert media.demux_bytes(gone).counter_errors == 1
    stream[188 * 7] = 0
    assert media.demux_bytes(bytes(stream)).bad_packets == 1
    stream = bytearray(media.mux_bytes(b"x" * 64))
    stream[10] ^= 1
    assert media.demux_bytes(bytes(stream)).bad_tables == 1


def test_media_columns(spark):
    df = spark.createDataFrame([(1, "é", "a"), (1, "é", "b"), (None, None, None), (3, "x" * 40000, "c")], "doc_id long, text string, media string")
    got = sorted(media.digests(media.mux(df)).collect(), key=str)
    for r, t in zip(got, ["é", "é", "x" * 40000, ""], strict=True):
        want = media.padded(t.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(t.encode()), len(want), hashlib.sha256(want).hexdigest())
    units = {r.doc_id: r.units for r in media.demux(media.mux(df)).collect()}
    assert [u.bytes for u in units[3]] == [16384, 16384, 7232]
    assert media.digests(media.mux(df.limit(0))).count() == 0
