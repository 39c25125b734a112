from __future__ import annotations

import base64
import hashlib
import struct
import tracemalloc
import zlib

import pytest

from ledgerlens.llm import media_matroska as M
from ledgerlens.llm import warc as W
from tests.llm.cases import documents, ids_and_texts


def test_digests_of_whole_texts(spark):
    docs = documents(spark)
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in M.media_digests(docs).collect()), key=repr)
    want = []
    for i, t in ids_and_texts(docs):
        raw = (t or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want, key=repr)
    assert M.media_digests(docs.limit(0)).count() == 0


def vint_by_hand(data, at, size):
    """(value, next) of an EBML number; ids keep their marker bit."""
    width = next(w for w in range(1, 9) if data[at] & 0x80 >> w - 1)
    value = int.from_bytes(data[at : at + width], "big")
    return value ^ (1 << 7 * width if size else 0), at + width


def walked(data, at, end, masters):
    """(id, start, end) of every element, masters entered, read by another walk than the parser's."""
    while at < end:
        kind, at = vint_by_hand(data, at, False)
        size, at = vint_by_hand(data, at, True)
        yield kind, at, at + size
        if kind in masters:
            yield from walked(data, at, at + size, masters)
        at += size
    assert at == end


def test_stored_bytes_and_features_by_another_reader(spark):
    """media_bytes, media_sha256 and feature, from the stored file walked element by element."""
    docs = documents(spark).union(documents(spark).limit(1).selectExpr("9999", "repeat('long text é ', 90000)", "lang", "source", "n_chars", "Score", "line", "size", "row", "bucket", "rank"))
    got = {(r.doc_id, r.payload_sha256): r for r in M.media_digests(docs).collect()}
    for i, t in ids_and_texts(docs):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i, hashlib.sha256(payload).hexdigest()]
        data = M.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        found = [*walked(data, 0, len(data), {M.SEGMENT, M.CLUSTER, M.CUES, M.TRACKS, M.TRACK_ENTRY})]
        count = lambda kind: sum(k == kind for k, *_ in found)
        packets = -(-len(payload) // M.SAMPLES)
        blocks = [data[a + 3] >> 1 & 3 for k, a, _ in found if k == M.SIMPLE_BLOCK]  # after a track number of one byte, a time of two
        said = dict(x.split("=") for x in r.feature.split(";"))
        assert (said["tracks"], said["clusters"], said["cues"], said["packets"]) == ("1", str(count(M.CLUSTER)), str(count(M.CUE_POINT)), str(packets))
        assert sum(int(said[k]) for k in M.LACING) == packets and {M.LACING[b] for b in blocks} == {k for k in M.LACING if said[k] != "0"}
        assert (int(said["sum"]), int(said["peak"]), int(said["rises"])) == (sum(payload), max(payload), sum(b > a for a, b in zip(payload, payload[1:])))
        assert int(said["last_ms"]) == (packets - 1) * M.SAMPLES * 1000 // M.HERTZ


@pytest.mark.parametrize("n", [64, 512, 576, 4096, 4160, 131072, 131136, 300032])
def test_files_read_back(n):
    raw = bytes(i * 7 % 251 for i in range(n))
    got = M.parse(M.store(raw))
    data = M.store(raw)
    assert got["error"] is None and b"".join(data[a : a + s] for _, _, a, s, _, _ in got["packets"]) == raw
    assert [t for _, t, *_ in got["packets"]] == [i * 64_000_000 for i in range(len(got["packets"]))]
    assert sorted(c for _, _, c in got["cues"]) == got["clusters"]


def hand_made(block, unknown=False, group=False):
    size = b"\x01" + b"\xff" * 7 if unknown else None
    inner = M.number(M.CLUSTER_TIME, 1000) + (M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block)) if group else M.element(M.SIMPLE_BLOCK, block))
    cluster = M.element(M.CLUSTER, inner) if not unknown else M.CLUSTER.to_bytes(4, "big") + size + inner
    body = cluster + M.element(M.CUES, M.element(M.CUE_POINT, M.number(M.CUE_TIME, 1000) + M.element(M.CUE_PLACE, M.number(M.CUE_TRACK, 1) + M.number(M.CUE_CLUSTER, 0))))
    head = M.element(M.EBML, M.element(0x4282, b"webm"))
    return head + (M.SEGMENT.to_bytes(4, "big") + size + body if unknown else M.element(M.SEGMENT, body))


def test_lacings_unknown_sizes_and_block_groups():
    frames = [b"a" * 300, b"b" * 255, b"c" * 10]
    xiph = M.vint(1) + struct.pack(">hB", -5, 0x80 | 1 << 1) + bytes([2, 255, 45, 255, 0]) + b"".join(frames)
    for unknown in (False, True):
        for group in (False, True):
            data = hand_made(xiph, unknown, group)
            got = M.parse(data)
            assert got["error"] is None and [data[a : a + s] for _, _, a, s, _, _ in got["packets"]] == frames
            assert {(p[1], p[5]) for p in got["packets"]} == {(995_000_000, "xiph")} and got["clusters"] == [0] and len(got["cues"]) == 1
    ebml = M.block(frames, 3)
    data = hand_made(ebml)
    assert [data[a : a + s] for _, _, a, s, _, _ in M.parse(data)["packets"]] == frames


def test_damage_is_told_and_kept_to_its_row(spark):
    whole = M.store(b"x" * 6400)
    rows = [(1, whole), (2, whole[:-3]), (3, b""), (4, None), (5, b"\x00\x01"), (6, whole[:200])]
    got = M.packets(spark.createDataFrame(rows, "k int, content binary"), "k", "content").collect()
    errors = {r.key: r.error for r in got if r.error}
    assert set(errors) == {2, 3, 4, 5, 6} and sum(r.key == 1 and r.packet is not None for r in got) == 13
    for n in range(len(whole)):
        assert M.parse(whole[:n])["error"]


PAGES = "page_id bigint, url string, html string, target string, digest string"


def test_warc_round_trip(spark):
    rows = [(5, "http://a/\n x", "same", "t", "d"), (3, "u", "same", "t", "d"), (9, None, "same", None, None), (3, "u", "same", None, None), (1, "u", None, None, None), (2, "u", "", None, None), (7, "u", "é" * 70_000, None, None), (None, "u", "same", None, None), (None, None, None, None, None)]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.roundtrip(spark.createDataFrame(rows, PAGES)).collect()), key=repr)
    least = {"same": 3, "": 1, "é" * 70_000: 7}
    want = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        first = least[html or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *(("response", None) if i == first else ("revisit", first))))
    assert got == sorted(want, key=repr)
    assert W.roundtrip(spark.createDataFrame([], PAGES)).count() == 0


def payloads(chunks):
    return [(h["warc-record-id"], W.understood(h, block)) if h else block for _, _, h, block in W.Reader(chunks)]


def test_reader_is_incremental_and_verifies():
    records = [W.record(i, "u", bytes([i]) * (i * 1000), None, False) for i in range(1, 5)]
    stream = b"".join(records)
    for size in (1, 7, 4096, len(stream)):
        got = [*W.Reader(stream[i : i + size] for i in range(0, len(stream), size))]
        assert [len(r) for r in records] == [n for _, n, _, _ in got] and [at for at, *_ in got] == [sum(map(len, records[:k])) for k in range(4)]
        assert [W.understood(h, b)[0] for _, _, h, b in got] == [bytes([i]) * (i * 1000) for i in range(1, 5)]
    plain = zlib.decompress(records[0], 31)
    pack = lambda data: (lambda c: c.compress(data) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    for bad in (plain[:-1], plain + b"x", plain.replace(b"WARC/1.1", b"HTTP/1.1"), plain.replace(b"Content-Length: 1", b"Content-Length: x"), plain[:40], b""):
        assert [type(x) for x in payloads([pack(bad)])] == [str]
    got = payloads([pack(plain.replace(b"\x01\x01", b"\x01\x02", 1))])
    assert got[0][1][3] is False and got[0][1][4] == "block digest differs"
    assert [type(x) for x in payloads([stream[:-5]])] == [tuple] * 3 + [str]


def test_reader_goes_on_after_damage():
    records = [W.record(i, "u", bytes(range(256)) * 40 + bytes([i]), None, False) for i in range(6)]
    hurt = bytearray(records[2])
    hurt[len(hurt) // 2] ^= 0x55
    stream = records[0] + records[1][:-9] + bytes(hurt) + b"junk \x1f\x8b\x08 junk" + records[3] + records[4][:30] + records[5] + b"tail"
    for size in (1, 13, 1 << 16):
        got = [*W.Reader(stream[i : i + size] for i in range(0, len(stream), size))]
        assert [h["warc-record-id"][10:-1] for _, _, h, _ in got if h] == ["0", "3", "5"] or [h["warc-record-id"][10:-1] for _, _, h, _ in got if h] == ["0", "2", "3", "5"]
        assert sum(n for _, n, _, _ in got) == len(stream) and [at for at, *_ in got] == [sum(n for _, n, _, _ in got[:k]) for k in range(len(got))]


def test_inflation_is_bounded():
    pack = lambda data: (lambda c: c.compress(data) + c.flush())(zlib.compressobj(9, zlib.DEFLATED, 31))
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: "
    bomb = pack(head + b"10\r\n\r\n" + bytes(50_000_000))
    wide = pack(b"WARC/1.1\r\n" + b"X: y\r\n" * 3_000_000)
    huge = pack(head + b"99999999999\r\n\r\n")
    tracemalloc.start()
    got = payloads([bomb + wide + huge + W.record(1, "u", b"p", None, False)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [type(x) for x in got] == [str, str, str, tuple] and peak < 12 << 20


def test_digests_of_other_kinds():
    data = b"some bytes"
    for kind in ("sha1", "sha256", "md5"):
        raw = hashlib.new(kind, data).digest()
        for value in (raw.hex(), raw.hex().upper(), base64.b32encode(raw).decode(), base64.b32encode(raw).decode().rstrip("=")):
            assert W.agrees(f"{kind}:{value}", data) is True and W.agrees(f"{kind}:{value}", data + b"x") is False
    assert W.agrees("blake3:abc", data) is None and W.agrees(None, data) is None and W.agrees("sha1:", data) is None


def test_the_full_record_table(spark):
    rows = [(i, f"http://a/{i}", b"payload %d" % i, 1 if i == 3 else None, i == 3) for i in range(1, 4)]
    stream = b"".join(W.record(*r) for r in rows)
    got = W.read_archives(spark.createDataFrame([(stream, "x"), (None, "y"), (b"", "z")], "content binary, offset string")).orderBy("offset").collect()
    assert [(r.target_uri, r.record_type, r.refers_to, r.verified, r.error, r.date, r.payload_bytes) for r in got] == [(f"http://a/{i}", "revisit" if i == 3 else "response", "<urn:page:1>" if i == 3 else None, True, None, "2000-01-01T00:00:00Z", 9) for i in (1, 2, 3)]
    assert [bytes(r.payload) for r in got] == [b"payload 1", b"payload 2", b""]


def test_many_repeated_payloads_are_joined_by_shuffle(spark, monkeypatch):
    rows = [(i, "u", f"page {i % 300}" if i % 3 else f"only {i}", None, None) for i in range(2000)] + [(None, "u", "page 1", None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    key = lambda r: repr(tuple(r))
    want = sorted(W.roundtrip(pages).collect(), key=key)
    monkeypatch.setattr(W, "SMALL_REPEATS", 10)
    assert sorted(W.roundtrip(pages).collect(), key=key) == want and sum(r.record_type == "revisit" for r in want) > 900


def test_damaged_archives_tell_so(spark):
    a, b = (W.record(i, "u", b"p", None, False) for i in (1, 2))
    got = W.read_archives(spark.createDataFrame([(a + b[:-9],), (b,), (None,), (b"",)], "content binary")).collect()
    assert sorted(r.record_id for r in got if r.record_id) == ["<urn:page:1>", "<urn:page:2>"] and sum(r.error is not None for r in got) == 1


def test_headers_of_any_length(spark):
    """Urls whose quoted form is far beyond a megabyte come back whole."""
    url = "http://a/" + "é" * 350_000
    rows = [(1, url, "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, "u" * 3_000_000, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    archives = W.write_archives(W.with_targets(pages))
    got = {r.record_id: r for r in W.read_archives(archives).collect()}
    assert all(r.error is None and r.verified for r in got.values()) and len(got) == 3
    assert len(got["<urn:page:1>"].target_uri) == 9 + 6 * 350_000 and got["<urn:page:3>"].target_uri == "u" * 3_000_000
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in W.roundtrip(pages).collect()} == {(1, "response", None, 10), (2, "revisit", 1, 10), (3, "response", None, 0)}
    assert all("longer than 1000 bytes" in r.error for r in W.read_archives(archives, limit=1000).filter("error is not null").collect())
    no_end = zlib.compress(b"WARC/1.1\r\n" + b"x" * 2_000_000, wbits=31)
    (r,) = W.read_archives(spark.createDataFrame([(no_end,)], "content binary")).collect()
    assert r.error == "record has no header end" and r.length == len(no_end)
