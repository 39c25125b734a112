"""Media columns: Matroska files in a binary column, read into packet tables.

``packets`` parses EBML by itself: variable-length element ids and sizes (unknown sizes
included), clusters, simple blocks and block groups, the three kinds of lacing, and cues.
``store`` is the writer that the digest query uses: 8-bit PCM, laced, with one cue a cluster.

Cases: a null file gives no packets and the error "null"; a damaged file gives the packets
up to the damage and an error; an empty payload has no packets; rows are treated one by one,
so ties and repeated rows give equal results; texts of any length are stored and read whole,
in as many clusters as they need; an empty table stays empty; other columns, whatever their
names, are never read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import arrow_rows

EBML, SEGMENT, SEEKHEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC, FRAME_NS = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACING = ("none", "xiph", "fixed", "ebml")

SAMPLES, FRAMES, BLOCKS = 512, 8, 32  # samples a frame, frames a block, blocks a cluster
HERTZ = 8000
PAD = 64


# ---------------------------------------------------------------- writing


def vint(n: int, width: int = 0) -> bytes:
    """A size as an EBML variable-length integer; all ones are left for "unknown"."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(tag: int, body: bytes) -> bytes:
    return tag.to_bytes((tag.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(tag: int, n: int) -> bytes:
    return element(tag, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block(frames: list[bytes], ticks: int) -> bytes:
    """A simple block of track 1: unlaced for one frame, fixed-size lacing for equal frames,
    EBML lacing (first size, then signed differences) else."""
    sizes = [len(f) for f in frames]
    kind = 0 if len(frames) == 1 else 2 if len(set(sizes)) == 1 else 3
    head = vint(1) + struct.pack(">hB", ticks, 0x80 | kind << 1)
    if kind:
        head += bytes([len(frames) - 1])
    if kind == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def store(payload: bytes) -> bytes:
    """``payload`` as the samples of an 8-bit mono PCM track in a Matroska file."""
    head = element(EBML, b"".join((number(0x4286, 1), number(0x42F7, 1), number(0x42F2, 4), number(0x42F3, 8), element(0x4282, b"matroska"), number(0x4287, 4), number(0x4285, 2))))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / HERTZ)) + element(MUXER, b"ledgerlens") + element(WRITER, b"ledgerlens"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", HERTZ)) + number(CHANNELS, 1) + number(DEPTH, 8))
    track = element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + number(FRAME_NS, SAMPLES * 1_000_000_000 // HERTZ) + audio)
    body = [info, element(TRACKS, track)]
    at, cues = sum(map(len, body)), []
    step = SAMPLES * FRAMES
    for start in range(0, len(payload), step * BLOCKS):
        part, began = payload[start : start + step * BLOCKS], start * 1000 // HERTZ
        blocks = [number(CLUSTER_TIME, began)]
        for i in range(0, len(part), step):
            laced = part[i : i + step]
            blocks.append(element(SIMPLE_BLOCK, block([laced[k : k + SAMPLES] for k in range(0, len(laced), SAMPLES)], i * 1000 // HERTZ)))
        cues.append(element(CUE_POINT, number(CUE_TIME, began) + element(CUE_PLACE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


# ---------------------------------------------------------------- reading


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """Value, width and next position of a variable-length integer; value -1: unknown."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        n &= (1 << 7 * width) - 1
        if n == (1 << 7 * width) - 1:
            n = -1
    return n, width, at + width


def children(data: bytes, at: int, end: int, known: bool = True) -> Iterator[tuple[int, int, int, bool]]:
    """(id, body start, body end, size known) of the elements in [at, end).

    An element of unknown size reaches to the end given; whoever walks it stops at the first
    id that belongs to a level above.
    """
    while at < end:
        tag, _, after = read_vint(data, at, True)
        size, _, body = read_vint(data, after)
        stop = end if size < 0 else body + size
        if stop > end:
            raise ValueError(f"element at {at} exceeds its parent")
        moved = yield tag, body, stop, size >= 0
        at = stop if moved is None else moved


def unsigned(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def frames(data: bytes, start: int, end: int) -> tuple[int, int, int, str, list[tuple[int, int]]]:
    """Track, relative time, flags, lacing and the (offset, size) of each frame of a block."""
    track, _, at = read_vint(data, start)
    if at + 3 > end:
        raise ValueError(f"block cut off at {start}")
    ticks, flags = struct.unpack(">hB", data[at : at + 3])
    at, kind = at + 3, flags >> 1 & 3
    if not kind:
        return track, ticks, flags, LACING[0], [(at, end - at)]
    if at >= end:
        raise ValueError(f"lacing cut off at {start}")
    count, at, sizes = data[at] + 1, at + 1, []
    if kind == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
            sizes.append(n)
    elif kind == 3:
        n, _, at = read_vint(data, at)
        sizes.append(n)
        for _ in range(count - 2):
            d, width, at = read_vint(data, at)
            if d < 0:
                d = (1 << 7 * width) - 1
            sizes.append(sizes[-1] + d - ((1 << 7 * width - 1) - 1))
        sizes = sizes[: count - 1]
    else:
        if (end - at) % count:
            raise ValueError(f"unequal fixed lacing at {start}")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing exceeds its block at {start}")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return track, ticks, flags, LACING[kind], out


def parse(data: bytes) -> dict:
    """Tracks, packets, clusters and cues of a file; "error" tells what was wrong with it."""
    out = {"tracks": {}, "packets": [], "clusters": [], "cues": [], "scale": 1_000_000, "doctype": "", "error": None}
    try:
        _parse(data, out)
    except (ValueError, IndexError, struct.error) as e:
        out["error"] = str(e) or "damaged"
    return out


def _parse(data: bytes, out: dict) -> None:
    segments = 0
    for tag, start, end, _ in children(data, 0, len(data)):
        if tag == EBML:
            out["doctype"] = next((data[a:b].decode("latin-1") for t, a, b, _ in children(data, start, end) if t == 0x4282), "")
        elif tag == SEGMENT:
            segments += 1
            _segment(data, start, end, out)
    if out["doctype"] not in ("matroska", "webm") or not segments:
        raise ValueError("not a Matroska file, or one without a segment")


def _segment(data: bytes, start: int, end: int, out: dict) -> None:
    walk, head = children(data, start, end), start
    item = next(walk, None)
    while item:
        (tag, a, b, known), moved = item, None
        if tag == INFO:
            for t, x, y, _ in children(data, a, b):
                if t == TIMESTAMP_SCALE:
                    out["scale"] = unsigned(data, x, y)
        elif tag == TRACKS:
            for t, x, y, _ in children(data, a, b):
                if t == TRACK_ENTRY:
                    _track(data, x, y, out)
        elif tag == CUES:
            for t, x, y, _ in children(data, a, b):
                if t == CUE_POINT:
                    _cue(data, x, y, out)
        elif tag == CLUSTER:
            out["clusters"].append(head - start)
            moved = _cluster(data, a, b, known, out)
        head = b if moved is None else moved
        try:
            item = walk.send(moved) if moved is not None else next(walk, None)
        except StopIteration:
            return


def _track(data: bytes, start: int, end: int, out: dict) -> None:
    track = {"number": 0, "codec": "", "kind": 0, "frame_ns": 0, "rate": 0.0, "channels": 1, "depth": 0}
    for t, x, y, _ in children(data, start, end):
        if t == CODEC:
            track["codec"] = data[x:y].decode("latin-1")
        elif t in (TRACK_NUMBER, TRACK_TYPE, FRAME_NS):
            track[{TRACK_NUMBER: "number", TRACK_TYPE: "kind", FRAME_NS: "frame_ns"}[t]] = unsigned(data, x, y)
        elif t == AUDIO:
            for u, v, w, _ in children(data, x, y):
                if u == RATE:
                    track["rate"] = struct.unpack(">d" if w - v == 8 else ">f", data[v:w])[0]
                elif u in (CHANNELS, DEPTH):
                    track["channels" if u == CHANNELS else "depth"] = unsigned(data, v, w)
    out["tracks"][track["number"]] = track


def _cue(data: bytes, start: int, end: int, out: dict) -> None:
    time = 0
    for t, x, y, _ in children(data, start, end):
        if t == CUE_TIME:
            time = unsigned(data, x, y)
        elif t == CUE_PLACE:
            place = {u: unsigned(data, v, w) for u, v, w, _ in children(data, x, y)}
            out["cues"].append((time * out["scale"], place.get(CUE_TRACK, 0), place.get(CUE_CLUSTER, -1)))


def _cluster(data: bytes, start: int, end: int, known: bool, out: dict) -> int | None:
    """Packets of a cluster; where its size is unknown, the position at which it ends."""
    base, at = 0, start
    for tag, a, b, _ in children(data, start, end):
        if not known and tag in (CLUSTER, CUES, TRACKS, INFO, SEEKHEAD):
            return at
        at = b
        if tag == CLUSTER_TIME:
            base = unsigned(data, a, b)
        elif tag == SIMPLE_BLOCK:
            _packets(data, a, b, base, None, out)
        elif tag == BLOCK_GROUP:
            inner = list(children(data, a, b))
            for t, x, y, _ in inner:
                if t == BLOCK:
                    _packets(data, x, y, base, all(u != REFERENCE for u, *_ in inner), out)
    return None if known else at


def _packets(data: bytes, start: int, end: int, base: int, key: bool | None, out: dict) -> None:
    track, ticks, flags, lacing, found = frames(data, start, end)
    each = out["tracks"].get(track, {}).get("frame_ns", 0)
    for i, (at, size) in enumerate(found):
        out["packets"].append((track, (base + ticks) * out["scale"] + i * each, at, size, bool(flags & 0x80) if key is None else key, lacing))


# ---------------------------------------------------------------- in Spark

PACKETS = "key bigint, error string, track int, packet int, timestamp_ns bigint, offset bigint, size bigint, keyframe boolean, lacing string"


def packets(files: DataFrame, key: str, content: str) -> DataFrame:
    """The packet table of Matroska files in column ``content``: a row a packet with its byte
    range, and a row with null packet columns for a file that has an error or no packets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKETS.split(", ")]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = parse(data.as_py()) if data.is_valid else {"packets": [], "error": "null"}
                rows += [(k, None, p[0], i, p[1], p[2], p[3], p[4], p[5]) for i, p in enumerate(got["packets"])]
                if got["error"] or not got["packets"]:
                    rows.append((k, got["error"], *[None] * 7))
            cols = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    return arrow_rows(files.select(F.col(key).cast("bigint").alias("key"), F.col(content).alias("content")), read, PACKETS)


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % PAD or (0 if raw else PAD))


def digest(raw: bytes) -> tuple:
    """Write, read back, check the cues, and describe what was read."""
    media = store(padded(raw))
    got = parse(media)
    if got["error"] or sorted(c for _, _, c in got["cues"]) != got["clusters"]:
        raise ValueError(f"file does not read back: {got['error']}")
    payload = b"".join(media[at : at + size] for _, _, at, size, _, _ in got["packets"])
    samples = np.frombuffer(payload, np.uint8)
    kinds = [p[5] for p in got["packets"]]
    last = got["packets"][-1][1] // 1_000_000
    feature = f"tracks={len(got['tracks'])};codec={got['tracks'][1]['codec']};packets={len(kinds)};clusters={len(got['clusters'])};cues={len(got['cues'])};last_ms={last};" + "".join(f"{k}={kinds.count(k)};" for k in LACING) + f"sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max())};rises={int(np.count_nonzero(samples[1:] > samples[:-1]))}"
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_digests(docs: DataFrame) -> DataFrame:
    """One row per document: its text through a Matroska file and back.  A null text is an
    empty one; its payload is 64 zero bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in DIGEST.split(", ")]
        for batch in batches:
            rows = [digest(x.as_py()) for x in batch.column(1)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(list(c), t) for c, t in zip(cols, types[1:])]], names)

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    return arrow_rows(docs.select(F.col("doc_id").cast("bigint"), raw), run, DIGEST)
