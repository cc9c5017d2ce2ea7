"""Ogg media columns: multiplex, verify, demultiplex and time logical streams.

A payload is stored as 8-bit samples at 8 kHz in packets of PACKET samples, dealt in
turn to STREAMS logical streams of one physical Ogg stream; a page's granule
position is the sample at which its last finished packet ends, -1 if none ends on it.
Reading checks every page's checksum and sequence number, rebuilds packets from
their lacing values (packets may go on over pages), gives each packet its start time
from the granule positions, and joins the streams in that order.

A null or empty text is stored as a payload of padding alone; very long ones take more
pages; rows that repeat are stored alike; an empty table gives an empty one; a column of
the result's name may not be there yet, other clashing names keep their values. Damaged
or foreign bytes give a null result with the reason in `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.common import byte_views, new_column

# Fixed values of the container and of this mapping.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER, HEADER_SIZE = "<4sBBqIIIB", 27
MAGIC = b"\x01pcm8\x00"
INFO, INFO_SIZE = "<6sBBIIQ", 24  # magic, stream, streams, rate, packet samples, all samples
RATE, PACKET, STREAMS = 8000, 960, 2
BLOCK, PAD = 192, b" "
PAGE_SEGMENTS = 64
SERIAL = 0x5C000000

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def page_checksum(data: bytes) -> int:
    """Ogg's CRC (polynomial 0x04C11DB7, most significant bit first, from 0), by the mirrored CRC that zlib has."""
    crc = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(HEADER, CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def _stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages of one logical stream as (time, page); the first packet has a page of its own."""
    pages: list[tuple[int, bytes]] = []
    lacing, body, granule, carried = bytearray(), [], -1, False
    when = 0

    def close(last: bool):
        nonlocal lacing, body, granule, carried, when
        flags = (CONTINUED if carried else 0) | (FIRST if not pages else 0) | (LAST if last else 0)
        pages.append((when if pages else -1, _page(flags, granule, serial, len(pages), bytes(lacing), b"".join(body))))
        carried = bool(lacing) and lacing[-1] == 255
        lacing, body, granule = bytearray(), [], -1

    for i, (packet, end) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while values:
            room = PAGE_SEGMENTS - len(lacing)
            now, values = values[:room], values[room:]
            size = sum(now)
            lacing += now
            body.append(packet[at : at + size])
            at += size
            when = end
            if not values:
                granule = end
            if values or len(lacing) == PAGE_SEGMENTS or i == 0:
                close(i == len(packets) - 1 and not values)
    if lacing:
        close(True)
    return pages


def mux(payload: bytes) -> bytes:
    """The payload as a physical Ogg stream."""
    streams: list[list[tuple[bytes, int]]] = [[(struct.pack(INFO, MAGIC, s, STREAMS, RATE, PACKET, len(payload)), 0)] for s in range(STREAMS)]
    for i, at in enumerate(range(0, len(payload), PACKET)):
        packet = payload[at : at + PACKET]
        streams[i % STREAMS].append((packet, at + len(packet)))
    pages = [(when, s, n, page) for s, packets in enumerate(streams) for n, (when, page) in enumerate(_stream_pages(SERIAL + s, packets))]
    pages.sort(key=lambda p: p[:3])
    return b"".join(p[3] for p in pages)


def read_pages(data: bytes):
    """(flags, granule, serial, number, lacing, body) of each page, checksums verified."""
    at = 0
    while at < len(data):
        if len(data) - at < HEADER_SIZE:
            raise OggError("cut page header")
        capture, version, flags, granule, serial, number, crc, segments = struct.unpack_from(HEADER, data, at)
        if capture != CAPTURE or version:
            raise OggError("no page where one should begin")
        lacing = data[at + HEADER_SIZE : at + HEADER_SIZE + segments]
        start = at + HEADER_SIZE + segments
        end = start + sum(lacing)
        if len(lacing) < segments or end > len(data):
            raise OggError("cut page")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError("page checksum")
        yield flags, granule, serial, number, lacing, data[start:end]
        at = end


def demux(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream with the granule position that their page gives them, -1 where a later one of the page has it."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    state: dict[int, tuple[int, bytes, bool]] = {}  # next page number, unfinished packet, ended
    for flags, granule, serial, number, lacing, body in read_pages(data):
        want, rest, ended = state.get(serial, (0, b"", False))
        if number != want or ended or bool(flags & FIRST) != (number == 0) or bool(flags & CONTINUED) != bool(rest):
            raise OggError("page out of order")
        packets, at, size = streams.setdefault(serial, []), 0, 0
        done = 0
        for value in lacing:
            size += value
            if value < 255:
                packets.append((rest + body[at : at + size], -1))
                at, size, rest, done = at + size, 0, b"", done + 1
        rest += body[at:]
        if done:
            packets[-1] = (packets[-1][0], granule)
        elif granule != -1:
            raise OggError("granule position without a packet")
        state[serial] = (number + 1, rest, bool(flags & LAST))
    if any(rest or not ended for _, rest, ended in state.values()):
        raise OggError("unfinished stream")
    return streams


def timed(packets: list[tuple[bytes, int]], gap: int) -> list[tuple[int, bytes]]:
    """(start sample, packet): counted back from each granule position, `gap` samples of other streams between two packets."""
    out, end = [], None
    for packet, granule in reversed(packets):
        end = granule if granule >= 0 else end
        if end is None:
            raise OggError("no granule position")
        start = end - len(packet)
        out.append((start, packet))
        end = start - gap
    return out[::-1]


def decode(data: bytes) -> tuple[bytes, dict]:
    """(payload, features) of a stored stream."""
    streams = demux(data)
    if not streams:
        raise OggError("no pages")
    parts: list[tuple[int, bytes]] = []
    whole = rate = 0
    for packets in streams.values():
        if not packets or len(packets[0][0]) != INFO_SIZE:
            raise OggError("no stream header")
        magic, _, count, rate, per, whole = struct.unpack(INFO, packets[0][0])
        if magic != MAGIC or count != len(streams) or not rate or not per:
            raise OggError("foreign stream header")
        parts += timed(packets[1:], per * (count - 1))
    parts.sort()
    at = 0
    for start, packet in parts:
        if start != at:
            raise OggError("gap between timestamps")
        at += len(packet)
    payload = b"".join(p for _, p in parts)
    if len(payload) != whole:
        raise OggError("samples missing")
    wave = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    n = max(1, len(wave))
    return payload, {
        "ms": whole * 1000 // rate,
        "streams": len(streams),
        "packets": len(parts),
        "mean": round(float(wave.sum(dtype=np.int64)) / n, 4),
        "rms": round(float(np.sqrt((wave.astype(np.int32) ** 2).sum(dtype=np.int64) / n)), 4),
        "crossings": int(np.count_nonzero(np.diff(wave >= 0))),
        "peak": int(np.abs(wave).max(initial=0)),
    }


def padded(text: bytes) -> bytes:
    return text + PAD * ((-len(text)) % BLOCK if text else BLOCK)


_FIELDS = [
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string()), ("media", pa.binary()),
]
_DDL = "struct<n_bytes: bigint, payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, media_bytes: bigint, media_sha256: string, feature: string, error: string, media: binary>"


def read_back(media: bytes) -> tuple:
    """(payload bytes, its SHA-256, CRC-32 of its last 16 bytes, feature, error) of stored bytes."""
    try:
        payload, found = decode(media)
    except OggError as e:
        return None, None, None, None, str(e)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), "|".join(f"{k}={v}" for k, v in found.items()), None


def stored(docs: DataFrame, text: str = "text", out: str = "ogg", keep_media: bool = True) -> DataFrame:
    """docs plus a struct: what was stored, and what was read back from the stored bytes; `media` holds these unless told not to."""
    new_column(docs, out)

    @F.arrow_udf(_DDL)
    def store(column: pa.Array) -> pa.Array:
        data, offsets = byte_views(column)
        rows = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            media = mux(padded(data[a:b].tobytes()))
            size, sha, tail, feature, error = read_back(media)
            rows.append((b - a, size, sha, tail, len(media), hashlib.sha256(media).hexdigest(), feature, error, media if keep_media else None))
        columns = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], [n for n, _ in _FIELDS])

    return docs.withColumn(out, store(F.col(text)))


def loaded(media: DataFrame, column: str = "media", out: str = "ogg") -> DataFrame:
    """Stored streams of any table: payload, feature and error."""
    new_column(media, out)

    @F.arrow_udf("struct<payload: binary, feature: string, error: string>")
    def load(values: pa.Array) -> pa.Array:
        rows = []
        for v in values.to_pylist():
            try:
                payload, found = decode(v or b"")
                rows.append({"payload": payload, "feature": "|".join(f"{k}={x}" for k, x in found.items()), "error": None})
            except OggError as e:
                rows.append({"payload": None, "feature": None, "error": str(e)})
        return pa.array(rows, pa.struct([("payload", pa.binary()), ("feature", pa.string()), ("error", pa.string())]))

    return media.withColumn(out, load(F.col(column)))
