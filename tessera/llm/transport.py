"""Media columns: MPEG transport streams.

`to_stream` stores a payload as a transport stream of one program: program tables, then a private
elementary stream whose access units carry timestamps, every few of them a random-access point.
`read_stream` takes such a stream apart: it checks the program tables, finds the elementary
streams, checks continuity counters, reassembles the elementary packets and returns each payload with
the timestamps and random-access points of its units.  Both work on one row at a time within Arrow
batches; nothing is shuffled.

Read are all programs and all their elementary streams, of whatever type, named by intact current
sections of the tables (which may span packets, and of which packets may hold several); tables of
the same program add up.  Packets of PIDs that no table names are counted, not read.

Defined results: a null payload counts as an empty one; a stream with lost or repeated packets is
read as far as it goes and says so in `continuity_errors`, for which a packet may come twice and a
counter may jump where the packet announces it; packets without the sync byte, with the error flag or
scrambled, units without a start code, and bytes beyond the last whole packet are counted in
`bad_packets`; a stream without valid tables has no elementary streams.  Equal payloads give equal
streams; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, text_frame

PACKET, SYNC = 188, 0x47
TABLE_PID, MAP_PID, MEDIA_PID = 0x0000, 0x1000, 0x0101
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
UNIT = 4096  #: payload bytes in an access unit
TICKS = 3600  #: of the 90 kHz clock, from a unit to the next
EVERY = 8  #: units from a random-access point to the next


@lru_cache(maxsize=4096)
def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@lru_cache(maxsize=8)
def table_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    section = head + body
    section += struct.pack(">I", section_crc(section))
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


def stamp(pts: int) -> bytes:
    return bytes((0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE))


def mux(payload: bytes) -> bytes:
    out = [table_packet(TABLE_PID, 0, 1, struct.pack(">HH", 1, 0xE000 | MAP_PID)), table_packet(MAP_PID, 2, 1, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, PRIVATE_DATA, 0xE000 | MEDIA_PID, 0xF000))]
    counter = 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[at : at + UNIT], (k * TICKS) & (1 << 33) - 1
        data = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(unit) + 8, 0x80, 0x80, 5) + stamp(pts) + unit
        # The first packet of a random-access point has an adaptation field with the clock.
        field = bytes((7, 0x50)) + struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00) if k % EVERY == 0 else b""
        first = PACKET - 4 - len(field)
        rest = max(0, len(data) - first)
        n = 1 + -(-rest // (PACKET - 4))
        packets = np.full((n, PACKET), 0xFF, dtype=np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        packets[0, 1] |= 0x40
        whole = n - 2 if n > 1 else 0
        if whole > 0:
            packets[1 : 1 + whole, 4:] = np.frombuffer(data, np.uint8, whole * (PACKET - 4), first).reshape(whole, -1)
        ends = {0: (field, data[:first])}
        if n > 1:
            ends[n - 1] = (b"", data[first + whole * (PACKET - 4) :])
        for row, (extra, part) in ends.items():
            if short := PACKET - 4 - len(extra) - len(part):  # stuffing stands in the adaptation field
                if extra:
                    extra = bytes((extra[0] + short,)) + extra[1:] + b"\xff" * short
                else:
                    extra = bytes((short - 1,)) + (b"\x00" + b"\xff" * (short - 2) if short > 1 else b"")
            if extra:
                packets[row, 3] |= 0x20
            packets[row, 4:] = np.frombuffer(extra + part, np.uint8)
        out.append(packets.tobytes())
    return b"".join(out)


def payload_start(packets: np.ndarray) -> np.ndarray:
    """Where the payloads of packets begin."""
    return np.where(packets[:, 3] & 0x20 > 0, 5 + packets[:, 4].astype(np.int64), 4).clip(max=PACKET)


def in_sequence(packets: np.ndarray) -> tuple[np.ndarray, int]:
    """Of one PID's packets those with a payload, each once, and how many continuity errors there are."""
    packets = packets[packets[:, 3] & 0x10 > 0]
    if len(packets) < 2:
        return packets, 0
    step = (packets[1:, 3].astype(np.int16) - packets[:-1, 3]) & 15
    again = np.concatenate(([False], (step == 0) & (packets[1:] == packets[:-1]).all(axis=1)))
    announced = (packets[1:, 3] & 0x20 > 0) & (packets[1:, 4] > 0) & (packets[1:, 5] & 0x80 > 0)
    errors = (step != 1) & ~again[1:] & ~announced | again[1:] & again[:-1]  # one repetition is allowed
    return packets[~again], int(errors.sum())


def sections(packets: np.ndarray, table_id: int) -> Iterator[bytes]:
    """The bodies of the intact, current sections of a table."""
    held, last = b"", None
    for p, start in zip(packets, payload_start(packets), strict=True):
        data, counter = p[start:].tobytes(), int(p[3]) & 15
        if last is not None and counter != last + 1 & 15:
            held = b""  # something is missing in between
        last = counter
        if p[1] & 0x40:
            begin = 1 + data[0] if data else 0
            parts = [held + data[1:begin] if held else b"", data[begin:]]
        else:
            parts = [held + data] if held else []
        held = b""
        for held in parts:
            while len(held) >= 3 and held[0] != 0xFF:
                end = 3 + ((held[1] & 0x0F) << 8 | held[2])
                if len(held) < end:
                    break
                section, held = held[:end], held[end:]
                if section[0] == table_id and end >= 12 and section[5] & 1 and section_crc(section[:-4]) == int.from_bytes(section[-4:], "big"):
                    yield section[8:-4]
            if held[:1] == b"\xff":
                held = b""


#: Elementary packets whose header ends with their length, and the one of these that only pads.
PLAIN, PADDING = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)), 0xBE


def clock(p: bytes) -> int:
    return (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1


def elementary(packets: np.ndarray) -> tuple[bytes, list[dict], int]:
    """Payload, units and the number of bad units of one elementary stream."""
    random = (packets[:, 3] & 0x20 > 0) & (packets[:, 4] > 0) & (packets[:, 5] & 0x40 > 0)
    start = payload_start(packets)
    begins = np.flatnonzero(packets[:, 1] & 0x40)
    data = packets[np.arange(PACKET)[None, :] >= start[:, None]].tobytes()
    where = np.concatenate(([0], np.cumsum(PACKET - start)))
    parts, units, size, bad = [], [], 0, 0
    for k, b in enumerate(begins):
        unit = data[where[b] : where[begins[k + 1]] if k + 1 < len(begins) else len(data)]
        if len(unit) < 6 or unit[:3] != b"\0\0\1" or unit[3] not in PLAIN and len(unit) < 9:
            bad += 1
            continue
        if unit[3] == PADDING:
            continue
        pts = dts = None
        head = 6
        if unit[3] not in PLAIN:
            head = 9 + unit[8]
            pts = clock(unit[9:14]) if unit[7] & 0x80 and len(unit) >= 14 else None
            dts = clock(unit[14:19]) if unit[7] & 0xC0 == 0xC0 and len(unit) >= 19 else None
        length = int.from_bytes(unit[4:6], "big")
        part = unit[head : 6 + length] if length else unit[head:]
        units.append({"pts": pts, "dts": dts, "at": size, "random_access": bool(random[b])})
        parts.append(part)
        size += len(part)
    return b"".join(parts), units, bad


def demux(stream: bytes) -> dict:
    """packets, bad_packets, continuity_errors and streams, the elementary streams by program and in the order of their table."""
    packets = np.frombuffer(stream, np.uint8, len(stream) // PACKET * PACKET).reshape(-1, PACKET)
    good = (packets[:, 0] == SYNC) & (packets[:, 1] & 0x80 == 0) & (packets[:, 3] & 0xC0 == 0)
    out: dict = {"packets": int((packets[:, 0] == SYNC).sum()), "bad_packets": int((~good).sum()) + (len(stream) % PACKET > 0), "continuity_errors": 0, "streams": []}
    packets = packets if good.all() else packets[good]
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]

    def read(number: int) -> tuple[np.ndarray, int]:
        own, errors = in_sequence(packets[pid == number])
        out["continuity_errors"] += errors
        return own, errors

    maps, seen = {}, set()
    for body in sections(read(TABLE_PID)[0], 0):
        for at in range(0, len(body) - 3, 4):
            program, place = struct.unpack(">HH", body[at : at + 4])
            if program:
                maps.setdefault((program, place & 0x1FFF))
    of_map = {number: list(sections(read(number)[0], 2)) for number in dict.fromkeys(place for _, place in maps)}
    for program, place in maps:
        for body in of_map[place]:
            at = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
            while at + 5 <= len(body):
                kind, own, more = struct.unpack(">BHH", body[at : at + 5])
                at += 5 + (more & 0x0FFF)
                if (program, own) not in seen:
                    seen.add((program, own))
                    mine, errors = read(own & 0x1FFF)
                    payload, units, bad = elementary(mine)
                    out["bad_packets"] += bad
                    out["streams"].append({"program": program, "pid": own & 0x1FFF, "stream_type": kind, "payload": payload, "units": units, "continuity_errors": errors})
    return out


#: Of the keys that rows carry along: a document and, where known, the bytes of its text.
KEY, KEY_SQL = pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64())]), "struct<doc_id:long,n_bytes:long>"


def keyed(rows: DataFrame, id_col: str, data_col: str) -> DataFrame:
    size = F.col("n_bytes") if "n_bytes" in rows.columns else F.lit(None)
    return rows.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), size.cast("long").alias("n_bytes")).alias("key"), F.coalesce(F.col(data_col), F.lit(b"")).alias("data"))


def to_stream(payloads: DataFrame, id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    """doc_id, n_bytes (if payloads has it) and media, the payload as a transport stream."""
    made = map_texts(keyed(payloads, id_col, payload_col), lambda keys, data: {"key": keys, "media": [mux(d) for d in data]}, f"key {KEY_SQL}, media binary", pa.schema([("key", KEY), ("media", pa.binary())]))
    return made.select("key.doc_id", "key.n_bytes", "media")


UNITS = [("pts", pa.int64()), ("dts", pa.int64()), ("at", pa.int64()), ("random_access", pa.bool_())]
STREAM = [("program", pa.int64()), ("pid", pa.int64()), ("stream_type", pa.int64()), ("continuity_errors", pa.int64()), ("units", pa.list_(pa.struct(UNITS)))]
STREAM_SQL = "program:long,pid:long,stream_type:long,continuity_errors:long,units:array<struct<pts:long,dts:long,at:long,random_access:boolean>>"
DIGEST = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]


def digest(stream: dict) -> dict:
    payload = stream.pop("payload")
    return stream | {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:])}


def read_stream(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", digest_only: bool = False) -> DataFrame:
    """Of each row `streams`, its elementary streams: program, pid, type, payload and access units (timestamps, byte offset, random access), and what is wrong with them.

    With digest_only, digests stand for payloads and stream.
    """
    fields = STREAM + (DIGEST if digest_only else [("payload", pa.binary())])
    inner = STREAM_SQL + (",payload_bytes:long,payload_sha256:string,tail_crc32:long" if digest_only else ",payload:binary")
    counts = ["packets", "bad_packets", "continuity_errors"]

    def each(keys: list, streams: list[bytes]) -> dict:
        out: dict = {n: [] for n in ("streams", *counts, "media_bytes", "media_sha256")}
        for stream in streams:
            x = demux(stream)
            out["streams"].append([digest(s) for s in x["streams"]] if digest_only else x["streams"])
            out["media_bytes"].append(len(stream))
            out["media_sha256"].append(hashlib.sha256(stream).hexdigest())
            for n in counts:
                out[n].append(x[n])
        return {"key": keys, **out}

    schema = pa.schema([("key", KEY), ("streams", pa.list_(pa.struct(fields))), *((n, pa.int64()) for n in counts), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])
    read = map_texts(keyed(media, id_col, media_col), each, f"key {KEY_SQL}, streams array<struct<{inner}>>, packets long, bad_packets long, continuity_errors long, media_bytes long, media_sha256 string", schema)
    return read.select("key.*", *schema.names[1:])


def padded(docs: DataFrame, multiple: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and payload: the text as UTF-8 with zero bytes up to a positive multiple."""
    raw = F.encode("text", "utf-8")
    short = F.greatest(F.ceil(F.octet_length("text") / multiple), F.lit(1)) * multiple
    return text_frame(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.rpad(raw, short.cast("int"), F.lit(b"\0")).alias("payload"))


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_stream(to_stream(padded(table(spark, sf_dir, "documents"))), digest_only=True).withColumn("_s", F.element_at("streams", 1))
    random = F.filter("_s.units", lambda u: u["random_access"])
    points = F.array_join(F.transform(random, lambda u: F.concat_ws("@", u["pts"], u["at"])), " ")
    feature = F.concat_ws(";", F.concat(F.lit("packets="), "packets"), F.concat(F.lit("units="), F.size("_s.units")), F.concat(F.lit("last_pts="), F.element_at("_s.units", -1)["pts"]), F.concat(F.lit("continuity_errors="), "continuity_errors"), F.concat(F.lit("random_access="), F.size(random)))
    return read.select("doc_id", "n_bytes", "_s.payload_bytes", "_s.payload_sha256", "_s.tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), points.alias("random_access_points"), "continuity_errors")
