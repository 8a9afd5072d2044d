"""The binary record of audit logs: encoding, and splitting bytes into records. Small helpers of the data source.

Little-endian: magic, version (16 bits), flags (16), payload length (32), time (ns, 64), CRC32 of those 20 bytes,
sequence (64), previous record's SHA-256 (32 bytes), payload, CRC32 of all before, footer.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

# Fixed values of the format.
MAGIC, FOOTER, VERSION = 0x4D544C47, 0x454E4452, 1
MARK = struct.pack("<I", MAGIC)
FOOT = struct.pack("<I", FOOTER)
HEAD = struct.Struct("<IHHIqI Q32s".replace(" ", ""))
OVERHEAD = HEAD.size + 8
JOURNAL_MAGIC, JOURNAL_HEAD = 0x4A524E4C, struct.Struct("<IBqII")
MAX_PAYLOAD = 10 << 20
ZERO = bytes(32)
MODES = ("RESYNC", "SKIP", "STOP_AT_ERROR")


class Record(NamedTuple):
    offset: int
    size: int
    version: int
    flags: int
    ts_nanos: int
    sequence: int
    prev_hash: bytes
    event_data: bytes
    hash: str


class Damage(NamedTuple):
    offset: int
    size: int
    error: str


def encode(sequence: int, ts_nanos: int, data: bytes, prev_hash: bytes = ZERO, flags: int = 0, version: int = VERSION) -> bytes:
    head = struct.pack("<IHHIq", MAGIC, version, flags, len(data), ts_nanos)
    body = head + struct.pack("<IQ", zlib.crc32(head), sequence) + prev_hash + data
    return body + struct.pack("<II", zlib.crc32(body), FOOTER)


def record_at(data, at: int, most: int = MAX_PAYLOAD) -> Record | str:
    """The record that begins at a place, or why there is none."""
    if at + OVERHEAD > len(data):
        return "short"
    magic, version, flags, n, ts, head_sum, sequence, prev = HEAD.unpack_from(data, at)
    if magic != MAGIC:
        return "magic"
    if n > most:
        return "length"
    if zlib.crc32(data[at : at + 20]) != head_sum:
        return "header checksum"
    end = at + OVERHEAD + n
    if end > len(data):
        return "short"
    total, footer = struct.unpack_from("<II", data, end - 8)
    if zlib.crc32(data[at : end - 8]) != total:
        return "checksum"
    if footer != FOOTER:
        return "footer"
    if version != VERSION:
        return "version"
    raw = bytes(data[at:end])
    return Record(at, end - at, version, flags, ts, sequence, prev, raw[HEAD.size : -8], hashlib.sha256(raw).hexdigest())


def split(data: bytes, mode: str = "RESYNC", most: int = MAX_PAYLOAD, start: int = 0, stop: int | None = None) -> Iterator[Record | Damage]:
    """Records that begin from start up to stop, and what is between them.

    RESYNC looks for the next valid record after damage; SKIP only goes on behind records whose length is known to be right (their header holds), and else ends;
    STOP_AT_ERROR ends at the first damage. Bytes behind the last record are damage, too."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode}")
    stop = len(data) if stop is None else stop
    at = start
    while at < min(stop, len(data)):
        got = record_at(data, at, most)
        if isinstance(got, Record):
            yield got
            at += got.size
            continue
        if mode == "STOP_AT_ERROR":
            yield Damage(at, len(data) - at, got)
            return
        next_at = -1
        if mode == "SKIP" and got in ("checksum", "footer", "version"):
            next_at = at + OVERHEAD + HEAD.unpack_from(data, at)[3]
        elif mode == "RESYNC":
            next_at = data.find(MARK, at + 1)
            while 0 <= next_at and not isinstance(record_at(data, next_at, most), Record):
                next_at = data.find(MARK, next_at + 1)
        if next_at < 0:
            yield Damage(at, len(data) - at, got)
            return
        if start == 0 or at > start or next_at < stop:
            yield Damage(at, next_at - at, got)
        at = next_at


def ended(read_at, size: int, mode: str, most: int = MAX_PAYLOAD, step: int = 32 << 20) -> Iterator[Record | Damage]:
    """split in a mode that may end a file before its end (SKIP, STOP_AT_ERROR), by blocks of step bytes; read_at: of a length and a place, the bytes."""
    at = 0
    while at < size:
        data = read_at(min(size - at, step + most + OVERHEAD), at)
        done = 0
        for got in split(data, mode, most, 0, min(step, len(data))):
            done = got.offset + got.size
            if isinstance(got, Damage) and done == len(data):  # what ends a block ends the file
                yield Damage(at + got.offset, size - at - got.offset, got.error)
                return
            yield got._replace(offset=at + got.offset)
        at += done


def walked(read_at, size: int, most: int = MAX_PAYLOAD, block: int = 256 << 10) -> Iterator[Record | Damage]:
    """Records by their headers (and, as hash, the checksum at their end), from one to the next by its length. Short records come with the blocks that are read; what a long record holds beyond its block is never
    read. After a header that fails, the next one that holds."""
    at, held, data, begin = 0, 0, b"", -1  # data is what stands from held on; begin: of damage
    while at < size:
        if at + HEAD.size > size:
            break
        if not held <= at <= held + len(data) - HEAD.size:
            held, data = at, read_at(min(block, size - at), at)
        magic, version, flags, n, ts, head_sum, sequence, prev = HEAD.unpack_from(data, at - held)
        if magic == MAGIC and n <= most and zlib.crc32(data[at - held : at - held + 20]) == head_sum:
            if begin >= 0:
                yield Damage(begin, at - begin, "header checksum")
                begin = -1
            if at + OVERHEAD + n > size:
                yield Damage(at, size - at, "short")
                return
            foot = at + HEAD.size + n
            tail = data[foot - held : foot - held + 4] if foot + 4 <= held + len(data) else read_at(4, foot)
            yield Record(at, OVERHEAD + n, version, flags, ts, sequence, prev, b"", f"{int.from_bytes(tail, 'little'):08x}")
            at += OVERHEAD + n
            continue
        begin = at if begin < 0 else begin
        found = data.find(MARK, at + 1 - held)
        at = held + found if found >= 0 else max(at + 1, held + len(data) - 3)
    if begin >= 0 or at < size:
        begin = at if begin < 0 else begin
        yield Damage(begin, size - begin, "header checksum" if size - begin >= HEAD.size else "short")


def journal_entry(position: int, data: bytes, status: int = 0) -> bytes:
    return JOURNAL_HEAD.pack(JOURNAL_MAGIC, status, position, len(data), zlib.crc32(data)) + data


def journal(data: bytes) -> Iterator[tuple[int, int, int, bytes, str | None]]:
    """Entries of a journal: offset, status, position, data, error (a wrong checksum; a short tail ends it)."""
    at = 0
    while at + JOURNAL_HEAD.size <= len(data):
        magic, status, position, n, total = JOURNAL_HEAD.unpack_from(data, at)
        if magic != JOURNAL_MAGIC or at + JOURNAL_HEAD.size + n > len(data):
            return
        body = data[at + JOURNAL_HEAD.size : at + JOURNAL_HEAD.size + n]
        yield at, status, position, body, None if zlib.crc32(body) == total else "checksum"
        at += JOURNAL_HEAD.size + n


# CRC-32 is linear: what one wrong bit changes in it depends on the bit's distance from the end alone. So the difference of a stored and a computed checksum, the syndrome, names the bit.
_POLYNOMIAL = 0xEDB88320  # fixed value of the checksum
_STEP = 1024  #: bytes that are looked up at once


def _table() -> list[int]:
    """What a byte adds to the checksum's state, by its value."""
    out = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (_POLYNOMIAL if k & 1 else 0)
        out.append(k)
    return out


_BYTES = _table()
_TOPS = {x >> 24: k for k, x in enumerate(_BYTES)}


def _earlier(s: int) -> int:
    """The state a zero byte before."""
    k = _TOPS[s >> 24]
    return (s ^ _BYTES[k]) << 8 & 0xFFFFFFFF | k


def _syndromes() -> dict[int, int]:
    """Distance from the end, in bits, by syndrome, for the last _STEP bytes."""
    out, states = {}, [_BYTES[1 << j] for j in range(8)]
    for k in range(_STEP):
        for j in range(8):
            out[states[j]] = 8 * k + j
            states[j] = states[j] >> 8 ^ _BYTES[states[j] & 255]
    return out


def _jump() -> list[list[int]]:
    """For each byte of a state what it becomes _STEP zero bytes before."""
    single = []
    for j in range(32):
        s = 1 << j
        for _ in range(_STEP):
            s = _earlier(s)
        single.append(s)
    tables = []
    for k in range(4):
        row = [0] * 256
        for v in range(1, 256):
            low = v & -v
            row[v] = row[v ^ low] ^ single[8 * k + low.bit_length() - 1]
        tables.append(row)
    return tables


_found: tuple | None = None


def wrong_bit(syndrome: int, size: int) -> tuple[int, int] | None:
    """Place and bit of the one wrong bit in size bytes whose CRC-32 differs from the right one by syndrome; None if no single bit does that."""
    global _found
    _found = _found or (_syndromes(), _jump())
    near, (a, b, c, d) = _found
    for done in range(0, size, _STEP):
        if (at := near.get(syndrome)) is not None:
            place = size - 1 - done - (at >> 3)
            return (place, at & 7) if place >= 0 else None
        syndrome = a[syndrome & 255] ^ b[syndrome >> 8 & 255] ^ c[syndrome >> 16 & 255] ^ d[syndrome >> 24]
    return None


def one_bit_off(data, at: int, most: int = MAX_PAYLOAD, doubt: float = 1e-3) -> tuple[str, Record] | None:
    """The record at a place of which one bit is wrong, and where that is: header (or its checksum), payload (or sequence, previous hash, checksum) or footer. Payloads so
    long that a random checksum would name one of their bits with a probability over doubt are left alone."""
    head = bytearray(data[at : at + 20])
    if at + OVERHEAD > len(data):
        return None
    kind, part = "", None
    syndrome = zlib.crc32(head) ^ int.from_bytes(data[at + 20 : at + 24], "little")
    if syndrome:
        stored = syndrome.bit_count() == 1  # the checksum's own bit
        bit = None if stored else wrong_bit(syndrome, 20)
        if not stored and bit is None:
            return None
        if bit:
            head[bit[0]] ^= 1 << bit[1]
        kind = "header"
    n = int.from_bytes(head[8:12], "little")
    if head[:4] != MARK or n > most or at + OVERHEAD + n > len(data):
        return None
    part = bytearray(data[at : at + OVERHEAD + n])
    part[:20] = head
    part[20:24] = zlib.crc32(head).to_bytes(4, "little")
    if not kind:
        syndrome = zlib.crc32(memoryview(part)[:-8]) ^ int.from_bytes(part[-8:-4], "little")
        if syndrome:
            if 8 * len(part) / 2**32 > doubt:
                return None
            bit = None if syndrome.bit_count() == 1 else wrong_bit(syndrome, len(part) - 8)
            if bit:
                part[bit[0]] ^= 1 << bit[1]
            else:
                part[-8:-4] = zlib.crc32(memoryview(part)[:-8]).to_bytes(4, "little") if syndrome.bit_count() == 1 else part[-8:-4]
            kind = "payload"
        elif (int.from_bytes(part[-4:], "little") ^ FOOTER).bit_count() == 1:
            part[-4:] = FOOT
            kind = "footer"
    got = record_at(bytes(part), 0, most)
    return (kind, got._replace(offset=at)) if isinstance(got, Record) and kind else None


def flipped_header(data: bytes, at: int, most: int = MAX_PAYLOAD) -> Record | None:
    """The record at a place whose header has one wrong bit, if setting it right makes the whole record valid."""
    got = one_bit_off(data, at, most)
    return got[1] if got and got[0] == "header" else None


def salvaged(data: bytes, most: int = MAX_PAYLOAD) -> Iterator[tuple[int, str, bytes]]:
    """Offset, kind and data of all that a damaged run holds: records with one wrong bit, wherever they begin (header, payload, footer: see one_bit_off), and JSON between them (see carved)."""
    done = 0
    for at in _begins(data):
        if at >= done and (got := one_bit_off(data, at, most)):
            yield from ((done + k, "json", piece) for k, piece in carved(data[done:at], most))
            yield at, got[0], got[1].event_data
            done = at + got[1].size
    yield from ((done + k, "json", piece) for k, piece in carved(data[done:], most))


def carved(data: bytes, most: int = MAX_PAYLOAD) -> list[tuple[int, bytes]]:
    """JSON in damaged bytes. Heads and ends of records whose header holds are numbers and hashes, so braces there don't count. Of the rest, runs of balanced braces, and what parses as an object from any
    brace on and isn't in one of them, so that a brace or quote of other damaged bytes hides none that stands behind it."""
    out, done = [], 0
    for begin, end in [*_frames(data, most), (len(data), len(data))]:
        if begin > done:
            out += ((done + k, piece) for k, piece in _carved(data[done:begin]))
        done = max(done, end)
    return out


def _frames(data: bytes, most: int) -> list[tuple[int, int]]:
    """Where the heads of records whose header holds stand, and their ends, if they are where the header says."""
    out = []
    for at in _begins(data):
        if data[at : at + 4] == MARK and at + 24 <= len(data) and zlib.crc32(data[at : at + 20]) == int.from_bytes(data[at + 20 : at + 24], "little"):
            foot = at + HEAD.size + int.from_bytes(data[at + 8 : at + 12], "little")
            out.append((at, at + HEAD.size))
            if foot - at <= HEAD.size + most and data[foot + 4 : foot + 8] == FOOT:
                out.append((foot, foot + 8))
    return sorted(out)


def _carved(data: bytes) -> list[tuple[int, bytes]]:
    objects, runs = _objects(data), [(k, k + len(piece)) for k, piece in json_objects(data)]
    cut = lambda at: (k := bisect_left(objects, (at,)) - 1) >= 0 and objects[k][1] > at
    runs = [r for r in runs if not cut(r[0]) and not cut(r[1])]  # what begins or ends within an object was misled
    held = lambda at: (k := bisect_left(runs, (at + 1,)) - 1) >= 0 and runs[k][1] > at
    return [(b, bytes(data[b:e])) for b, e in sorted(runs + [x for x in objects if not held(x[0])])]


def _objects(data: bytes) -> list[tuple[int, int]]:
    """Begin and end of what parses as a JSON object, from the left, whatever stands before it."""
    out, text = [], data.decode("latin-1")  # a character a byte
    at = text.find("{")
    while at >= 0:
        try:
            end = _OBJECT.raw_decode(text, at)[1]
            out.append((at, end))
        except (ValueError, RecursionError):
            end = at + 1
        at = text.find("{", end)
    return out


def partial(data: bytes, most: int = MAX_PAYLOAD) -> tuple[int, bytes] | None:
    """Place and payload, as far as it goes, of a record whose header holds and whose end is missing; None if there is none."""
    at = data.find(MARK)
    while 0 <= at <= len(data) - HEAD.size:
        _, _, _, n, _, head_sum, _, _ = HEAD.unpack_from(data, at)
        if n <= most and zlib.crc32(data[at : at + 20]) == head_sum and at + OVERHEAD + n > len(data):
            return at, data[at + HEAD.size : min(len(data), at + HEAD.size + n)]
        at = data.find(MARK, at + 1)
    return None


def _begins(data: bytes) -> list[int]:
    """Places where all but at most one bit of a record's mark stand, so one of its halves does."""
    found = set()
    for k in (0, 2):
        at = data.find(MARK[k : k + 2])
        while at >= 0:
            found.add(at - k)
            at = data.find(MARK[k : k + 2], at + 1)
    return sorted(at for at in found if at >= 0 and (int.from_bytes(data[at : at + 4], "little") ^ MAGIC).bit_count() <= 1)


_OBJECT = json.JSONDecoder()
_OUTSIDE, _INSIDE = re.compile(rb'[{}"]'), re.compile(rb'"|\\.', re.S)


def json_objects(data: bytes, least: int = 2) -> list[tuple[int, bytes]]:
    """Runs of bytes with balanced braces outside strings: what may be events in damaged bytes. Goes from brace to brace and quote to quote."""
    out, depth, begin, at = [], 0, 0, 0
    while m := _OUTSIDE.search(data, at):
        at = m.end()
        c = m[0]
        if c == b"{":
            begin = m.start() if not depth else begin
            depth += 1
        elif c == b"}" and depth:
            depth -= 1
            if not depth and at - begin >= least:
                out.append((begin, bytes(data[begin:at])))
        elif c == b'"' and depth:
            while (m := _INSIDE.search(data, at)) and m[0] != b'"':
                at = m.end()
            if not m:
                break
            at = m.end()
    return out
