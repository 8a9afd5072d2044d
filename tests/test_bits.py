"""Single wrong bits are named by the checksum's syndrome, wherever they are; JSON is carved as by a walk over each byte."""

import json
import random
import zlib

import pytest

from auditarium.sources import records


def test_every_bit_of_a_record():
    raw = records.encode(7, 123456789, b'{"a":"some payload"}', b"\7" * 32)
    for bit in range(8 * len(raw)):
        data = bytearray(raw)
        data[bit >> 3] ^= 1 << (bit & 7)
        kind, got = records.one_bit_off(bytes(data), 0)
        part = "header" if bit < 24 * 8 else "footer" if bit >= 8 * (len(raw) - 4) else "payload"
        assert kind == part and got == records.record_at(raw, 0), bit
    for first in range(0, 8 * len(raw), 37):  # two wrong bits are no one's
        data = bytearray(raw)
        data[first >> 3] ^= 1 << (first & 7)
        second = (first + 8 * 13 + 3) % (8 * len(raw))
        data[second >> 3] ^= 1 << (second & 7)
        got = records.one_bit_off(bytes(data), 0)
        assert got is None or got[1].event_data != b"" and records.record_at(raw, 0) != got[1]


@pytest.mark.parametrize("size", [1, 900, 1024, 1025, 5000, 300_000])
def test_long_messages(size):
    rng = random.Random(size)
    data = bytearray(rng.randbytes(size))
    right = zlib.crc32(data)
    for _ in range(20):
        bit = rng.randrange(8 * size)
        data[bit >> 3] ^= 1 << (bit & 7)
        assert records.wrong_bit(zlib.crc32(data) ^ right, size) == (bit >> 3, bit & 7)
        data[bit >> 3] ^= 1 << (bit & 7)
    assert records.wrong_bit(rng.getrandbits(32) | 1, 1) is None or size == 1


def test_too_long_to_be_sure():
    raw = bytearray(records.encode(1, 1, b"z" * 700_000))
    raw[5000] ^= 4
    assert records.one_bit_off(bytes(raw), 0) is None and records.one_bit_off(bytes(raw), 0, doubt=0.01)[0] == "payload"


def walked(data, least=2):
    out, depth, begin, quoted, escaped = [], 0, 0, False, False
    for at, c in enumerate(data):
        if quoted:
            quoted, escaped = not (c == 0x22 and not escaped), c == 0x5C and not escaped
        elif c == 0x22 and depth:
            quoted = True
        elif c == 0x7B:
            begin = at if not depth else begin
            depth += 1
        elif c == 0x7D and depth:
            depth -= 1
            if not depth and at - begin + 1 >= least:
                out.append((begin, bytes(data[begin : at + 1])))
    return out


def test_carving_equals_a_walk():
    rng = random.Random(1)
    for _ in range(2000):
        data = bytes(rng.choice(b'{}{}""\\\\ab\n') for _ in range(rng.randint(0, 40)))
        assert records.json_objects(data) == walked(data), data
    event = json.dumps({"a": {"b": 'x"}{'}}).encode()
    assert records.json_objects(b"\xff}" + event * 3 + b"{") == [(2 + k * len(event), event) for k in range(3)]


def test_carving_isnt_misled_by_what_stands_before():
    event = b'{"a":{"b":"x}\xc3\xa9"}}'
    for junk in (b"", b"{", b"{{", b'{"', b"}{\xff", b'{"a":', b'{ "q{', b'\\{"\\'):
        assert records.carved(junk + event + b"|") == [(len(junk), event)], junk
        assert records.carved(junk + event + b"|" + event) == [(len(junk), event), (len(junk) + len(event) + 1, event)], junk
    assert records.carved(b'{a {"b":1}}') == [(0, b'{a {"b":1}}')]  # damaged JSON is kept as a whole
    deep = b'{"a":' * 5000
    assert records.carved(deep + b"{}") == [(len(deep), b"{}")]


@pytest.mark.parametrize("hashed", [b"{", b"}{", b'{"', b"{}", b"{x}", b'"{"{', b"GL"])
def test_braces_in_heads_hide_and_give_nothing(hashed):
    """What a hash holds is never JSON, and the JSON behind it is found."""
    raw = records.encode(15, 1, b'7|{"k": 21}', hashed.ljust(32, b"\x01"))
    data = bytearray(raw)
    data[records.HEAD.size - 4] ^= 3
    want = [(records.HEAD.size + 2, "json", b'{"k": 21}')]
    assert list(records.salvaged(bytes(data))) == want
    assert list(records.salvaged(raw[: records.HEAD.size + 3])) == []  # an end that is missing
    data[9] ^= 3  # nor does the header hold
    assert b'{"k": 21}' in b"".join(piece for _, _, piece in records.salvaged(bytes(data)))
