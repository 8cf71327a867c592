"""Writes small metadata files for tests."""

import struct

LONG = {"OB", "OW", "SQ", "UT", "UN"}


def element(tag, vr, value, implicit=False):
    value = value.encode() if isinstance(value, str) else value
    if len(value) % 2:
        value += b" " if vr not in ("UI", "OB") else b"\0"
    head = struct.pack("<HH", int(tag[:4], 16), int(tag[4:], 16))
    if implicit:
        return head + struct.pack("<I", len(value)) + value
    if vr in LONG:
        return head + vr.encode() + b"\0\0" + struct.pack("<I", len(value)) + value
    return head + vr.encode() + struct.pack("<H", len(value)) + value


def sequence(tag, items, undefined=False, implicit=False):
    head = struct.pack("<HH", int(tag[:4], 16), int(tag[4:], 16))
    if undefined:
        body = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + i + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) for i in items) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
        size = 0xFFFFFFFF
    else:
        body = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(i)) + i for i in items)
        size = len(body)
    return head + (b"" if implicit else b"SQ\0\0") + struct.pack("<I", size) + body


def part10(body, syntax="1.2.840.10008.1.2.1", sop_class="1.2.3"):
    meta = element("00020002", "UI", sop_class) + element("00020003", "UI", "1.9") + element("00020010", "UI", syntax)
    return b"\0" * 128 + b"DICM" + meta + body
