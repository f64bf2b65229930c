"""Reading ZIP packages in place: central directory, ZIP64 records, stored members.

Only byte ranges are asked for, through ``read(offset, length)``; nothing is extracted. Numbers
below are fixed values of the ZIP file format.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
ZIP64_FIELD = 1
STORED = 0

Read = Callable[[int, int], bytes]


class BadPackage(ValueError):
    """The bytes are no readable ZIP package."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    crc: int
    header: int


def _directory(read: Read, size: int) -> tuple[int, int, int]:
    """Offset, length and number of entries of the central directory."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0:  # a comment may hold the signature too
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise BadPackage("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 in (count,) or FULL32 in (length, offset):
        place = tail_at + at - 20
        locator = read(place, 20) if place >= 0 else b""
        if locator[:4] != LOCATOR64:
            raise BadPackage("no ZIP64 locator")
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise BadPackage("no ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    return offset, length, count


def members(read: Read, size: int) -> list[Member]:
    """All entries of the central directory."""
    offset, length, count = _directory(read, size)
    data, at, out = read(offset, length), 0, []
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise BadPackage("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIIHHH", data, at + 16)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        place = 0
        while place + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, place)
            if kind == ZIP64_FIELD:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, place + 4))
                full = wide.pop(0) if full == FULL32 else full
                packed = wide.pop(0) if packed == FULL32 else packed
                header = wide.pop(0) if header == FULL32 else header
            place += 4 + n
        out.append(Member(name, method, packed, full, crc, header))
        at += 46 + n_name + n_extra + n_note
    return out


def data_offset(read: Read, member: Member) -> int:
    """Where a stored member's first byte lies in the package."""
    if member.method != STORED:
        raise BadPackage(f"{member.name} is not stored")
    head = read(member.header, 30)
    if head[:4] != LOCAL:
        raise BadPackage("broken local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra
