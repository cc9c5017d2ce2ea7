"""Members of small zip files by their headers alone; whatever is not plain is left to the standard library."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

_LOCAL, _CENTRAL, _END = "<4s5H3L2H", "<4s6H3L5H2L", "<4s4H2LH"
_LOCAL_SIZE, _CENTRAL_SIZE, _END_SIZE = 30, 46, 22
#: Flags that change nothing here: levels of deflate, sizes after the data (the directory has them too), names in UTF-8.
_FLAGS = 0x80E
#: What ZipFile writes for a new member: version 2.0 of Unix, the first day of DOS, and its owner's rights.
_MADE, _NEEDED, _DAY, _RIGHTS = 3 << 8 | 20, 20, 1 << 5 | 1, 0o600 << 16


class Member:
    __slots__ = ("filename", "file_size", "external_attr", "method", "crc", "size", "at", "end")

    def is_dir(self) -> bool:
        return self.filename.endswith("/")


class PlainZip:
    """What ZipFile(BytesIO(data)) reads of members that are stored or deflated, unencrypted, in the order of their directory and under ASCII names."""

    def __init__(self, data: bytes, members: list[Member]):
        self.data, self.members, self.by_name = data, members, {m.filename: m for m in members}
        self.names = [m.filename for m in members]

    def infolist(self) -> list[Member]:
        return self.members

    def namelist(self) -> list[str]:
        return self.names

    def read(self, name: str | Member) -> bytes:
        member = self.by_name[name] if isinstance(name, str) else name
        content = self._plain(member)
        if content is None:  # by the library, or its error
            z = zipfile.ZipFile(io.BytesIO(self.data))
            return z.read(name if isinstance(name, str) else z.infolist()[self.members.index(member)])
        return content

    def _plain(self, m: Member) -> bytes | None:
        if m.end - m.at < _LOCAL_SIZE:
            return None
        mark, _, flags, _, _, _, _, _, _, name, extra = struct.unpack_from(_LOCAL, self.data, m.at)
        at = m.at + _LOCAL_SIZE
        if mark != b"PK\3\4" or flags & ~_FLAGS or self.data[at : at + name] != m.filename.encode() or at + name + extra + m.size > m.end:
            return None
        content = self.data[at + name + extra : at + name + extra + m.size]
        if m.method:
            unpacked = zlib.decompressobj(-15)
            try:
                content = unpacked.decompress(content, m.file_size + 1)
            except zlib.error:
                return None
            if not unpacked.eof:
                return None
        return content if len(content) == m.file_size and zlib.crc32(content) == m.crc else None


def plain_zip(data: bytes) -> PlainZip | None:
    """A PlainZip of a file whose directory is plain; None of any other."""
    top = len(data) - _END_SIZE
    if top < 0 or data[max(top - 20, 0) : top].startswith(b"PK\6\7"):
        return None
    mark, disk, first, here, total, size, at, comment = struct.unpack_from(_END, data, top)
    if mark != b"PK\5\6" or comment or disk or first or here != total or at + size != top:
        return None
    members: list[Member] = []
    start = at
    while at < top:
        if top - at < _CENTRAL_SIZE:
            return None
        m = Member()
        mark, _, needed, flags, m.method, _, _, m.crc, m.size, m.file_size, name, extra, comment, _, _, m.external_attr, m.at = struct.unpack_from(_CENTRAL, data, at)
        at += _CENTRAL_SIZE + name
        raw = data[at - name : at]
        if mark != b"PK\1\2" or needed & 255 > 45 or flags & ~_FLAGS or m.method not in (0, 8) or extra or comment or at > top or not raw.isascii() or b"\0" in raw or 0xFFFFFFFF in (m.size, m.file_size, m.at):
            return None
        if members:
            if m.at <= members[-1].at:
                return None
            members[-1].end = m.at
        m.filename, m.end = raw.decode(), start
        members.append(m)
    return PlainZip(data, members) if len(members) == total and (not members or members[-1].at < start) else None


def stored_zip(members: dict[str, bytes]) -> bytes | None:
    """The bytes that ZipFile writes for stored members; None where it needs more than plain headers."""
    if len(members) > 65_535:
        return None
    parts, directory, at = [], [], 0
    for name, body in members.items():
        raw = name.encode()
        if not raw.isascii() or b"\0" in raw or len(raw) > 65_535 or at + len(body) >= 1 << 30:
            return None
        stored = (0, 0, 0, _DAY, zlib.crc32(body), len(body), len(body), len(raw), 0)
        parts += [struct.pack(_LOCAL, b"PK\3\4", _NEEDED, *stored), raw, body]
        directory += [struct.pack(_CENTRAL, b"PK\1\2", _MADE, _NEEDED, *stored, 0, 0, 0, _RIGHTS, at), raw]
        at += _LOCAL_SIZE + len(raw) + len(body)
    whole = b"".join(directory)
    return b"".join([*parts, whole, struct.pack(_END, b"PK\5\6", 0, 0, len(members), len(members), len(whole), at, 0)])
