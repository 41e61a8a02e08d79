"""Archives read as streams: gzip members one after the other, unpacked in pieces and sought anew after damage."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

#: Bytes that are unpacked at once; after damage, what can be saved of a member is sought in small steps.
PIECE, STEP = 1 << 18, 64
_MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")


def pieces(data: bytes) -> Iterator[bytes | None]:
    """The unpacked bytes of an archive, plain or gzip; None stands where damage parts them."""
    if not _MEMBER.match(data):
        yield from (data[at : at + PIECE] for at in range(0, len(data), PIECE))
        return
    at = 0
    while at < len(data):
        end = yield from _member(data, at)
        if end is None:  # damaged or cut off: go on where another member seems to begin
            found = _MEMBER.search(data, at + 1)
            at = found.start() if found else len(data)
            yield None
        elif _MEMBER.match(data, end):
            at = end
        else:
            found = _MEMBER.search(data, end)
            at = found.start() if found else len(data)
            if data[end:at].strip(b"\r\n\x00"):
                yield None


def _member(data: bytes, at: int) -> Iterator[bytes]:
    """The unpacked bytes of the member at ``at``; returns where it ends, None if it is not whole."""
    member, fed, given = zlib.decompressobj(31), at, 0
    try:
        while not member.eof and fed < len(data):
            some = data[fed : fed + PIECE]
            fed += len(some)
            while some and not member.eof:
                out = member.decompress(some, PIECE)
                given += len(out)
                yield out
                some = member.unconsumed_tail
        if not member.eof:
            yield member.flush()
            return None
        return fed - len(member.unused_data)
    except zlib.error:
        yield from _saved(data, at, given)
        return None


def _saved(data: bytes, at: int, given: int) -> Iterator[bytes]:
    """What a damaged member holds up to the damage, but for the first ``given`` bytes."""
    member = zlib.decompressobj(31)
    try:
        for fed in range(at, len(data), STEP):
            out = member.decompress(data[fed : fed + STEP])
            yield out[given:]
            given = max(0, given - len(out))
    except zlib.error:
        return


class Stream:
    """Reads lines and bytes of an archive up to damage, beyond which :meth:`resume` goes on."""

    def __init__(self, data: bytes) -> None:
        self._pieces, self._held, self._broken = pieces(data), bytearray(), False

    def _more(self) -> bool:
        if self._broken:
            return False
        piece = next(self._pieces, None)
        if piece is None:
            self._broken = True
            return False
        self._held += piece
        return True

    def line(self) -> bytes | None:
        """The next line with its end; None if the bytes end before one."""
        seen = 0
        while (end := self._held.find(b"\n", seen)) < 0:
            seen = len(self._held)
            if not self._more():
                return None
        return self.take(end + 1)

    def back(self, line: bytes) -> None:
        self._held[:0] = line

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes; fewer where they end."""
        while len(self._held) < n and self._more():
            pass
        out = bytes(self._held[:n])
        del self._held[:n]
        return out

    def rest(self) -> bytes:
        """All that is left before the damage or the end."""
        while self._more():
            pass
        return self.take(len(self._held))

    def resume(self) -> bool:
        """Goes on beyond damage; False at the end of the archive."""
        while self._pieces.gi_frame is not None:
            self._broken = False
            if self._more():
                return True
        return False
