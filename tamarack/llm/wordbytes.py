"""Words of UTF-8 bytes, taken a few MB at a time so that one long text needs no list of all its words."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of one text that are split at once.
PIECE = 1 << 22


def spaced(separators: bytes, fold: bool = False) -> bytes:
    """A table for bytes.translate: the separators become spaces, A-Z lower-case if fold."""
    table = bytearray(range(256))
    if fold:
        table[0x41:0x5B] = range(0x61, 0x7B)
    for b in separators:
        table[b] = 0x20
    return bytes(table)


def pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words between spaces, in order, as lists of about `size` bytes of text each."""
    a = 0
    while a < len(data):
        b = data.find(b" ", a + size) if len(data) - a > size else -1
        b = len(data) if b < 0 else b
        yield data[a:b].split()
        a = b
