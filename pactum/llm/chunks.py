"""Token ids of texts by chunks that are remembered: natural text repeats its words."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

#: Chunks remembered in each of two generations, and the longest chunk that is remembered.
CACHED = 200_000
LONGEST = 64


class Remembered(dict):
    """Chunk to its ids as little-endian 32-bit numbers; a miss is encoded, and remembered if it is short."""

    def __init__(self, encoded: Callable[[str], Iterable[int]], cached: int = CACHED):
        super().__init__()
        self.encoded, self.cached = encoded, cached
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = array("I", self.encoded(chunk)).tobytes()
        if len(chunk) <= LONGEST:
            if len(self) >= self.cached:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def of(self, chunks: Iterable[str]) -> bytes:
        return b"".join(map(self.__getitem__, chunks))

    def forget(self) -> None:
        """Gives the memory back at the end of a task; the worker may live on for other work."""
        self.clear()
        self.older = {}


#: Latin letters.
LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"

def byte_level_bytes() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\u00a1"), ord("\u00ac") + 1), *range(ord("\u00ae"), ord("\u00ff") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
