"""Token ids of whole texts, through a vocabulary file of the ``tokenizers`` library.

Text is cut at blanks and line feeds, which no token of the vocabulary crosses, and each chunk's ids
are remembered in a cache of bounded size, because natural text repeats its words. Plain words of
Latin letters, which normalisation leaves alone but for case, go straight to the library's model; all
other chunks go through its whole encoder.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pactum.llm.shared import give_back

#: Chunks remembered in each of the two generations of a worker's cache.
CACHED = 150_000
END_ID = 1
MAX_TOKENS = 4096

PIECES = "piece int, start long, length long, ids_crc32 long"
_LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


def _byte_table() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Ids(dict):
    """Chunk to its ids as little-endian 32-bit numbers; a miss is encoded and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model
        self.bytes = _byte_table()
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.encoded(chunk)
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def forget(self) -> None:
        """Gives the memory back at the end of a task; the worker may live on for other work."""
        self.clear()
        self.older = {}

    def encoded(self, chunk: str) -> bytes:
        if found := _LATIN.fullmatch(chunk):
            ids = [t.id for part in found.groups() if part for t in self.model.tokenize(self.plain(part.lower()))]
        else:
            ids = self.encoder.encode(chunk, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def plain(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_KNOWN: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """This worker's encoder and cache for a vocabulary."""
    if path not in _KNOWN:
        _KNOWN[path] = Ids(path)
    return _KNOWN[path]


def cutter(vocabulary: str, max_tokens: int, end_id: int, with_ids: bool):
    """From batches of (doc_id, text) to batches of pieces, for a task."""
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ids_of(vocabulary)
        for batch in batches:
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = known.of(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    own = ids[at : at + 4 * max_tokens]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        kept.append(np.frombuffer(own, dtype="<i4"))
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        known.forget()
        give_back()

    return cut


def piece_schema(docs: DataFrame, with_ids: bool = False) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}" + (", ids array<int>" if with_ids else "")


def pieces(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document (and ids, if asked for): map-only.

    A document's ids are those of its whole text (null: none) and then end_id; only documents of over
    max_tokens ids are cut, into pieces of max_tokens and a last one that may be shorter.
    """
    return docs.select("doc_id", "text").mapInArrow(cutter(vocabulary, max_tokens, end_id, with_ids), piece_schema(docs, with_ids))
