"""SentencePiece encoding of merge type, exact, by backtracking, and decoding.

A text is encoded by merging characters: of all neighbours whose joint text is a piece, those of the best score
merge first, the leftmost of equals. Here no merges are run over the text:

1. An Aho-Corasick automaton finds the longest piece that starts at each place, in one pass.
2. A path of pieces is grown from the left, the longest piece first, then its prefixes that are pieces. A piece may
   follow another only if merging both texts again, alone, gives just these two. Merges inside two neighbours run
   as they do in the whole text until one reaches over their border, so a path is the text's encoding exactly if all
   its neighbours pass.
3. So only one path leads to a place: a place from which nothing goes on is failed for good. A bit field of failed
   places makes the search linear.

Characters that are no piece become their UTF-8 bytes' pieces and part the text. As no piece holds a line feed, or
a space after another character (both are read off the vocabulary), texts are cut there and chunks are remembered.

The model must be of merge type with byte fallback, an identity normaliser and a leading space; each character of
a piece must be a piece, and no piece may be user-defined or unused. Others raise ValueError.

Defined cases: a null or empty text has the begin and end ids only and decodes to an empty text; a null doc_id is
kept; equal rows give equal rows; an empty table gives none. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.chunks import LATIN, Remembered
from pactum.llm.shared import slices

#: How the model writes a space.
MARK = "\u2581"
#: Pairs of pieces whose compatibility a worker remembers.
PAIRS = 1_000_000
#: Documents a task works on at a time.
SLICE = 500
NONE = -1
_PROBE = " a\u2581b  c\n\tﬁ\u00a0\u0000\u3042"


class Pieces:
    """A model's pieces, scores, automaton and prefixes, and the encoding of one chunk."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.vocab_size()
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [k for k in range(size) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
        self.text = {k: sp.id_to_piece(k) for k in plain}
        self.id = {text: k for k, text in self.text.items()}
        self.score = {text: sp.get_score(k) for text, k in self.id.items()}
        letters = {c for text in self.id for c in text}
        if not all(map(sp.is_byte, self.bytes)) or any(map(sp.is_unused, plain)) or not letters <= self.id.keys():
            raise ValueError(f"{model} is not of merge type with byte fallback and plain pieces")
        automaton = ahocorasick.Automaton()
        for text, k in self.id.items():
            automaton.add_word(text, k)
        automaton.make_automaton()
        self.matches = automaton.iter
        self.length = [len(self.text.get(k, "")) for k in range(size)]
        self.shorter = [self._prefix(self.text.get(k, "")) for k in range(size)]
        self.fits: dict[int, bool] = {}
        self.cut = self._cut()
        if [k for c in self.chunks(_PROBE) for k in self.encode(c)] != sp.encode(_PROBE):
            raise ValueError(f"{model} normalises texts or sets no space before them")

    def _prefix(self, text: str) -> int:
        """The longest proper prefix that is a piece."""
        return next((self.id[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.id), NONE)

    def _cut(self) -> re.Pattern:
        """Cuts texts where no piece reaches over: before spaces, around line feeds, between a Latin letter and a stop or comma."""
        if any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", text, re.S) for text in self.id):
            return re.compile(".+", re.S)
        if any(re.search(f"{LATIN}[.,]", text) for text in self.id):
            return re.compile(" *[^ \n]+| +|\n")
        return re.compile(f" *{LATIN}+(?=[.,])| *[^ \n]+| +|\n")

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: for the short texts of one or two pieces."""
        parts = list(text)
        while True:
            best = max(
                ((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None
            )
            if best is None:
                return parts
            parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]

    def compatible(self, before: int, after: int) -> bool:
        """Whether merging both pieces' texts again gives just these two; before NONE, whether after's gives it."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        texts = [self.text[k] for k in (before, after) if k != NONE]
        fit = self.fits[before << 32 | after] = self.merged("".join(texts)) == texts
        return fit

    def _run(self, text: str, longest: list[int]) -> list[int]:
        """Ids of a text whose characters all are pieces."""
        size = len(text)
        failed = bytearray(size // 8 + 1)
        fits, lengths, shorter = self.fits, self.length, self.shorter
        path: list[int] = []
        at, piece, last = 0, longest[0], NONE
        while True:
            to = at + lengths[piece]
            if not failed[to >> 3] >> (to & 7) & 1:
                fit = fits.get(last << 32 | piece)
                if fit is None:
                    fit = self.compatible(last, piece)
                if fit:
                    path.append(piece)
                    if to == size:
                        return path
                    at, last, piece = to, piece, longest[to]
                    continue
            piece = shorter[piece]
            while piece == NONE:  # nothing goes on from here
                failed[at >> 3] |= 1 << (at & 7)
                gone = path.pop()
                at -= lengths[gone]
                piece = shorter[gone]
                last = path[-1] if path else NONE

    def encode(self, chunk: str) -> list[int]:
        text = chunk.replace(" ", MARK)
        longest = [NONE] * len(text)
        for end, piece in self.matches(text):
            longest[end + 1 - self.length[piece]] = piece  # of one start, the longest ends last
        if NONE not in longest:
            return self._run(text, longest) if text else []
        out: list[int] = []
        at = 0
        while at < len(text):
            to = at
            while to < len(text) and longest[to] != NONE:
                to += 1
            if to > at:
                out += self._run(text[at:to], longest[at:to])
            else:
                to += 1
                out += [self.bytes[b] for b in text[at].encode()]
            at = to
        return out

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(" " + text.replace(MARK, " ")) if text else []


_KNOWN: dict[str, tuple[Pieces, Remembered]] = {}


def encoder_of(model: str) -> tuple[Pieces, Remembered]:
    """This worker's pieces and remembered chunks of a model."""
    if model not in _KNOWN:
        pieces = Pieces(model)
        _KNOWN[model] = pieces, Remembered(pieces.encode)
    return _KNOWN[model]


def _id_of(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def encode(docs: DataFrame, model: str, ends: bool = True) -> DataFrame:
    """doc_id and ids (array<int>) of each row's whole text, with the begin and end ids if ends. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = encoder_of(model)
        first, last = (array("I", [k]).tobytes() if ends else b"" for k in (pieces.begin, pieces.end))
        for batch in slices(batches, SLICE):
            ids = [first + known.of(pieces.chunks(t.as_py() or "")) + last for t in batch.column(1)]
            column = pa.array([array("I", i).tolist() for i in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"{_id_of(docs)}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids decode to an empty text. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = encoder_of(model)
        for batch in slices(batches, SLICE):
            texts = pieces.library.decode([i.as_py() or [] for i in batch.column(1)], num_threads=1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"{_id_of(encoded)}, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded and decoded in the same pass, map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = encoder_of(model)
        first, last = (array("I", [k]).tobytes() for k in (pieces.begin, pieces.end))
        decoded = pieces.library.decode
        for batch in slices(batches, SLICE):
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = first + known.of(pieces.chunks(text.as_py() or "")) + last
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded(array("I", ids).tolist()).encode()).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"{_id_of(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
