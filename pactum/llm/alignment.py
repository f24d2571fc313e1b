"""Two tokenizers' tokens of the same texts, aligned in windows between shared ends.

A is a byte-level vocabulary (of a space and the text), B a SentencePiece model of merge type (of the text, before
which it sets a space), so both cover the same bytes.

1. Every text is tokenised whole by both: cut at single spaces before a character that is no white space, which no word
   of A and no piece of B reaches over (the model's pieces are looked through for that), stretches are tokenised and
   remembered. Where a stretch starts, the tokens of both start with a space and those before end at the same byte: a
   shared end, verified by the stretch's bytes. Stretches so are the windows. Each task aligns a window once: its groups
   (cut wherever tokens of both end together) and its links (pairs of tokens whose bytes overlap). Alignments are
   remembered by stretch, which, as both sides lose no byte, is the same as by the window's tuples of token ids. The
   windows of some documents that are not known yet are tokenised and aligned together, as one text of shared ends:
   each piece between two ends that follow each other lies in one token of A and one of B and so is one link.
2. A text counts only if the bytes of both sides' tokens are those of each of its windows; else it has no tokens.
3. Links are counted over the corpus, from each document's windows and their numbers, with map-side combine. The
   table of id pairs is broadcast only where its counted rows stay in PAIR_ROWS; else the same join is shuffled,
   and the documents' side, where a frequent pair is hot, can be split.

Defined cases: null and empty texts, and texts with tokens of other bytes (such as those holding U+2581), get zeros and
an empty groups_sha256; a null doc_id is kept; repeated rows each count; an empty table gives no rows. Strings of
special tokens are plain text. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.chunks import byte_level_bytes
from pactum.llm.sentence_pieces import MARK, encoder_of
from pactum.llm.shared import slices, written

#: Windows whose alignment a worker remembers, and the longest stretch, in characters, that it does.
WINDOWS, LONGEST = 150_000, 64
#: A single space before a character that is no white space: both tokenizers' tokens end before it.
STRETCH = re.compile(r"(?<! ) (?=\S)")
#: How a byte-level vocabulary parts texts before it merges. Fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANKS = re.compile(r"\s{2000}")
#: Rows of the table of id pairs (three numbers each) up to which it is broadcast.
PAIR_ROWS = 500_000
#: Documents a task works on at a time.
SLICE = 100

LINKS = "array<struct<a:int,b:int,times:int>>"
COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Side:
    """One tokenizer: the ids of a text that starts with a space, and each id's bytes and their number."""

    def __init__(self, ids_of: Callable[[str], list[int]], token_bytes: list[bytes]):
        self.ids_of, self.token_bytes = ids_of, token_bytes
        self.lengths = [len(t) for t in token_bytes]

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join([self.token_bytes[k] for k in ids])


def byte_side(vocabulary: str) -> Side:
    """Tokens by a byte-level vocabulary file of the tokenizers library.

    Its merges must come in the order of the ids that they make; then tiktoken, given these as ranks, merges alike, and
    encodes several times faster than the library.
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)
    stand_in = byte_level_bytes()
    words = model["model"]["vocab"]
    merged = [words["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    ranks = {bytes(map(stand_in.__getitem__, w)): k for w, k in words.items() if w not in special}
    if merged != list(range(256, 256 + len(merged))) or model.get("normalizer") or sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError(f"{vocabulary} is not a plain byte-level vocabulary")
    encode = tiktoken.Encoding(vocabulary, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids_of(text: str) -> list[int]:
        if len(text) > 2000 and BLANKS.search(text):  # a run so long that tiktoken's expressions give up
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(vocabulary)
            library.encode_special_tokens = True
            return library.encode(text, add_special_tokens=False).ids
        return encode(text)

    token_bytes = [b""] * (1 + max([*ranks.values(), *special.values()]))
    for data, k in ranks.items():
        token_bytes[k] = data
    return Side(ids_of, token_bytes)


def piece_side(model: str) -> Side:
    """Tokens by a SentencePiece model, of a text that starts with the space which the model sets itself."""
    pieces = encoder_of(model)[0]  # which also checks that the model is of merge type
    of_byte = {k: bytes([b]) for b, k in enumerate(pieces.bytes)}
    if any(re.search(f"[^{MARK}]{MARK}", text) for text in pieces.id):
        raise ValueError(f"pieces of {model} reach over spaces")
    token_bytes = [
        of_byte.get(k, pieces.text.get(k, "").replace(MARK, " ").encode()) for k in range(pieces.library.vocab_size())
    ]
    encode = pieces.library.encode
    return Side(lambda text: encode(text[1:]), token_bytes)


def align(a: list[int], b: list[int], side_a: Side, side_b: Side) -> tuple[str, int, list[int]]:
    """The groups of one window as text, their number, and its links one after another (a, b, a, b, ...).

    The window's bytes are the same on both sides.
    """
    if len(a) == len(b) == 1:
        return f"{a[0]}|{b[0]}", 1, [a[0], b[0]]
    long_a, long_b = side_a.lengths, side_b.lengths
    n, at_a, at_b = 1, 1, 1
    one, two = a[0], b[0]
    end_a, end_b = long_a[one], long_b[two]
    links = [one, two]
    texts, own_a, own_b = [], str(one), str(two)
    while at_a < len(a) or at_b < len(b):
        if end_a == end_b:  # both start a token here
            texts.append(f"{own_a}|{own_b}")
            n += 1
            one, two = a[at_a], b[at_b]
            at_a, at_b = at_a + 1, at_b + 1
            end_a += long_a[one]
            end_b += long_b[two]
            own_a, own_b = str(one), str(two)
        elif end_a < end_b:
            one = a[at_a]
            at_a += 1
            end_a += long_a[one]
            own_a = f"{own_a},{one}"
        else:
            two = b[at_b]
            at_b += 1
            end_b += long_b[two]
            own_b = f"{own_b},{two}"
        links += one, two
    texts.append(f"{own_a}|{own_b}")
    return ";".join(texts), n, links


class Windows(dict):
    """A stretch of text, after its space, to the number of its window; numbers hold until all is forgotten."""

    def __init__(self, side_a: Side, side_b: Side):
        super().__init__()
        self.side_a, self.side_b = side_a, side_b
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.text: list[bytes | None] = []
        self.links: list[bytes] = []
        #: n_a, n_b and n_groups of each window, one after another.
        self.sizes = array("q")
        #: Stretches too long to be remembered, for the documents at hand.
        self.brief: dict[str, int] = {}

    def __missing__(self, stretch: str) -> int:
        if stretch not in self.brief:
            self._learn_alone(stretch)
        return self.brief[stretch] if stretch in self.brief else self[stretch]

    def _learn_alone(self, stretch: str) -> None:
        stretch_bytes = f" {stretch}".encode()
        a, b = self.side_a.ids_of(f" {stretch}"), self.side_b.ids_of(f" {stretch}")
        if self.side_a.bytes_of(a) == stretch_bytes == self.side_b.bytes_of(b):
            text, n, links = align(a, b, self.side_a, self.side_b)
            self._hold(stretch, text.encode(), array("i", links).tobytes(), (len(a), len(b), n))
        else:
            self._hold(stretch, None, b"", (0, 0, 0))

    def _hold(self, stretch: str, text: bytes | None, links: bytes, sizes: tuple[int, int, int]) -> None:
        (self if len(stretch) <= LONGEST else self.brief)[stretch] = len(self.text)
        self.text.append(text)
        self.links.append(links)
        self.sizes.extend(sizes)

    def learn(self, stretches: list[str]) -> None:
        """Tokenises and aligns stretches that are not known, as one text; one by one where its bytes are not the tokens'."""
        text = " " + " ".join(stretches)
        data = text.encode()
        a, b = self.side_a.ids_of(text), self.side_b.ids_of(text)
        stops = np.cumsum([len(s.encode()) + 1 for s in stretches])
        end_a, end_b = (np.cumsum([side.lengths[k] for k in ids]) for side, ids in ((self.side_a, a), (self.side_b, b)))
        to_a, to_b = np.searchsorted(end_a, stops), np.searchsorted(end_b, stops)
        same = self.side_a.bytes_of(a) == data == self.side_b.bytes_of(b)
        if not same or (end_a[to_a] != stops).any() or (end_b[to_b] != stops).any():
            for stretch in stretches:
                self._learn_alone(stretch)
            return
        ends = np.union1d(end_a, end_b)
        links = np.stack([np.array(a, np.int32)[np.searchsorted(end_a, ends)], np.array(b, np.int32)[np.searchsorted(end_b, ends)]], axis=1)
        link_bytes = links.tobytes()
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = ((np.searchsorted(end, shared) + 1).tolist() for end in (end_a, end_b))
        text_a, text_b = list(map(str, a)), list(map(str, b))
        groups = [
            f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip([0, *of_a], of_a, [0, *of_b], of_b)
        ]
        bounds = [(np.searchsorted(x, stops) + 1).tolist() for x in (end_a, end_b, shared, ends)]
        since = (0, 0, 0, 0)
        for stretch, *to in zip(stretches, *bounds):
            own = ";".join(groups[since[2] : to[2]]).encode()
            self._hold(stretch, own, link_bytes[8 * since[3] : 8 * to[3]], (to[0] - since[0], to[1] - since[1], to[2] - since[2]))
            since = to

    def of(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's windows."""
        self.brief = {}
        parts = [stretches(text) if text else [] for text in texts]
        new = [s for s in set(chain.from_iterable(parts)) if s not in self]
        if new:
            self.learn(new)
        return [list(map(self.__getitem__, own)) for own in parts]


def stretches(text: str) -> list[str]:
    """A text's stretches, each without the space before it; where blanks follow the text's own first space, that only goes."""
    first, *rest = STRETCH.split(f" {text}")
    return [first[1:], *rest] if first else rest


_KNOWN: dict[tuple[str, str], Windows] = {}


def windows_of(vocabulary: str, model: str) -> Windows:
    """This worker's tokenizers and remembered windows."""
    if (vocabulary, model) not in _KNOWN:
        _KNOWN[vocabulary, model] = Windows(byte_side(vocabulary), piece_side(model))
    return _KNOWN[vocabulary, model]


def aligned(docs: DataFrame, vocabulary: str, model: str, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and links of each row: map-only.

    links holds a window's links with the number of times the window occurs in the document, so that an id pair may
    stand in it more than once. With groups, the groups themselves follow as text (``a1,a2|b1;a3|b2,b3``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows_of(vocabulary, model)
        for batch in slices(batches, SLICE):
            if len(known.text) >= WINDOWS:
                known.restart()
            digests, texts, numbers, counts = [], [], [], []
            for found in known.of([value.as_py() or "" for value in batch.column(1)]):
                parts = [known.text[w] for w in found]
                if not parts or None in parts:
                    digests.append("")
                    texts.append("")
                    counts.append(0)
                    continue
                line = b";".join(parts)
                digests.append(hashlib.sha256(line).hexdigest())
                texts.append(line.decode() if groups else "")
                numbers += found
                counts.append(len(found))
            rows = batch.num_rows
            entry = np.repeat(np.arange(rows), counts) << 32 | np.array(numbers, np.int64)
            entry, times = np.unique(entry, return_counts=True)
            row, window = entry >> 32, entry & 0xFFFFFFFF
            per_window = [known.links[w] for w in window.tolist()]
            links = np.array([len(x) // 8 for x in per_window], np.int64)
            pairs = np.frombuffer(b"".join(per_window), np.int32).reshape(-1, 2)
            offsets = np.concatenate([[0], np.bincount(row, links, rows).cumsum()]).astype(np.int32)
            structs = pa.StructArray.from_arrays(
                [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(np.repeat(times, links).astype(np.int32))],
                names=["a", "b", "times"],
            )
            sizes = np.array(known.sizes, np.int64).reshape(-1, 3)[window]
            total = lambda of_window: pa.array(np.bincount(row, of_window * times, rows).astype(np.int64))
            columns = {
                "doc_id": batch.column(0), "n_a": total(sizes[:, 0]), "n_b": total(sizes[:, 1]), "n_groups": total(sizes[:, 2]),
                "n_links": total(links), "groups_sha256": pa.array(digests, pa.string()),
                "links": pa.ListArray.from_arrays(pa.array(offsets), structs),
            }
            if groups:
                columns["groups"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COUNTS}, links {LINKS}" + (", groups string" if groups else "")
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, n (links of the corpus that hold the pair) and best (whether n is the highest of b's pairs)."""
    counts = rows.select(F.inline("links")).groupBy("a", "b").agg(F.sum(F.col("times").cast("long")).alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def report(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256: one row for each row of docs."""
    rows = written(aligned(docs, vocabulary, model).withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = written(pair_counts(rows), "aligned-pairs")
    if pairs.count() <= PAIR_ROWS:
        pairs = F.broadcast(pairs)
    times = F.col("times").cast("long")
    sums = rows.select("row", F.inline("links")).join(pairs, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), times).otherwise(F.lit(0))).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum")
    )
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("links").join(sums, "row", "left").select(
        F.col("doc_id").cast("long"), "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256"
    )
