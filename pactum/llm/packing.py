"""Best-fit packing of pieces into sequences under several capacities at once.

Each piece is a vector: its tokens, one document, and its attention cost (the square of its tokens,
as documents of a sequence do not attend to each other). A sequence has a residual of each capacity.
Pieces are taken longest first; among the open sequences that can take a piece under every capacity,
the one is chosen whose residual after it has the least weighted norm (``rule="norm"``), or whose residual
has the largest weighted dot product with the piece (``rule="dot"``); if none can, a new one is opened.

The pieces are written, then dealt out evenly to windows of about WINDOW rows, so each window sees the table's
mix of lengths, however the input is sorted or split; a task packs a window on its own, so its memory is bounded.
The pieces of sequences that are filled to less than FULL are dealt out and packed again, in windows of all
that are left, until these sequences are no longer fewer or one window has held them all. Only piece rows are
shuffled, no texts. Sequence ids hold the numbers of the round and of the partition, so they are unique and the
same when a lost task is run again.

Defined cases: a null text is a document of one id; a null doc_id is carried; repeated rows are packed
each; an empty table gives no rows; a piece that exceeds a capacity alone gets a sequence of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.shared import written
from pactum.llm.tokens import MAX_TOKENS, pieces

#: Pieces packed together in one task.
WINDOW = 16_384
#: Sequences with a smaller share of their tokens are packed again.
FULL = 0.99
#: Weights of tokens, documents and attention cost, as shares of their capacities.
WEIGHTS = (1.0, 0.05, 0.05)


def best_fit(
    lengths: np.ndarray, max_tokens: int, max_documents: int, max_attention: int,
    weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, sequences numbered from 0."""
    n = len(lengths)
    sequence, offset = np.empty(n, np.int64), np.zeros(n, np.int64)
    capacity = np.array([max_tokens, max_documents, max_attention], np.int64)
    scale = np.array(weights) / capacity.astype(float) ** 2
    residual, number = np.empty((3, n), np.int64), np.empty(n, np.int64)
    opened = active = 0
    least = int(lengths.min()) if n else 0
    for i in np.argsort(-lengths, kind="stable"):
        size = np.array([lengths[i], 1, lengths[i] * lengths[i]], np.int64)
        at = -1
        if active:
            after = residual[:, :active] - size[:, None]
            score = scale @ (after * after.astype(float)) if rule == "norm" else -(scale * size) @ residual[:, :active]
            score[(after < 0).any(axis=0)] = np.inf
            at = int(score.argmin())
            if score[at] == np.inf:
                at = -1
        if at < 0:
            at = active
            residual[:, at], number[at] = capacity, opened
            active += 1
            opened += 1
        sequence[i], offset[i] = number[at], max_tokens - residual[0, at]
        residual[:, at] -= size
        if residual[0, at] < least or residual[1, at] < 1 or residual[2, at] < least * least:
            active -= 1
            residual[:, at], number[at] = residual[:, active], number[active]
    return sequence, offset


def packer(
    at: int, max_tokens: int = MAX_TOKENS, max_documents: int | None = None, max_attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", turn: int = 0,
):
    """From batches whose column ``at`` is a length to the same with sequence_id, offset and the sequence's tokens, for a task.

    Without the optional capacities those hold that the tokens imply: a document has at least one token, and
    the squares of lengths never exceed the square of their sum.
    """
    documents = max_documents or max_tokens
    attention = max_attention or max_tokens * max_tokens

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (turn << 56) + (TaskContext.get().partitionId() << 32)
        held: list[pa.RecordBatch] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = table.column(at).to_numpy()
            sequence, offset = best_fit(lengths, max_tokens, documents, attention, weights, rule)
            filled = np.bincount(sequence, weights=lengths).astype(np.int64)[sequence]
            out = table.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))
            out = out.append_column("_filled", pa.array(filled))
            base += int(sequence.max()) + 1
            yield from out.to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= WINDOW:
                yield from flush()
                held, count = [], 0
        if held:
            yield from flush()

    return packed


PLACE = "sequence_id long, offset long, _filled long"


def pack(rows: DataFrame, **options) -> DataFrame:
    """The rows (with a column ``length``) and their sequence_id and offset; options as of :func:`packer`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    max_tokens = options.get("max_tokens", MAX_TOKENS)
    loose = F.col("_filled") < FULL * max_tokens
    rest, done, before, turn = written(rows, "pieces"), [], None, 0
    n = rest.count()
    while True:
        windows = max(1, -(-n // WINDOW))
        place = packer(rows.columns.index("length"), turn=turn, **options)
        packed = written(rest.repartition(windows).mapInArrow(place, f"{schema}, {PLACE}"), "packed")
        if before is not None:
            last, fewest = before
            if packed.agg(F.count_distinct("sequence_id")).first()[0] >= fewest:
                done.append(last)
                break
        if windows == 1:
            done.append(packed)
            break
        left = packed.filter(loose)
        n, tokens, found = left.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.count_distinct("sequence_id")).first()
        if found <= -(-tokens // max_tokens):
            done.append(packed)
            break
        done.append(packed.filter(~loose))
        rest, before, turn = left.select(*rows.columns), (left, found), turn + 1
    return reduce(DataFrame.unionByName, done).drop("_filled")


def pack_documents(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(pieces(docs, vocabulary, options.get("max_tokens", MAX_TOKENS)), **options)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from packed pieces that carry ids; a sequence is at most max_tokens long."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids")
    )
