"""Near-duplicates by SetSketch registers: bands of registers, likelihood, then the full sets.

A document's set is its distinct five-word shingles (64-bit hashes of words in ASCII lower case; of fewer words, the
whole sequence is one shingle). A sketch has REGISTERS registers: the minimum over the set of an
exponential variable, on a scale of powers of BASE, cut off to 16 bits. Sketches of parts merge by maximum,
and equal registers are the likelier the more two sets overlap.

1. Documents with equal sets are one class, represented by its smallest id.
2. Representatives that share a band of ROWS registers are candidates. At a similarity of 0.75 the BANDS bands
   miss a pair with probability (1 - 0.75**5)**64, or 3e-8. Within a band's bucket every member is first
   paired with the bucket's smallest id only.
3. A pair goes on if the joint likelihood of both sketches, given the sizes of the sets, puts the similarity
   within SLACK (four standard deviations) of the limit, and is then decided on the full sets.
4. In buckets whose members are not all one component by now, every pair across components is a candidate
   too. Such a bucket is cut into blocks by a hash, and a task compares the sketches of two blocks, each pair in the
   first bucket that it shares. It gives out the members of pairs that pass step 3's likelihood: no pairs.
5. Those members come back to their blocks with their full sets, and the task decides such pairs on these. A pair
   whose components a link of the block has joined already is passed over, so a block gives out fewer links than
   it has members. Pairs inside a component cannot change it; so no link between components is lost, and neither a
   group of thousands of copies nor one of thousands of almost-copies is ever expanded into its pairs.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing; rows that share an id and a set
are one document; of an id with several sets the least set takes part, and rows with the others are linked with nothing
and kept under their own id; a row with a null id is linked with nothing, kept, and has no component id; an empty
table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.components import components
from pactum.llm.shared import give_back, slices, small, written

SHINGLE, LIMIT = 5, 75
BANDS, ROWS = 64, 5
REGISTERS = BANDS * ROWS
#: Rate, base and largest value of the registers' scale.
RATE, BASE, LARGEST = 20.0, 1.001, 65_534
#: Members of a bucket that one task compares with as many others, and shingles of all of them, about.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: How far below the limit an estimate may be for its pair to be decided on the full sets.
SLACK = 4 * (LIMIT / 100 * (1 - LIMIT / 100) / REGISTERS) ** 0.5

_SEEDS = np.random.default_rng(2021)
_FACTORS = _SEEDS.integers(0, 2**64, REGISTERS, np.uint64) | np.uint64(1)
_OFFSETS = _SEEDS.integers(0, 2**64, REGISTERS, np.uint64)
_POWERS = _SEEDS.integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)
_BLOCK = 1024
#: Sets that a task gives out at a time.
SLICE = 500


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes. Bytes split at ASCII blanks and lower() in ASCII only."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for k in range(min(size, len(words))):
        out = out + _mixed(hashes[k : k + n] + _POWERS[k]) * _POWERS[k]
    return np.unique(_mixed(out))


def registers(elements: np.ndarray) -> np.ndarray:
    """The registers of a set of hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), _BLOCK):
        part = elements[at : at + _BLOCK, None] * _FACTORS + _OFFSETS
        np.minimum(least, part.min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(float) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LARGEST + 1).astype(">u2")


def estimate(one: np.ndarray, two: np.ndarray, sizes_one: np.ndarray, sizes_two: np.ndarray) -> np.ndarray:
    """The similarity of most joint likelihood of each pair of register rows, on a grid of hundredths."""
    u = (sizes_one / (sizes_one + sizes_two))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101) * np.minimum(u / v, v / u)
    larger, smaller = (one > two).sum(1)[:, None], (one < two).sum(1)[:, None]

    def share(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = share(u - v * grid), share(v - u * grid)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    likelihood = larger * log(up) + smaller * log(down) + (REGISTERS - larger - smaller) * log(1 - up - down)
    return grid[np.arange(len(grid)), likelihood.argmax(1)]


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole set), registers and text_key of each row: map-only."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.md5("text").alias("text_key"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, rows = [], [], []
            for text in batch.column(1):
                elements = shingles(text.as_py(), size)
                n.append(len(elements))
                keys.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None)
                rows.append(registers(elements).tobytes() if len(elements) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary()), batch.column(2)],
                names=["doc_id", "n_shingles", "set_key", "registers", "text_key"],
            )
        give_back()

    return docs.mapInArrow(sketched, "doc_id long, n_shingles long, set_key binary, registers binary, text_key string")


def likely(pairs: DataFrame, classes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The pairs (a, b) whose sizes allow the limit and whose sketches make it likely."""
    one = classes.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a"))
    two = classes.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b"))
    both = pairs.join(one, "a").join(two, "b").filter(
        100 * F.least("n_a", "n_b") >= limit * F.greatest("n_a", "n_b")
    ).select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u2").reshape(-1, REGISTERS) for k in (4, 5)
            )
            n_a, n_b = (batch.column(k).to_numpy().astype(float) for k in (2, 3))
            keep = estimate(one, two, n_a, n_b) >= limit / 100 - SLACK
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(judged, "a long, b long")


def sets_of(docs: DataFrame, ids: DataFrame, classes: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, elements) of the classes whose id is among ids (id), once each: of the text that stands for the class."""
    chosen = written(classes.select("id", "text_key").join(ids, "id", "left_semi"), "near-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            values = [shingles(t.as_py(), size).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64()))], names=["id", "elements"])
        give_back()

    found = rows.withColumn("text_key", F.md5("text")).join(small(chosen), ["id", "text_key"]).select("id", "text")
    sets = written(found.mapInArrow(shingled, "id long, elements array<long>"), "near-sets")
    return sets if sets.count() == chosen.count() else sets.dropDuplicates(["id"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the limit."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = sets_of(docs, ids, classes, size)
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("set_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("elements").alias("set_b")), "b"
    )
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - F.col("common")
    return joined.withColumn("common", common).filter(100 * F.col("common") >= limit * union).select("a", "b")


def one_set_an_id(sketched: DataFrame) -> DataFrame:
    """The rows; of an id that has several sets only the least set keeps its key and so takes part in linking."""
    several = written(
        sketched.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.min("set_key").alias("least_key"), F.max("set_key").alias("last_key")
        ).filter("least_key < last_key").select("doc_id", "least_key"), "near-several",
    )
    if several.isEmpty():
        return sketched
    least = F.col("least_key").isNull() | (F.col("set_key") == F.col("least_key"))
    return sketched.join(small(several), "doc_id", "left").withColumn("set_key", F.when(least, F.col("set_key"))).drop("least_key")


def classes_of(sketched: DataFrame) -> DataFrame:
    """id (smallest of the class) and its text_key, set_key, n_shingles and registers of each class of equal sets."""
    return sketched.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("n_shingles").alias("n_shingles"), F.min("registers").alias("registers")
    ).select("set_key", F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("text_key"), "n_shingles", "registers")


def band_entries(classes: DataFrame) -> DataFrame:
    """(id, n_shingles, bucket, band): a bucket for each band of each class."""
    width = 2 * ROWS
    return classes.select("id", "n_shingles", F.inline(F.array(*[
        F.struct(F.xxhash64(F.lit(k), F.substring("registers", width * k + 1, width)).alias("bucket"), F.lit(k).alias("band"))
        for k in range(BANDS)
    ])))


MEMBER = "bucket long, low int, high int, band int, block int, first_id long, id long, component long, n_shingles long, registers binary"


def blocks(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of open buckets with their sketches, once for each pair of blocks (low, high) that they are in."""
    rows = entries.join(classes.select("id", "registers"), "id")
    sizes = entries.groupBy("bucket").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts")
    )
    split = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    ).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return split.select(*[field.split()[0] for field in MEMBER.split(", ")])


class Block:
    """Two blocks of a bucket: their members' columns."""

    def __init__(self, table: pa.Table):
        (self.low, *_), (self.high, *_), (self.band, *_) = (table.column(k).to_pylist()[:1] for k in (1, 2, 3))
        self.block, self.first, self.ids, self.component, self.sizes = (table.column(k).to_numpy() for k in range(4, 9))
        self.registers = np.frombuffer(b"".join(table.column(9).to_pylist()), ">u2").astype(np.uint16).reshape(-1, REGISTERS)

    def likely(self, limit: int) -> Iterator[tuple[int, np.ndarray]]:
        """A member and others, each a likely pair across components that shares no bucket of an earlier band.

        Pairs with the bucket's first id were decided before.
        """
        least, banded = limit / 100 - SLACK, self.registers.reshape(-1, BANDS, ROWS)
        right = np.flatnonzero(self.block == self.high)
        for i in np.flatnonzero(self.block == self.low):
            if self.ids[i] == self.first[i]:
                continue
            other = right[right > i] if self.low == self.high else right
            near = np.minimum(self.sizes[other], self.sizes[i]) * 100 >= limit * np.maximum(self.sizes[other], self.sizes[i])
            other = other[near & (self.component[other] != self.component[i]) & (self.ids[other] != self.first[i])]
            if self.band and len(other):
                other = other[~(banded[other, : self.band] == banded[i, : self.band]).all(axis=2).any(axis=1)]
            if len(other):
                mine = np.broadcast_to(self.registers[i], (len(other), REGISTERS))
                sizes = np.full(len(other), self.sizes[i], float)
                other = other[estimate(mine, self.registers[other], sizes, self.sizes[other].astype(float)) >= least]
            if len(other):
                yield i, other


def by_block(rows: DataFrame, judge: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What ``judge`` gives for the rows of each bucket, low and high that lie in more than one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(table: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
            change = np.zeros(table.num_rows, bool)
            for k in range(3):
                key = table.column(k).to_numpy()
                change[1:] |= key[1:] != key[:-1]
            starts = [0, *np.flatnonzero(change).tolist()]
            ends = [*starts[1:], table.num_rows]
            component = table.column(7).to_numpy()
            found = []
            for at, end in list(zip(starts, ends))[: None if last else -1]:
                if end - at > 1 and (component[at:end] != component[at]).any():
                    found.append(judge(table.slice(at, end - at)))
            return [f for f in found if f is not None], None if last else table.slice(starts[-1])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
                found, held = groups(held, False)
                yield from found
        if held is not None:
            yield from groups(held, True)[0]
        held = None
        give_back()

    key = ["bucket", "low", "high"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def across(entries: DataFrame, classes: DataFrame, docs: DataFrame, size: int, limit: int) -> DataFrame:
    """Links (a, b) between components: of each pair of blocks a spanning set of those whose full sets reach the limit.

    entries: bucket, band, first_id, id, component, n_shingles.
    """

    def members(table: pa.Table) -> pa.RecordBatch | None:
        keep = np.zeros(table.num_rows, bool)
        for i, other in Block(table).likely(limit):
            keep[i] = True
            keep[other] = True
        return table.filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else None

    def links(table: pa.Table) -> pa.RecordBatch | None:
        block, sets = Block(table), table.column(10).combine_chunks()
        root = {c: c for c in block.component.tolist()}
        out: list[tuple[int, int]] = []

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        elements = lambda k: sets[int(k)].values.to_numpy()
        for i, other in block.likely(limit):
            mine = elements(i)
            for j in other:
                one, two = top(block.component[i]), top(block.component[j])
                if one == two:
                    continue
                theirs = elements(j)
                common = len(np.intersect1d(mine, theirs, assume_unique=True))
                if 100 * common >= limit * (len(mine) + len(theirs) - common):
                    root[one] = two
                    out.append((int(block.ids[i]), int(block.ids[j])))
        if not out:
            return None
        a, b = np.array(out).T
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    marked = written(by_block(blocks(entries, classes), members, MEMBER), "near-members")
    sets = sets_of(docs, marked.select("id").distinct(), classes, size)
    return by_block(marked.join(sets, "id").select(*marked.columns, "elements"), links, "a long, b long")


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links: these are few, and the components that they join are nodes of a small graph."""
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")
    )
    merged = components(ends)
    renamed = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
    return renamed.select("node", F.coalesce("least", "component").alias("component")).unionByName(
        merged.join(found.select("node"), "node", "left_anti")
    )


def judged_rows(docs: DataFrame, size: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept: one row for each row of docs."""
    sketched = one_set_an_id(written(sketches(docs, size), "near-sketches"))
    classes = written(classes_of(sketched), "near-classes")
    entries = band_entries(classes)
    shared = entries.groupBy("bucket").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("first_id < last_id")
    crowded = written(entries.join(shared.select("bucket", "first_id"), "bucket"), "near-entries")
    first = written(crowded.filter("id <> first_id").select(F.col("first_id").alias("a"), F.col("id").alias("b")).distinct(), "near-pairs")
    links = written(verified(written(likely(first, classes, limit), "near-likely"), docs, classes, size, limit), "near-links")
    found = components(links)

    placed = crowded.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "bucket", "band", "first_id", "id", "n_shingles", F.coalesce("component", "id").alias("component")
    )
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_entries = written(placed.join(mixed.select("bucket"), "bucket"), "near-open")
    more = written(across(open_entries, classes, docs, size, limit), "near-links")
    if more.limit(1).count():
        found = joined_components(found, more)

    by_class = classes.select("set_key", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("class_component")
    )
    own = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("class_component")), F.col("doc_id"))
    return sketched.join(by_class, "set_key", "left").select(
        "doc_id", "text_key", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept")
    )


def duplicates(docs: DataFrame, size: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: one row for each row of docs."""
    return judged_rows(docs, size, limit).drop("text_key")


def without_duplicates(docs: DataFrame, size: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """The documents, all columns, without those that are not the first of their component: judged by id and text."""
    out = judged_rows(docs, size, limit).filter("NOT kept").select(F.col("doc_id").alias("gone_id"), "text_key").distinct()
    gone = small(written(out, "near-gone"))
    same = (docs["doc_id"] == gone["gone_id"]) & (F.md5(docs["text"].cast("string")) == gone["text_key"])
    return docs.join(gone, same, "left_anti")
