"""Law corpus: tokens, hashed vectors, exact top-k search, reference lookup, citations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pactum.functions.quantities import let
from pactum.functions.text import normalise_search

# Word lists, prefixes and weights.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have",
    "he", "his", "if", "in", "is", "it", "its", "may", "of", "on", "or", "shall",
    "such", "that", "the", "their", "them", "they", "this", "to", "was", "which", "will", "with",
    "any", "all", "not", "no", "other", "upon", "than", "these", "those", "been", "were", "can",
    "must", "each", "في", "من", "علي", "الي", "عن", "ان", "او", "ما", "لا", "هذا",
    "هذه", "ذلك", "التي", "الذي", "مع", "قد", "اذا", "كان",
]
ARTICLE_PREFIXES = ("وال", "بال", "كال", "فال", "ولل", "لل", "ال")
COMMON_WORDS = [
    "employer", "employee", "worker", "contract", "employment", "work", "law", "article",
    "provision", "عامل", "صاحب", "عمل", "عقد", "نظام", "ماده", "طرف",
    "طرفين",
]
NGRAM = 3
WORD_WEIGHT, COMMON_WEIGHT, NGRAM_WEIGHT = 1.0, 0.25, 0.4
DIM = 256
FNV_OFFSET, FNV_PRIME, U32 = 2166136261, 16777619, 4294967295
SOURCE_ORDER = {"labor_law": 0, "implementing_regulations": 1, "qiwa_template": 2}
HEADINGS = {
    "labor_law": ("Article ", "المادة "),
    "implementing_regulations": (
        "Implementing Regulations Article ",
        "اللائحة التنفيذية المادة ",
    ),
    "qiwa_template": ("Contract clause ", "البند "),
}
# Blocks into which queries and corpus are cut; a task scores one block of each.
QUERY_BLOCKS, CORPUS_BLOCKS = 16, 16
# Scores a task holds at once.
SCORES = 4_000_000
# Words and texts embedded at once, and the longest names hashed together.
SLICE, TEXTS, TOGETHER = 250_000, 4_000, 64


def _list(words) -> Column:
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def tokens(text: Column) -> Column:
    """Normalised words without stop words; articles stripped, English plurals folded."""
    words = F.split(normalise_search(text), r"[^\p{L}\p{N}]+")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS))
    prefix = "^(?:" + "|".join(ARTICLE_PREFIXES) + r")(?=..)"

    def fold(w: Column) -> Column:
        # Expressions look at the last letters first; only few words reach a pattern.
        bare = F.when(w >= "\u0621", F.regexp_replace(w, prefix, "")).otherwise(w)
        plural = bare.endswith("s") & ~bare.endswith("ss") & bare.rlike("^[a-z]{4,}$")
        cut = lambda n: F.substring(bare, F.lit(1), F.length(bare) - n)
        return F.when(plural, F.when(bare.endswith("ies"), F.concat(cut(3), F.lit("y"))).otherwise(cut(1))).otherwise(bare)

    return F.filter(F.transform(kept, fold), lambda w: (F.length(w) > 1) | w.rlike(r"\d"))


def word_features(word: Column) -> Column:
    """``array<struct<name, weight>>`` of one word: the word and its character trigrams."""
    padded = F.concat(F.lit("<"), word, F.lit(">"))
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(padded) - (NGRAM - 1), F.lit(1))),
        lambda i: F.struct(
            F.concat(F.lit("c:"), F.substring(padded, i, F.lit(NGRAM))).alias("name"),
            F.lit(NGRAM_WEIGHT).alias("weight"),
        ),
    )
    own = lambda w: F.array(
        F.struct(F.concat(F.lit("w:"), word).alias("name"), F.lit(w).alias("weight"))
    )
    common = word.isin(*COMMON_WORDS)
    return F.when(common, own(COMMON_WEIGHT)).otherwise(F.concat(own(WORD_WEIGHT), grams))


def features(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys, name, weight``. Words are counted before they are cut into trigrams.

    A text's words are dealt out by the keys before they are spread, so the many rows that follow are grouped where they
    are and only the words are shuffled."""
    spark = texts.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = texts.select(*keys, tokens(F.col("text")).alias("_t")).repartition(n, *keys)
    words = dealt.select(*keys, F.explode("_t").alias("word"))
    counted = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.select(*keys, "n", F.inline(word_features(F.col("word"))))
    return rows.groupBy(*keys, "name").agg(F.sum(F.col("weight") * F.col("n")).alias("weight"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units: a character beyond the first plane counts as its two surrogates."""

    def step(h: Column, unit: Column) -> Column:
        return (h.bitwiseXOR(unit) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(U32))

    def steps(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("bigint")
        above = code - 0x10000
        high, low = F.lit(0xD800) + F.shiftright(above, 10), F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))
        return F.when(c == "", h).when(code < 0x10000, step(h, code)).otherwise(step(step(h, high), low))

    return F.aggregate(F.split(text, ""), F.lit(FNV_OFFSET).cast("bigint"), steps)


def _fnv1a_of(name: str) -> int:
    h = FNV_OFFSET
    units = name.encode("utf-16-le", "surrogatepass")
    for low, high in zip(units[::2], units[1::2]):
        h = (h ^ (low | high << 8)) * FNV_PRIME & U32
    return h


def _steps(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """One further character of each name, as in :func:`fnv1a`."""
    prime, above = np.uint32(FNV_PRIME), points >= 0x10000
    found = (h ^ points) * prime
    if above.any():
        over = points[above] - np.uint32(0x10000)
        high = (h[above] ^ (np.uint32(0xD800) + (over >> np.uint32(10)))) * prime
        found[above] = (high ^ (np.uint32(0xDC00) + (over & np.uint32(0x3FF)))) * prime
    return found


def _hashes(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, prefix: str) -> np.ndarray:
    """:func:`fnv1a` of ``prefix`` and each run of code points: all names advance together by a character."""
    h = np.full(len(starts), _fnv1a_of(prefix), np.uint32)
    order = np.argsort(-lengths, kind="stable")
    longer = -lengths[order]
    long_names = np.searchsorted(longer, -TOGETHER)
    for i in order[:long_names]:
        h[i] = _fnv1a_of(prefix + points[starts[i] : starts[i] + lengths[i]].tobytes().decode("utf-32-le"))
    for at in range(int(min(lengths.max(initial=0), TOGETHER))):
        rows = order[long_names : np.searchsorted(longer, -at)]
        h[rows] = _steps(h[rows], points[starts[rows] + at])
    return h


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, where each begins and how long it is."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(lengths) - lengths, lengths


@F.pandas_udf(LongType())
def _remembered_fnv1a(names: pd.Series) -> pd.Series:
    """:func:`fnv1a` of many names, each distinct one hashed once."""
    codes, distinct = pd.factorize(names)
    h = _hashes(*_points(list(distinct)), "").astype(np.int64)
    return pd.Series([int(h[c]) if c >= 0 else None for c in codes], dtype="Int64")


def _counts(texts: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, name (below ``n``) and count of each distinct pair."""
    pairs = np.sort(texts * n + names)
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)])
    return pairs[first] // n, pairs[first] % n, np.diff(np.r_[first, len(pairs)])


def _vectors(words: pa.ListArray, dim: int) -> np.ndarray:
    """One row per text: its features hashed, damped, signed and summed by bucket, at unit length."""
    size = len(words)
    text = np.repeat(np.arange(size), words.value_lengths().to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    # Words in order, so sums do not depend on the texts a text is embedded with.
    order = pc.sort_indices(coded.dictionary)
    distinct = coded.dictionary.take(order).to_pylist()
    code = np.argsort(order.to_numpy())[coded.indices.to_numpy(zero_copy_only=False)]
    points, starts, lengths = _points([f"<{w}>" for w in distinct])
    common = np.array([w in COMMON_WORDS for w in distinct], bool)
    # A trigram begins wherever neither of its first two characters ends a word; common words have none.
    ends = points == ord(">")
    begins = np.flatnonzero(~ends[:-2] & ~ends[1:-1] & ~np.repeat(common, lengths)[:-2])
    a, b, c = (points[begins + i].astype(np.int64) for i in range(3))
    grams, gram = np.unique(a << 42 | b << 21 | c, return_inverse=True)
    gram_hash = np.full(len(grams), _fnv1a_of("c:"), np.uint32)
    for shift in (42, 21, 0):
        gram_hash = _steps(gram_hash, (grams >> shift & 0x1FFFFF).astype(np.uint32))
    n_grams = np.where(common, 0, lengths - (NGRAM - 1))
    taken = n_grams[code]
    place = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
    spread = gram[np.repeat((np.cumsum(n_grams) - n_grams)[code], taken) + place]
    sums = np.zeros(size * dim)
    for at, names, h, weight in (
        (text, code, _hashes(points, starts + 1, lengths - 2, "w:"), np.where(common, COMMON_WEIGHT, WORD_WEIGHT)),
        (np.repeat(text, taken), spread, gram_hash, np.full(len(grams), NGRAM_WEIGHT)),
    ):
        at, name, n = _counts(at, names, max(len(weight), 1))
        total = weight[name] * n
        damped = np.where(total <= 1, total, 1 + np.log(total))
        signed = np.where(h[name] >= 2**31, -damped, damped)
        sums += np.bincount(at * dim + (h[name] % np.uint32(dim)).astype(np.int64), signed, size * dim)
    vectors = sums.reshape(size, dim)
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norm, out=vectors, where=norm > 0)


def _embedder(dim: int):
    @F.arrow_udf(ArrayType(DoubleType()))
    def embed(words: pa.Array) -> pa.Array:
        ends = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
        found, at = [np.zeros((0, dim))], 0
        while at < len(words):  # texts of about SLICE words at once, one at least
            before = ends[at - 1] if at else 0
            to = min(max(int(np.searchsorted(ends, before + SLICE, "right")), at + 1), at + TEXTS)
            found.append(_vectors(words.slice(at, to - at), dim))
            at = to
        values = np.concatenate(found).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, dim, np.int32)), pa.array(values))

    return embed


def hash_embed(texts: DataFrame, *keys: str, dim: int = DIM) -> DataFrame:
    """``keys, vector``: unit vectors of hashed features, all zero for text without words.

    A text's words stay one row. Its features are counted, damped and summed there, many texts at once, so no feature is ever a
    row. Texts with equal keys count as one; texts that come dealt out by their keys are not shuffled again.
    """
    whole = texts.groupBy(*keys).agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    return whole.select(*keys, _embedder(dim)(tokens(F.col("text"))).alias("vector"))


def unit(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""

    def scaled(x: Column) -> Column:
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e))
        return let(norm, lambda n: F.when(n > 0, F.transform(x, lambda e: e / n)).otherwise(x))

    return let(v, scaled)


def embed_articles(articles: DataFrame, embed=hash_embed) -> DataFrame:
    """Both languages embedded apart, each under its heading, then averaged to unit length."""
    parts = []
    for i, (text, _) in enumerate((("text_en", "en"), ("text_ar", "ar"))):
        heading = F.lit("")
        for source, names in HEADINGS.items():
            heading = F.when(F.col("source") == source, names[i]).otherwise(heading)
        body = F.concat(heading, F.col("article"), F.lit("\n"), F.col(text))
        part = F.struct(F.lit(text).alias("lang"), body.alias("text"))
        parts.append(F.when(F.col(text).isNotNull() & (F.col(text) != ""), part))
    vectors = embed(articles.select("id", F.inline(F.array_compact(F.array(*parts)))), "id", "lang")
    pair = vectors.groupBy("id").agg(F.collect_list("vector").alias("vs"))
    total = F.aggregate(
        "vs", F.lit(None).cast("array<double>"),
        lambda a, v: F.when(a.isNull(), v).otherwise(F.zip_with(a, v, lambda x, y: x + y)),
    )
    return pair.select("id", unit(total).alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def search(
    queries: DataFrame, corpus: DataFrame, k: int, query_blocks: int = QUERY_BLOCKS, corpus_blocks: int = CORPUS_BLOCKS
) -> DataFrame:
    """Exact top-k by cosine: ``query_id, rank, id, score``; only scores above 0.

    ``queries``: ``query_id, vector``; ``corpus``: ``id, corpus_order, vector``; unit vectors. Both
    sides are cut into blocks by a hash and meet block by block, so a task scores one block of
    queries against one of the corpus and keeps k rows per query; these are merged per query. The
    numbers of blocks are parameters: at n vectors a task holds n / blocks of them.
    """
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = queries.select(
        "query_id", F.col("vector").cast("array<double>").alias("vector"), block("query_id", query_blocks).alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(corpus_blocks - 1))).alias("cb"),
    )
    right = corpus.select(
        "id", "corpus_order", F.col("vector").cast("array<double>").alias("vector"), block("id", corpus_blocks).alias("cb"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"),
    )
    types = {f.name: f.dataType.simpleString() for f in (*left.schema, *right.schema)}
    schema = f"query_id {types['query_id']}, id {types['id']}, corpus_order {types['corpus_order']}, score double"

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": [], "id": [], "corpus_order": [], "score": []})
        held = held.sort_values(["corpus_order", "id"], kind="stable", ignore_index=True)
        asks, holds = np.stack(asked["vector"].to_numpy()), np.stack(held["vector"].to_numpy())
        step = max(1, SCORES // len(holds))
        parts = []
        # A slice of the queries at a time, so the scores held at once are bounded whatever the blocks hold.
        for start in range(0, len(asks), step):
            scores = asks[start : start + step] @ holds.T
            scores[np.isnan(scores)] = -np.inf
            if scores.shape[1] > k:
                least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                row, column = np.nonzero((scores >= least[:, None]) & (scores > 0))
            else:
                row, column = np.nonzero(scores > 0)
            order = np.lexsort((column, -scores[row, column], row))
            row, column = row[order], column[order]
            # Of each query the first k; columns are in corpus order, which decides ties.
            first = np.searchsorted(row, row, side="left")
            keep = np.arange(len(row)) - first < k
            row, column = row[keep], column[keep]
            parts.append(pd.DataFrame({
                "query_id": asked["query_id"].to_numpy()[start + row], "id": held["id"].to_numpy()[column],
                "corpus_order": held["corpus_order"].to_numpy()[column], "score": scores[row, column],
            }))
        return pd.concat(parts, ignore_index=True)

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(best, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "corpus_order", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def matches_ref(a: str = "a", r: str = "r") -> Column:
    """Source and article equal; the paragraph absent on a side, or a prefix up to a digit."""
    paragraph, wanted = F.col(f"{a}.paragraph"), F.col(f"{r}.paragraph")
    rest = F.substring(paragraph, F.length(wanted) + 1, F.length(paragraph))
    prefix = paragraph.startswith(wanted) & ~rest.rlike(r"^\d")
    return (
        (F.col(f"{a}.source") == F.col(f"{r}.source"))
        & (F.col(f"{a}.article") == F.col(f"{r}.article"))
        & (wanted.isNull() | paragraph.isNull() | prefix)
    )


def by_refs(articles: DataFrame, refs: DataFrame) -> DataFrame:
    """Articles any reference names, each once. References are made distinct first."""
    wanted = refs.select("source", "article", "paragraph").distinct()
    return articles.alias("a").join(wanted.alias("r"), matches_ref(), "left_semi")


def numeric_key(text: Column) -> Column:
    """Sorts digit runs by value: ``9 < 79 bis < 80``."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 12, "0")).otherwise(x)), ""
    )


def corpus_order() -> list[Column]:
    order = F.lit(len(SOURCE_ORDER))
    for source, n in SOURCE_ORDER.items():
        order = F.when(F.col("source") == source, n).otherwise(order)
    return [order, numeric_key(F.col("article")), numeric_key(F.col("paragraph"))]


def citation() -> Column:
    article, paragraph = F.col("article"), F.col("paragraph")
    law = F.concat(
        F.lit("Art. "), article,
        F.when(paragraph != "", F.concat(F.lit("("), paragraph, F.lit(")"))).otherwise(""),
    )
    return (
        F.when(F.col("source") == "labor_law", F.when(paragraph.isNull(), F.concat(F.lit("Art. "), article)).otherwise(law))
        .when(F.col("source") == "implementing_regulations", F.concat(F.lit("Exec. Reg. Art. "), article))
        .when(F.col("source") == "qiwa_template", F.concat(F.lit("Contract cl. "), article))
    )


class Joined:
    """Texts joined by line feeds, one that is already contained left out: ``contains`` without reading all that is held.

    Windows of WINDOW bytes whose hash has SAMPLED zero bits are anchors; they depend on their bytes alone, so a text that is
    held has each of its anchors there. Anchors and places are kept in sorted runs that are merged as they grow. A text
    with an anchor that is nowhere is new; otherwise the places of its rarest one are compared. Texts without an anchor, or
    with common ones only, are searched for.
    """

    WINDOW, SAMPLED, COMMON = 32, 5, 256
    FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

    def __init__(self):
        self.held: bytearray | None = None
        self.seen: set[bytes] = set()
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def anchors(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the anchors of some bytes."""
        n = len(data) - self.WINDOW + 1
        if n < 1:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        mixed = sum(eights[8 * k : 8 * k + n] * f for k, f in enumerate(self.FACTORS))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * self.FACTORS[1]
        places = np.flatnonzero(mixed >> np.uint64(64 - self.SAMPLED) == 0)
        return mixed[places], places

    def add(self, text: bytes | None) -> None:
        if text is None:
            return
        if self.held is None:
            self.held = bytearray(text)
            start = 0
        else:
            digest = hashlib.blake2b(text, digest_size=16).digest()
            if digest in self.seen:
                return
            self.seen.add(digest)
            if self.contains(text):
                return
            start = max(0, len(self.held) - self.WINDOW + 1)
            self.held += b"\n"
            self.held += text
        found, places = self.anchors(bytes(memoryview(self.held)[start:]))
        if len(found):
            self._keep(found, places + start)

    def _keep(self, found: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(found, kind="stable")
        run = found[order], places[order]
        while self.runs and len(self.runs[-1][0]) < 2 * len(run[0]):
            last = self.runs.pop()
            found, places = np.concatenate([last[0], run[0]]), np.concatenate([last[1], run[1]])
            order = np.argsort(found, kind="stable")
            run = found[order], places[order]
        self.runs.append(run)

    def contains(self, text: bytes) -> bool:
        found, places = self.anchors(text)
        if not len(found):
            return text in self.held
        bounds = [(np.searchsorted(run, found, "left"), np.searchsorted(run, found, "right")) for run, _ in self.runs]
        counts = sum((high - low for low, high in bounds), np.zeros(len(found), np.int64))
        rarest = int(counts.argmin())
        if counts[rarest] > self.COMMON:
            return text in self.held
        for (_, at), (low, high) in zip(self.runs, bounds):
            for place in (at[low[rarest] : high[rarest]] - places[rarest]).tolist():
                if place >= 0 and self.held.startswith(text, place):
                    return True
        return False

    def text(self) -> bytes | None:
        return None if self.held is None else bytes(self.held)


def merge_by_citation(articles: DataFrame, *order: Column) -> DataFrame:
    """One text per law version and citation: chunks in corpus order, a chunk already contained left out.

    Chunks are dealt out by citation and sorted there; a task reads them as a stream and holds the texts of one citation,
    which are one row in the end. A citation costs the length of its chunks, however many it has.
    """
    names = ("text_ar", "text_en")
    keys = list(order) or corpus_order()
    cols = [c.alias(f"k{i}") for i, c in enumerate(keys)]
    spark = articles.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    by = ("law_version", "citation")
    chunks = articles.select("law_version", citation().alias("citation"), *cols, *names).repartition(n, *by)
    chunks = chunks.sortWithinPartitions(*by, *[f"k{i}" for i in range(len(cols))], *names).select(*by, *names)
    schema = StructType([StructField(f.name, f.dataType) for f in chunks.schema.fields])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, texts, arrow = None, [], None

        def row() -> pa.RecordBatch:
            values = [*[pa.array([v], t.type) for v, t in zip(key, arrow)], *[pa.array([t.text()], pa.binary()).cast(a.type) for t, a in zip(texts, arrow[2:])]]
            return pa.RecordBatch.from_arrays(values, names=[*by, *names])

        for batch in batches:
            arrow = [batch.schema.field(i) for i in range(batch.num_columns)]
            columns = [*[batch.column(i).to_pylist() for i in (0, 1)], *[batch.column(i).cast(pa.binary()) for i in (2, 3)]]
            for i, of in enumerate(zip(columns[0], columns[1])):
                if of != key:
                    if key is not None:
                        yield row()
                    key, texts = of, [Joined(), Joined()]
                for held, column in zip(texts, columns[2:]):
                    held.add(column[i].as_py())
        if key is not None:
            yield row()

    return chunks.mapInArrow(merged, schema)


def row_id() -> Column:
    parts = F.concat_ws("_", "law_version", "source", "article", F.when(F.col("paragraph") != "", F.col("paragraph")))
    return F.concat(F.lit("law_"), F.regexp_replace(parts, r"\s+", "-"))


def of_version(stored: DataFrame, version: str, bundled: DataFrame) -> DataFrame:
    """Stored rows of the version, or the bundled corpus when it has none.

    Whether any row exists is one bounded look (``limit 1``) at the stored table.
    """
    rows = stored.where(F.col("law_version") == version)
    return rows if rows.take(1) else bundled


def allowed_citations(rule_articles: list[str], citations: DataFrame) -> DataFrame:
    spark = citations.sparkSession
    own = spark.createDataFrame([(a,) for a in rule_articles], "citation string")
    return own.unionByName(citations.select("citation")).distinct()
