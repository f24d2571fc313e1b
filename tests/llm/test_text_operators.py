"""Operators 2, 3, 4, 7, 9, 10 and the pipeline against plain Python on odd cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pactum.llm import line_dedup, minhash, packing, secret_scan, tokens, toxicity, warc
from pactum.llm.shared import shared_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_are_the_library_s_ids(spark, odd_docs, no_docs, words):
    strange = [
        "It's THE café—naïve  résumé ok x", "a\tb\r\nc\x0bd\x1ce\x85f", "ÀÉÎõü ßẞ İI ſ K", "é ＡＢＣ ﬁ 한국어 中文字 𝔘𝔫 😀👍🏽", "don't we'll I'm 'd", "<|endoftext|> <|startoftext|>x",
        "12,345.67% a-b_c/d ...!!! ?!", "ª º µ x² ½", " lead", "trail ", "  ", "\n\n", "a.b. a, b; c: d! e?",
    ]
    docs = odd_docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(500 + k, t) for k, t in enumerate(strange)], "doc_id long, text string")
    )
    encoder = Tokenizer.from_file(VOCABULARY)
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*encoder.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want[r.doc_id, k // 4096, k, len(own), zlib.crc32(own.tobytes())] += 1
    packed = packing.pack_documents(docs, VOCABULARY).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by_sequence = collections.defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(no_docs, VOCABULARY).count() == 0
    whole = packing.sequences(packing.pack(tokens.pieces(docs, VOCABULARY, with_ids=True))).collect()
    assert sorted(len(r.ids) for r in whole) == sorted(sum(n for _, n in p) for p in by_sequence.values())


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 400, 3000)
    sequence, offset = packing.best_fit(lengths, 1000, 6, 260_000, rule=rule)
    for k in np.unique(sequence):
        own = lengths[sequence == k]
        assert len(own) == 1 or (own.sum() <= 1000 and len(own) <= 6 and (own * own).sum() <= 260_000)
        assert sorted(offset[sequence == k]) == [0, *np.cumsum(own[np.argsort(offset[sequence == k])])[:-1]]
    sequence, _ = packing.best_fit(lengths, 1000, 1000, 1000**2)
    assert len(np.unique(sequence)) <= -(-int(lengths.sum()) // 1000) + 1


def test_packing_looks_beyond_partitions(spark, monkeypatch):
    clustered = spark.createDataFrame([(k, 2500 if k < 200 else 1500) for k in range(400)], "doc_id long, length long")
    parts = clustered.repartitionByRange(8, "doc_id")
    assert packing.pack(parts).select("sequence_id").distinct().count() == 200
    many = spark.range(64, numPartitions=64).selectExpr("id AS doc_id", "60L AS length")
    assert packing.pack(many).select("sequence_id").distinct().count() == 1
    monkeypatch.setattr(packing, "WINDOW", 20)
    packed = packing.pack(parts).groupBy("sequence_id").agg({"length": "sum", "doc_id": "count"}).collect()
    assert sum(r["count(doc_id)"] for r in packed) == 400 and max(r["sum(length)"] for r in packed) <= 4096
    assert len(packed) <= 215


def test_toxicity(spark, odd_docs, no_docs, labels, words):
    rng = random.Random(4)
    rows, marks = [], []
    for k in range(600):
        text = words(k, rng.randint(20, 120)).split()
        toxic = k % 5 in (1, 2)
        if toxic:
            for _ in range(4):
                insult = rng.choice(["idiot", "scum", "zork" + "".join(rng.choices("abcde", k=3))])
                text.insert(rng.randrange(len(text)), insult)
        rows.append((k, " ".join(text), "x"))
        marks.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    marked = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs, marked).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0}
    wrong = sum(r.predicted != (r.doc_id % 5 in (1, 2)) for r in held)
    assert wrong <= 0.05 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = toxicity.without_toxic(docs, marked)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    odd = toxicity.judge(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(r.score is not None for r in odd)
    plain = {r.doc_id: r.score for r in toxicity.judge(odd_docs, labels.limit(0)).collect()}
    assert plain[12] == 1 and plain[1] == 0 and plain[5] == 0
    assert toxicity.judge(no_docs, labels).count() == 0


def test_warc_round_trip(spark):
    big, small = "<html>é😀" + "x" * 200, "tiny"
    rows = [(5, "http://a/b c\n", big), (3, "http://a", big), (9, None, big), (1, "u", small), (2, "u", small), (7, "u", None), (None, "n", big), (3, "http://a", big)]
    rows += [(100 + k, f"http://x/{k}", f"page {k} " * 50) for k in range(30)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = collections.Counter(map(tuple, warc.round_trip(spark, pages).collect()))
    want = collections.Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and page != 3
        want[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None] += 1
    assert got == want
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_finds_damage(spark):
    pages = spark.createDataFrame([(k, "u", f"text {k} " * 30) for k in range(5)], "page_id long, url string, html string").coalesce(1)
    folder = shared_path(spark, "warc")
    manifest = warc.write(pages, folder, file_bytes=1)
    assert manifest.count() == 5
    for k, r in enumerate(sorted(manifest.collect())):
        data = open(r.path, "rb").read()
        if k == 0:
            open(r.path, "wb").write(data[:-20])
        if k == 1:
            open(r.path, "wb").write(b"not gzip" + data)
    records = warc.read(manifest, folder).collect()
    assert sum(r.problem is None for r in records) == 3 and sum(r.problem is not None for r in records) == 2
    data = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None, False)
    member = next(warc.members(iter([data[:7], data[7:]])))
    assert warc.parsed(member)["payload"] == b"abc"
    with pytest.raises(warc.BadRecord):
        warc.parsed(member.replace(b"abc", b"abd"))
    with pytest.raises(warc.BadRecord):
        warc.parsed(member + b"x")


def test_line_dedup(spark, odd_docs, no_docs, words):
    passage = [words(700 + k, 20) for k in range(4)]
    short = words(800, 8)
    other = [words(900 + k, 35) for k in range(2)]
    own = lambda k: words(k, 25)
    texts = {
        1: [own(1), *passage, own(2), *other], 2: [own(3), *other, own(4), *passage, own(5)], 3: [short, own(6), passage[0], own(7)],
        4: [short, own(8)], 5: [*passage], 6: [own(9), passage[0], "", passage[1], passage[2] + " changed", short], 7: [other[0], own(10), other[0], other[1]],
    }
    docs = spark.createDataFrame([(k, "\n".join(v), "z") for k, v in texts.items()], "doc_id long, text string, cut string")
    cleaned = {r.doc_id: r.text for r in line_dedup.clean(docs).collect()}
    assert cleaned[1] == "\n".join(texts[1])
    assert cleaned[2].split("\n") == [own(3), own(4), own(5)]
    assert cleaned[3] == "\n".join(texts[3]) and cleaned[4] == "\n".join(texts[4])
    assert cleaned[5] == ""
    assert cleaned[6].split("\n") == [own(9), "", passage[2] + " changed", short]
    assert cleaned[7] == own(10)
    left = line_dedup.without_repeats(docs)
    assert left.schema == docs.schema and 5 not in {r.doc_id for r in left.collect()}
    odd = line_dedup.clean(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    by_id = {r.doc_id: r.text for r in odd if r.doc_id is not None}
    assert by_id[2] == "" and by_id[4] is None and by_id[8] == "one two" and len(by_id[3].split("\n")) == 1
    assert {r.text for r in odd if r.doc_id is None} == {None, odd_docs.filter("doc_id = 1").first().text}
    assert line_dedup.report(no_docs).count() == 0


def test_alignment_is_a_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = sorted(line_dedup.patience(a, b))
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert set(line_dedup.aligned(a, b)) <= {k for k, x in enumerate(b) if x in a}


def test_only_blocks_of_an_earlier_document_go(spark, words):
    x = [words(1200 + k, 12) for k in range(6)]
    own = lambda k: words(1300 + k, 12)
    texts = {
        1: [x[0], x[1], own(1), x[2], own(2), x[3]], 2: [own(3), x[4], x[5], own(4)], 3: [x[0], x[1], x[2], x[3]], 4: [x[3], x[1], x[2], x[0]],
        5: [x[3], x[4], x[5]], 10: [*x[:3], own(5)], 11: [*x[1:4], own(6), *x[:3], own(7), *x[:3]],
    }
    docs = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "doc_id long, text string")
    left = {r.doc_id: r.text.split("\n") if r.text else [] for r in line_dedup.clean(docs).collect()}
    assert all(left[k] == texts[k] for k in (1, 2, 3, 4, 5))
    assert left[10] == [own(5)] and left[11] == [own(6), own(7)]


def test_aligned_is_every_block_that_both_hold():
    rng = random.Random(12)
    for _ in range(400):
        size = [rng.randint(1, 20) for _ in range(5)]
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(25))] for _ in range(2))
        want = set()
        for i in range(len(b)):
            for n in range(i + 1, len(b) + 1):
                if sum(size[x] for x in b[i:n]) >= 30 and any(a[k : k + n - i] == b[i:n] for k in range(len(a))):
                    want.update(range(i, n))
        assert line_dedup.aligned(a, b, [size[x] for x in b]) == sorted(want)


def _components(docs, limit=75):
    sets = {}
    for r in docs:
        w = (r.text or "").encode().lower().split()
        if r.doc_id is not None:
            sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= limit * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {k: (len(sets[k]), find(k)) for k in ids}


def test_near_duplicates(spark, odd_docs, no_docs, words):
    rng = random.Random(6)
    rows, k = [], 1000
    for family in range(6):
        base = words(family + 50, 120).split()
        for copy in range(25):
            text = list(base)
            for _ in range(rng.randrange(0, 9)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
            rows.append((k, " ".join(text) if copy % 7 else " ".join(text).upper() + "\n"))
            k += 1
    rows += [(k + i, t) for i, t in enumerate(["a b", "a b", "A  B", "a b c d e", "a b c d e f", "x", ""])]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = _components(docs.collect())
    got = minhash.duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    left = minhash.without_duplicates(odd_docs)
    assert left.schema == odd_docs.schema and {1, 4, 5, 6, 7, None} <= {r.doc_id for r in left.collect()}
    assert not {2, 3} & {r.doc_id for r in left.collect()}
    assert minhash.duplicates(no_docs).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(8)
    for similarity in (0.2, 0.5, 0.75, 0.95):
        n = 2000
        common = int(2 * n * similarity / (1 + similarity))
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])
        one, two = minhash.registers(a), minhash.registers(b)
        assert (minhash.registers(np.concatenate([a, b])) == np.maximum(one, two)).all()
        got = minhash.estimate(one[None].astype(int), two[None].astype(int), np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(got - similarity) < 0.13


def test_secret_scan(spark, odd_docs, no_docs, words):
    rng = random.Random(9)
    rows = []
    for k in range(300):
        text = words(k, 60).split()
        hexa = "".join(rng.choices("0123456789abcdef", k=32))
        text.insert(30, {0: f'token = "{hexa}"', 1: f"commit {hexa}", 2: "AKIA" + "".join(rng.choices("ABCDEFGH234567", k=16)), 3: f"{rng.randrange(10**15, 10**16)}"}[k % 4])
        rows.append((k, " ".join(text), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = secret_scan.scan(docs).collect()
    assert len(got) >= 300
    held = [r for r in got if r.held_out and r.labelled is not None]
    assert held and sum(r.secret != r.labelled for r in held) <= 0.02 * len(held)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(hashlib.sha256(text[r.doc_id][r.at : r.at + r.length].encode()).hexdigest() == r.digest for r in got)
    assert {r.doc_id for r in got if r.secret} == {k for k in range(300) if k % 4 in (0, 2)}
    human = spark.createDataFrame([(r.doc_id, r.at, r.doc_id % 4 == 1) for r in got], "doc_id long, at long, secret boolean")
    learned = {r.doc_id for r in secret_scan.scan(docs, human).filter("secret").collect()}
    assert learned == {k for k in range(300) if k % 4 == 1}
    assert secret_scan.scan(odd_docs).filter("doc_id IN (4, 5, 6)").count() == 0
    assert secret_scan.scan(no_docs).count() == 0


def test_short_and_symbol_bearing_secrets_are_candidates(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4fw"
    texts = {
        'password = "hunter2"': ["hunter2"], "pwd: P@ss!w0rd": ["P@ss!w0rd"], 'secret = "correct-horse-battery"': ["correct-horse-battery"],
        "a password: x, then": ["x"], f"see {jwt} here": [jwt], "postgres://me:p.w$1@db/x": ["p.w$1"], "author: John": [],
        'token = "a b&c#d" and passwd=é!9;': ["a b&c#d", "é!9"],
    }
    for text, want in texts.items():
        assert [text[a:b] for a, b in secret_scan.runs(text)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secret_scan.scan(docs).collect()
    assert sorted(r.digest for r in got) == sorted(hashlib.sha256(x.encode()).hexdigest() for v in texts.values() for x in v)
    assert [r.secret for r in got if r.doc_id == 5] == [True]


def test_pipeline(spark, odd_docs, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, sf)
        assert name == "packing" or docs.columns == columns
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    assert {2, 12}.isdisjoint({r.doc_id for r in docs.collect()}) and docs.filter("piece > 0").count() > 0


def test_almost_copies_are_decided_in_their_blocks(spark, words):
    """Many near copies around the limit: buckets of many components, equal to all pairs; links stay below the members."""
    rng = random.Random(11)
    base = words(3, 80).split()
    texts = []
    for k in range(150):
        own = base[:]
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(40)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(minhash.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert len(set(root)) > 5
    assert {r.doc_id: r.component_id for r in minhash.duplicates(docs).collect()} == dict(enumerate(root))


def test_stages_keep_every_name_and_every_text(spark, words, labels):
    """Clashing and dotted names, null and repeated ids, an id with two texts and an empty table through every stage."""
    a, b = words(1, 90), words(2, 90)
    names = ["_score", "_features", "_fixed_density", "_cut", "a.b", "doc", "text_key", "gone_id", "cut", "component"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    rows = [(3, a), (5, a), (5, b), (None, a), (None, None), (6, ""), (7, words(3, 20)), (7, words(3, 20))]
    docs = spark.createDataFrame([(*r, "en", "s", 1, *range(len(names))) for r in rows], schema)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = {
                "toxicity": lambda d: toxicity.without_toxic(d, labels), "line_dedup": line_dedup.without_repeats,
                "near_dedup": minhash.without_duplicates, "mixing": corpus_pipeline.mixing.mix,
            }[name](table)
            assert out.columns == docs.columns
            assert out.count() >= 0
            if name == "near_dedup" and table is docs:
                left = {(r.doc_id, r.text) for r in out.collect()}
                assert (3, a) in left and (5, b) in left and (5, a) not in left
                assert all(r["a.b"] == 4 for r in map(lambda r: r.asDict(), out.collect()))


def test_rows_without_an_id_draw_apart(spark, words):
    docs = spark.createDataFrame([(None, words(k, 10), "s") for k in range(400)], "doc_id long, text string, source string")
    taken = corpus_pipeline.mixing.report(docs, total_share=0.75).agg({"taken": "sum"}).first()[0]
    assert abs(taken - 3000) < 400


def test_toxicity_sends_the_pipelines_texts_to_python_once(spark):
    rows = [(1, "you IDIOT, you m0r0n!!", "a"), (2, None, "b"), (3, "", "c"), (4, "fine words here", None), (4, "fine words here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = toxicity.without_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan  # rows stay where they are, no text comes back
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 4]
    lexicon = {"=fine": 2.0, "4word": 1.0}
    found = docs.select("doc_id", toxicity.text_features(lexicon)(toxicity.text_of()).alias("f")).select("doc_id", "f.*")
    assert sorted(found.collect()) == sorted(toxicity.with_features(docs, lexicon, "doc_id").collect())
