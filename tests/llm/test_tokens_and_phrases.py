"""Operators 11 to 13 against the libraries and plain Python."""

import collections
import hashlib
import random
import re
from array import array

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pactum.llm import alignment, phrases, sentence_pieces
from pactum.llm.chunks import byte_level_bytes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "<|endoftext|> <s></s>", "a\u2581b", "  x\t\ty  \n\n z ", "😀👍🏽 中文字 x", "", " ", "\n", "'s don't we'll  I'm ×. ÷, é.,é .a", "\x00a\x1c b\x85",
    " . , a", "ﬁ ²., ½.", "aaaaaaaaaaaaa aaaab", "▁▁▁", "word.\u00a0next,\u3000x", "ab" * 3000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture
def odd(spark, odd_docs):
    strange = spark.createDataFrame([(500 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    return odd_docs.unionByName(strange, allowMissingColumns=True)


def test_encoding_is_the_library_s(library):
    pieces, known = sentence_pieces.encoder_of(MODEL)
    rng = random.Random(1)
    everything = list(pieces.id)
    for _ in range(4000):
        text = "".join(rng.choice([rng.choice(everything), rng.choice(" \n\t▁aab  \u00a0é中😀"), rng.choice("ab ")]) for _ in range(rng.randint(0, 12)))
        assert array("I", known.of(pieces.chunks(text))).tolist() == library.encode(text), repr(text)
    for letters in ("a", "aab", " ", "in the", "0123", "{}()", ">=< ", "\\n/*"):
        text = "".join(rng.choice(letters) for _ in range(300))
        assert [k for c in pieces.chunks(text) for k in pieces.encode(c)] == library.encode(text)


def test_search_steps_back(library):
    """Some texts need a shorter piece than the longest: greedy longest matches alone would be wrong."""
    pieces, _ = sentence_pieces.encoder_of(MODEL)
    rng, stepped = random.Random(5), 0
    for _ in range(500):
        text = "".join(rng.choices("abcdeinorst", k=12))
        ids, at, greedy = pieces.encode(text), 0, []
        while at < len(text):
            greedy.append(next(pieces.id[text[at:to]] for to in range(len(text), at, -1) if text[at:to] in pieces.id))
            at += len(pieces.text[greedy[-1]])
        stepped += greedy != ids
    assert stepped > 50


def test_round_trip(spark, odd, library):
    got = collections.Counter(map(tuple, sentence_pieces.round_trip(odd, MODEL).collect()))
    want = collections.Counter()
    for r in odd.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        shas = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        want[(r.doc_id, len(ids), *shas)] += 1
    assert got == want
    encoded = sentence_pieces.encode(odd, MODEL)
    back = sentence_pieces.decode(encoded, MODEL)
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter(
        (r.doc_id, library.decode(library.encode(r.text or ""))) for r in odd.collect()
    )
    assert sentence_pieces.round_trip(odd.limit(0), MODEL).count() == 0


def _aligned(texts, library):
    coder = Tokenizer.from_file(BYTE_LEVEL)
    coder.encode_special_tokens = True
    stand_in = byte_level_bytes()

    def spans(tokens):
        ends = np.cumsum([len(t) for t in tokens]).tolist()
        return list(zip([0, *ends], ends))

    out, counts = [], collections.Counter()
    for text in texts:
        a, b = coder.encode(" " + (text or ""), add_special_tokens=False).ids, library.encode(text or "")
        in_a = [bytes(stand_in[c] for c in coder.id_to_token(k)) for k in a]
        in_b = [bytes([int(p[3:5], 16)]) if library.is_byte(k) else p.replace("\u2581", " ").encode() for k in b for p in [library.id_to_piece(k)]]
        if not text or not b"".join(in_a) == b"".join(in_b) == (" " + text).encode():
            out.append(None)
            continue
        at_a, at_b = spans(in_a), spans(in_b)
        groups, seen_a, seen_b = [], 0, 0
        for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            to_a, to_b = (sum(e <= end for _, e in x) for x in (at_a, at_b))
            groups.append(f"{','.join(map(str, a[seen_a:to_a]))}|{','.join(map(str, b[seen_b:to_b]))}")
            seen_a, seen_b = to_a, to_b
        links = [(a[i], b[j]) for i, (s, e) in enumerate(at_a) for j, (t, f) in enumerate(at_b) if s < f and t < e]
        counts.update(links)
        out.append((len(a), len(b), groups, links))
    return out, counts


@pytest.mark.parametrize("rows", [10**6, -1])
def test_alignment(spark, odd, library, monkeypatch, rows):
    monkeypatch.setattr(alignment, "PAIR_ROWS", rows)
    docs = odd.filter("text IS NULL OR length(text) < 20000")
    rows = docs.collect()
    found, counts = _aligned([r.text for r in rows], library)
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = collections.Counter()
    for r, one in zip(rows, found):
        if one is None:
            want[r.doc_id, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            a, b, groups, links = one
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
            n_best = sum(counts[x] == best[x[1]] for x in links)
            want[r.doc_id, a, b, len(groups), len(links), n_best, sum(counts[x] for x in links), sha] += 1
    assert collections.Counter(map(tuple, alignment.report(docs, BYTE_LEVEL, MODEL).collect())) == want
    assert alignment.report(docs.limit(0), BYTE_LEVEL, MODEL).count() == 0
    texts = {r.doc_id: r.groups for r in alignment.aligned(docs, BYTE_LEVEL, MODEL, groups=True).collect()}
    assert all(texts[r.doc_id] == ";".join(one[2] if one else []) for r, one in zip(rows, found) if r.doc_id and r.doc_id >= 500)


def _collocations(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", plain):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for k in range(len(words) - size + 1):
                    f[lang, *words[k : k + size]] += 1
    frequent = {key: a for key, a in f.items() if len(key) > 2 and a >= least}
    out = []
    for (lang, *words), a in frequent.items():
        if any(
            key[0] == lang and len(key) > len(words) + 1 and 100 * b >= 50 * a
            and any(list(key[k : k + len(words)]) == words for k in range(1, len(key) - len(words) + 1))
            for key, b in frequent.items()
        ):
            continue
        cuts = [(f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min((10**6 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
        out.append((lang, " ".join(words), a, l, r, n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, k, *o[1:]) for k, o in enumerate(own, 1)]
    return sorted(ranked)


@pytest.fixture(scope="module")
def worded():
    rng = random.Random(7)
    rows = []
    for k in range(120):
        words = [rng.choice(["new", "york", "city", "the", "of", "É", "ｗ", "x", "Y", "\x1cz"]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\x0b", "\n"]) for w in words)))
    rows += [(None, None), ("fr", ""), ("fr", " . ,"), ("en", "the new york city " * 500), ("en", "aa " * 40), (None, "Lone Words")]
    return rows


def test_collocations(spark, worded):
    docs = spark.createDataFrame([(lang, text, 1, 2) for lang, text in worded], "lang string, text string, n int, a int").repartition(5)
    got = sorted(map(tuple, phrases.collocations(docs, least=5, top=40).collect()))
    assert got == _collocations(worded, 5, 40)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_small_summaries_and_stretches_lose_nothing(spark, worded, monkeypatch):
    """Summaries that overflow, stretches of a few tokens and a crowded bit field still give exact counts."""
    monkeypatch.setattr(phrases, "STRETCH", 37)
    docs = spark.createDataFrame([(lang or "und", text or "") for lang, text in worded], "lang string, text string").repartition(3)
    got = phrases.frequent(docs, 10_000, least=5, capacity=10, filter_bits=12).collect()
    want = collections.Counter()
    for lang, text in worded:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            want.update((lang or "und", " ".join(words[k : k + s])) for s in (1, 2, 3) for k in range(len(words) - s + 1))
    assert {(r.lang, r.phrase): r.a for r in got} == {k: a for k, a in want.items() if a >= 5}


def test_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(2)
    keys = np.concatenate([rng.integers(0, 2**32, 20_000, np.uint32), np.repeat(np.arange(50, dtype=np.uint32), 60)])
    rng.shuffle(keys)
    least = 50
    summary = phrases.Summary(len(keys) * phrases.FACTOR // least + 1)
    for part in np.array_split(keys, 30):
        summary.merge(*[x if k == 0 else x.astype(np.int64) for k, x in enumerate(np.unique(part, return_counts=True))])
    kept = set(summary.survivors(least).tolist())
    assert set(range(50)) <= kept and len(kept) < 2000
    assert 0 < summary.subtracted * phrases.FACTOR < least
