"""Phrases, BPE and spelling variants against plain versions and the tokenizers library."""

import hashlib
import json
import pickle
import random
import re
import string
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sorrel.llm import bpe, collocations, spelling

SF = "/root/testdata/sf0.001"


def clashing(spark, rows, names):
    """rows of (doc_id, text, lang) as documents that also have columns of the given names, filled with the row's number."""
    schema = "doc_id long, text string, lang string, source string" + "".join(f", {n} long" for n in names)
    return spark.createDataFrame([(*r, "s", *[k] * len(names)) for k, r in enumerate(rows)], schema).repartition(3)


# --- phrases


def plain_phrases(rows, least, share, longest=4):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for k in range(len(words) - m + 1):
                    f[lang, tuple(words[k : k + m])] += 1
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, ws), a in candidates.items():
        for m in range(2, len(ws)):
            for k in range(len(ws) - m + 1):
                inner = (lang, ws[k : k + m])
                covered[inner] = max(covered[inner], a)
    out = set()
    for (lang, ws), a in candidates.items():
        if 100 * covered[lang, ws] < share * a or (lang, ws) not in covered:
            score, _, left, right = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
            out.add((lang, " ".join(ws), a, left, right, score))
    return out, {lang: k for lang, k in n.items() if k}


def phrase_rows(seed=3):
    draw = random.Random(seed)
    words = ["the", "The", "cat", "sat", "on", "mat", "é", "x y", "a\tb", "日本", "dog,", "end.", "now!\n", " w"]
    rows = [(k, " ".join(draw.choices(words, [9, 2, 5, 5, 5, 4, 2, 1, 1, 1, 2, 2, 1, 1], k=draw.randrange(0, 60))), draw.choice(["a", "a", "b", None])) for k in range(120)]
    return rows + [(1, None, "a"), (2, "", None), (2, "only one", "c"), (None, "the cat sat on the mat " * 400, "a"), (5, "the cat sat on the mat", "und"), (7, "w" * 50_000 + " v", "a")] + [(9, "same row here", "b")] * 5


@pytest.mark.parametrize("common", [1_000_000, 20, 0])
def test_phrases_equal_plain_counts(spark, common):
    rows = phrase_rows()
    phrases, totals = collocations.mine(clashing(spark, rows, ["word", "id", "n", "score"]), least=4, common=common)
    wanted, n = plain_phrases(rows, 4, 80)
    got = phrases.collect()
    assert {tuple(r[c] for c in ("lang", "phrase", "a", "l", "r", "score")) for r in got} == wanted and len(got) == len(wanted) > 50
    assert {r.lang: r.n for r in totals.collect() if r.n} == n


def test_phrase_chunks_and_blocks_change_nothing(spark, monkeypatch):
    rows = phrase_rows(8)
    for name, small in (("CHUNK", 50), ("MEMO", 5), ("COUNTED", 20)):
        monkeypatch.setattr(collocations, name, small)
    got = {tuple(r[c] for c in ("lang", "phrase", "a", "l", "r", "score")) for r in collocations.mine(clashing(spark, rows, []), least=4, common=30)[0].collect()}
    assert got == plain_phrases(rows, 4, 80)[0]


def known_words(rows):
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return collocations.Words(pa.table({n: pa.array(c, t) for n, c, t in zip(("id", "lang", "word"), columns, (pa.int64(), pa.string(), pa.binary()), strict=True)}))


def test_phrase_chunks_are_packed_and_sent_without_the_package(spark):
    docs = spark.createDataFrame([("en", "one two three. " * 2000)], "lang string, text string")
    words = spark.createDataFrame([(k, "en", w, 2000) for k, w in enumerate(("one", "two", "three"), 1)], "id long, lang string, phrase string, f long")
    (row,) = collocations.word_sequences(docs, words, 100).collect()
    assert len(row.ids) < 8000 and collocations.unpacked(row.ids).tolist() == [1, 2, 3, 0] * 2000
    assert collocations.unpacked(collocations.packed(np.zeros(0, np.int64))).tolist() == []
    assert b"sorrel" not in pickle.dumps(known_words([(1, "en", b"one")]).parts())


def test_phrases_by_filters_of_any_size(spark, monkeypatch):
    rows = phrase_rows(6)
    for words in (1 << 10, 64):
        monkeypatch.setattr(collocations, "FILTER_WORDS", words)
        monkeypatch.setattr(collocations, "NAMES_A_WORD", 1 if words > 64 else 1000)
        got = {tuple(r[c] for c in ("lang", "phrase", "a", "l", "r", "score")) for r in collocations.mine(clashing(spark, rows, []), least=4, common=0)[0].collect()}
        assert got == plain_phrases(rows, 4, 80)[0]
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    place, bits = collocations.filter_bits(hashes[:1000], 512)
    table = np.zeros(512, np.uint64)
    np.bitwise_or.at(table, place, bits)
    assert [collocations.word_may_be_there(table, int(h)) for h in hashes] == collocations.may_hold(table, hashes).tolist()
    assert collocations.may_hold(table, hashes[:1000]).all() and collocations.may_hold(table, hashes[1000:]).mean() < 0.05
    words = known_words([(7, "x", b"a"), (8, "y", b"a"), (9, "x", b"ab")])
    names = collocations.Names(words, "x", table)
    names.asked = {}
    assert names[b"a"] == 7 and names[b"ab"] == 9 and names[b"b"] <= 0 and collocations.Names(words, "y", None)[b"a"] == 8 and collocations.Names(known_words([]), "x", None)[b"b"] == 0
    assert all(names[f"w{k}".encode()] <= 0 for k in range(100)) and len(names) > 80
    monkeypatch.setattr(collocations, "word_hash", lambda lang, word: len(word))
    alike = known_words([(k, "x", f"{k:03}".encode()) for k in range(1, 50)])
    assert [collocations.Names(alike, "x", None)[f"{k:03}".encode()] for k in range(60)] == [0, *range(1, 50), *[0] * 10]


def test_phrase_table_ranks_ties_and_empties(spark):
    rows = [(k, "b a. a b. c a. a c. B a", lang) for lang in ("x", None) for k in range(15)] + [(1, None, "y")]
    got = collocations.collocation_table(clashing(spark, rows, ["rank", "phrase", "part"])).collect()
    by = defaultdict(list)
    for r in got:
        by[r.lang].append((r["rank"], r.phrase, r.a, r.l, r.r, r.n))
    assert sorted(by) == ["und", "x"] and by["x"] == by["und"] == [(1, "b a", 30, 45, 75, 150)]
    assert collocations.collocation_table(clashing(spark, rows, []).limit(0)).collect() == []
    ranked = collocations.best_of_each(spark.createDataFrame([("x", f"{k:03}", 40, 50, 60, 7 + k // 50) for k in range(100)], "lang string, phrase string, a long, l long, r long, score long"), 60).collect()
    assert [r.phrase for r in sorted(ranked, key=lambda r: r["rank"])] == [f"{k:03}" for k in [*range(50, 100), *range(10)]]


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 4 * 10**18, 5 * 10**18, 7 * 10**18
    rows = spark.createDataFrame([("x", "p q", a, [left, a], [right, a])], "lang string, phrase string, f long, heads array<long>, tails array<long>")
    assert collocations.scored(rows, 2).first().score == 2_000_000 * a // (left + right)
    up = spark.createDataFrame([(1, 9, 8 * 10**17 * 4)], "left long, right long, f long")
    ids = spark.createDataFrame([(1, a), (9, a + 10**17), (4, a)], "id long, f long")
    assert sorted(r.id for r in collocations.not_subsumed(ids, up, 80).collect()) == [4, 9]


def test_pairs_whose_hashes_are_equal_keep_their_names(spark, monkeypatch):
    monkeypatch.setattr(collocations, "pair_hash", lambda left, right: (left % 3).astype("uint64"))
    rows = phrase_rows(5)
    for common in (1_000_000, 25):
        got = {tuple(r[c] for c in ("lang", "phrase", "a", "l", "r", "score")) for r in collocations.mine(clashing(spark, rows, []), least=4, common=common)[0].collect()}
        assert got == plain_phrases(rows, 4, 80)[0]


# --- BPE


@pytest.fixture(scope="module")
def word_bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path), bpe.Encoder(open(path).read()), path


TEXTS = st.one_of(
    st.text(max_size=80),
    st.text("abcdefgh'sTÉéßΣσςİ 19!?", max_size=60),
    st.sampled_from(["a<|endoftext|> b", "<|startoftext|>", "it's  \n\n x", "՘a࢏", "가나 다1२ 각", "̧́a", "ΑΣ ΑΣ", "x\x1cy\x85z", "日本語 😀🏳️‍🌈", "a" * 500, "ab" * 300 + "!" * 90]),
)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_ids_equal_the_library(word_bpe, texts):
    library, encoder, _ = word_bpe
    assert [encoder.ids(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_forced_boundaries(word_bpe):
    _, encoder, path = word_bpe
    model = json.load(open(path))["model"]
    assert encoder.fragments(b"a") == [b"a"] and b"".join(encoder.fragments(b"qjxzvkq")) == b"qjxzvkq" and len(encoder.fragments(b"qjxzvkq")) > 1
    tokens = [t.removesuffix("</w>") for t in model["vocab"] if t not in encoder.special]
    for raw in (b"qjxzvkq", b"hello", "straßenbahn".encode()):
        word = "".join(encoder.letters[x] for x in raw)
        cuts, at = set(), 0
        for f in encoder.fragments(raw)[:-1]:
            cuts.add(at := at + len(f))
        inside = {k for k in range(1, len(word)) if any(word[k - 1 : k + 1] in t for t in tokens if len(t) > 1)}
        assert set(range(1, len(word))) - inside <= cuts
    draw, ranks = random.Random(2), {tuple(m): k for k, m in enumerate(model["merges"])}
    for _ in range(300):
        word = "".join(draw.choices("aehinrst", k=draw.randrange(2, 60)))
        plain = [*word[:-1], word[-1] + "</w>"]
        while pairs := [(ranks[p], k) for k, p in enumerate(zip(plain, plain[1:], strict=False)) if p in ranks]:
            _, k = min(pairs)
            plain[k : k + 2] = [plain[k] + plain[k + 1]]
        ids = [model["vocab"][s] for s in plain]
        letters = [*[encoder.starts[x] for x in word[:-1].encode()], encoder.ends[ord(word[-1])]]
        assert encoder.merged_by_heap(letters) == ids and list(encoder.merged(word.encode(), True)) == ids == list(encoder.raw_ids(word.encode()))


def test_a_worker_forgets_and_goes_on(word_bpe, monkeypatch):
    library, _, path = word_bpe
    monkeypatch.setattr(bpe, "MEMO", 3)
    monkeypatch.setattr(bpe, "MEMO_CHARS", 4)
    text, small = "The quick brown fox; qjxzvkq jumped 12 times over éé the lazy dog " * 3, bpe.Encoder(open(path).read())
    assert small.ids(text) == library.encode(text, add_special_tokens=False).ids and len(small.memo) <= 3 and len(small.fragments_seen) <= 3


def digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_encoded_table(spark, word_bpe):
    library, _, path = word_bpe
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: tuple(r)[1:] for r in bpe.encoded_table(docs).collect()} == {i: digest(library, t) for i, t in texts.items()}
    rows = [(1, None, "x"), (2, "", "x"), (3, "É <|endoftext|>", "x"), (3, "É <|endoftext|>", "x"), (None, "a b", None), (4, "z" * 90_000 + " word" * 9_000, "x"), (5, " \n", "x")]
    got = bpe.encoded_table(clashing(spark, rows, ["ids", "bpe_row", "bpe_text", "n_tokens"])).collect()
    assert Counter((r.doc_id, *tuple(r)[1:]) for r in got) == Counter((i, *digest(library, t)) for i, t, _ in rows)
    assert bpe.encoded_table(clashing(spark, rows, []).limit(0)).collect() == []
    kept = bpe.encode(clashing(spark, rows, ["ids", "bpe_row"]), path, "tokens")
    assert kept.columns == ["doc_id", "lang", "source", "ids", "bpe_row", "tokens"] and len(kept.collect()) == len(rows)
    lists = spark.createDataFrame([(1, [320, 49407, 321]), (2, []), (3, None), (4, [-1, 320, 99_999_999])], "i int, ids array<int>")
    assert [r.t for r in lists.select("i", bpe.decode(lists.ids, path).alias("t")).sort("i").collect()] == ["a</w> <|endoftext|> b</w>", "", "", "a</w>"]
    with pytest.raises(ValueError):
        import public_tokenizers

        bpe.encoded_table(docs, public_tokenizers.path("byte_bpe_50k.json"))


# --- spelling variants


def plain_words(rows, damage=31):
    counts = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, damage=31):
    words = plain_words(rows, damage)
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    near = {w: [v for m in (len(w) - 1, len(w), len(w) + 1) for v in by_length[m] if v != w and apart_by_one(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def variant_rows(seed=1):
    draw = random.Random(seed)
    base = ["committee", "aaaaaaaa", "receive", "Bookkeeper", "naïveté", "mississippi", "garçonnes", "abababab"]
    rows = []
    for k in range(400):
        words = []
        for w in draw.choices(base, [200, 60, 20, 6, 3, 3, 2, 1], k=draw.randrange(0, 12)):
            kind = draw.random()
            at = draw.randrange(len(w))
            if kind < 0.15:
                w = w[:at] + draw.choice("abcéms") + w[at + (kind < 0.08) :]
            elif kind < 0.22:
                w = w[:at] + w[at + 1 :]
            words.append(w if draw.random() < 0.9 else w.upper())
        rows.append((k, draw.choice([" ", "-", "1", "\n"]).join(words), None))
    return rows + [(1, None, "a"), (2, "", "a"), (None, "committee committez", "a"), (3, "ÿÿÿÿÿÿÿ × ÀÀÀÀÀÀÀ Āabcdefgh", None)] + [(4, "repeated repeaten", None)] * 30


def as_rows(df):
    return Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_variants_equal_pairwise_comparison(spark):
    rows = variant_rows()
    wanted = plain_variants(rows)
    assert as_rows(spelling.variant_table(clashing(spark, rows, ["word", "id", "n", "key"]))) == Counter(wanted) and any(f for _, f, *_ in wanted)
    assert spelling.variant_table(clashing(spark, rows, []).limit(0)).collect() == []


@pytest.mark.parametrize("long", [0, 8, 9])
def test_variants_by_fingerprints(spark, long):
    rows = variant_rows(4)
    assert as_rows(spelling.variants(clashing(spark, rows, []), long=long)) == Counter(plain_variants(rows))


def test_variants_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, None) for r in docs.collect()]
    assert as_rows(spelling.variant_table(docs)) == Counter(plain_variants(rows))


def test_chains_of_forms_lead_to_their_root(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    pairs = spark.createDataFrame([(k, k + 1) for k in range(200)], "id long, form_id long")
    assert {r.root for r in spelling.roots(pairs).collect()} == {200}
    rows = [(None, f"{w} " * 2 * 10**k, None) for k, w in enumerate(chain[:4])]
    got = {r.word: (r.form, r.root) for r in spelling.variants(clashing(spark, rows, []), damage=1 << 40).collect()}
    assert got == {w: (chain[k + 1] if k < 3 else None, chain[3]) for k, w in enumerate(chain[:4])}


def test_very_long_words(spark):
    draw = random.Random(9)
    body = "".join(draw.choices("abc", k=30_000))
    changed = [body, body[:777] + "d" + body[778:], body[:15_000] + body[15_001:], body + "z", "q" * 40_000, "q" * 40_001]
    rows = [(None, " ".join([w] * (2 if k else 30)), None) for k, w in enumerate(changed)]
    got = {r.word: (r.form, r.n_near) for r in spelling.variants(clashing(spark, rows, []), damage=1 << 40).collect()}
    assert got == {body: (None, 3), changed[1]: (body, 1), changed[2]: (body, 1), changed[3]: (body, 1), changed[4]: (None, 1), changed[5]: (None, 1)}
    assert spelling.fingerprints("abc", [-1])[0] == spelling.fingerprints("xabc", [0])[0] == spelling.fingerprints("abcc", [2])[0] != spelling.fingerprints("abd", [-1])[0]
