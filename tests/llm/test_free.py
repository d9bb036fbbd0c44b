"""The other operators against brute force, round trips and held-out accuracy."""

import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sorrel.llm import decontamination, language_id, near_duplicates, quality_classifier, token_counts, url_filter, warc

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, node string, body string, rejected int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, "n", "b", 3) for i, t, lang in rows], DOCS).repartition(2)


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.language_table(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    odd = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "en"), (4, "the cat sat on the mat and it was good", "en"), (5, "le chat est sur la table et il fait beau", "fr"), (6, "the cat", None), (None, "le chat", "fr"), (7, "x" * 100_000, "en")]
    seen = {r.doc_id: r for r in language_id.language_table(table(spark, odd * 3)).collect()}
    assert all(seen[i].lang_pred == "und" and seen[i].score == 0 for i in (1, 2, 3)) and seen[4].lang_pred in ("en", "fr")
    assert all(0 <= r.score <= 1 for r in seen.values())
    assert language_id.language_table(table(spark, odd).limit(0)).collect() == []


def clashing(spark, rows, names):
    """rows of (doc_id, text) as documents that also have columns of the given names, filled with the row's number."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {n} long" for n in names)
    return spark.createDataFrame([(i, t, "x", "s", 1, *[k] * len(names)) for k, (i, t) in enumerate(rows)], schema).repartition(2)


def test_languages_settle_ties_and_read_whole_texts(spark):
    same = b"one and the same dictionary of some letters"
    assert language_id.Compressors({"b": same, "a": same}).classify("some letters")[0] == "a"
    body = "a" * 50_000 + " " + "b" * 50_000
    whole = language_id.train_dictionaries(spark.createDataFrame([(body, "x"), ("ccc", "x")], "text string, lang string"))
    assert sorted(whole["x"].decode().split(), key=len) == ["ccc", "a" * 50_000, "b" * 50_000]
    rows = [("aaa bbb ccc ddd", "x")] * 500 + [("eee fff ggg", "x"), ("zzz yyy", "y"), (None, "y"), ("www", None)]
    found = language_id.train_dictionaries(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(found["x"].decode().split()) == ["aaa", "bbb", "ccc", "ddd", "eee", "fff", "ggg"] and found["y"] == b"zzz yyy"
    odd = clashing(spark, [(1, "aaa bbb"), (1, "aaa bbb"), (2, None)], ["lang_text", "lang_pred", "held_out", "place", "nth"])
    assert Counter((r.doc_id, r.lang_pred) for r in language_id.language_table(odd).collect()) in (Counter({(1, "x"): 2, (2, "und"): 1}), Counter({(1, "und"): 2, (2, "und"): 1}))


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), open(public_tokenizers.path("byte_bpe_50k.json")).read()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.sampled_from(["a<|endoftext|> b", "<|endoftext|>", "it's  \n\n x", "  ", "\u0558a\u088f", "가나 다1२", "\r\n\t x", "\x85\u2028 y"])), max_size=6))
def test_tokens_equal_the_library(tokenizer, texts):
    library, definition = tokenizer
    counter, totals = token_counts.PieceCounter(definition), []
    for text in texts:
        tally, special = counter.frequencies(text)
        totals.append(special + sum(n * p for n, p in zip(tally.values(), counter.pieces(list(tally)), strict=True)))
    assert totals == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_table(spark):
    odd = [(1, None, "x"), (2, "", "x"), (3, "é", "x"), (4, "word " * 600, "x"), (None, "a", "x"), (3, "é", "x"), (5, "z" * 90_000, "x")]
    got = token_counts.token_table(table(spark, odd)).collect()
    by_id = {r.doc_id: tuple(r)[1:] for r in got}
    assert len(got) == len(odd) and by_id[1] == by_id[2] == (0, 0, False) and by_id[3][0] == 2 and by_id[4][2] is True and by_id[None] == (1, 1, False) and by_id[5][2]
    assert token_counts.token_table(table(spark, odd).limit(0)).collect() == []
    with pytest.raises(ValueError):
        import public_tokenizers

        token_counts.token_table(table(spark, []), public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("common", [1_000_000, 500, 0])
def test_tokens_by_broadcast_and_by_shuffle(spark, tokenizer, common):
    import public_tokenizers

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), [docs.doc_id], common=common).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(tokenizer[0].encode(t, add_special_tokens=False)) for i, t in texts.items()}


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.score_table(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert sum(r.predicted == r.quality for r in got) >= 0.93 * len(got)
    odd = table(spark, [(1, None, "x"), (2, "", "x"), (3, "a " * 50_000, "x"), (None, "b", "x")])
    scored = quality_classifier.score_table(odd, labels.limit(0)).collect()
    assert len(scored) == 4 and all(r.score == 0.5 and r.predicted == 0 for r in scored)


def test_quality_of_odd_tables(spark):
    texts = ["good words in a long and even line of text", "# # # | | $ $", "other fine words here", "% % % &"]
    rows = [(k, texts[k % 4]) for k in range(200)] + [(5, "again one of id five"), (5, "and another"), (None, None), (None, "x y")]
    docs = clashing(spark, rows, ["quality_label", "score", "quality_text", "quality"])
    labels = spark.createDataFrame([(k, 1 - k % 2, 9) for k in range(200)] + [(5, 0, 9), (None, 1, 9), (7, 5, 9), (999, 1, 9)], "doc_id long, quality int, quality_label int")
    first, again = (sorted(quality_classifier.score_table(d, labels).collect(), key=str) for d in (docs, docs.repartition(5)))
    assert first == again and len(first) == len(rows)
    by_id = {r.doc_id: r.score for r in first if r.doc_id is not None and r.doc_id != 5}
    assert min(by_id[k] for k in by_id if k % 2 == 0) > 0.8 > 0.2 > max(by_id[k] for k in by_id if k % 2)
    assert quality_classifier.score_table(docs.limit(0), labels).collect() == []


def test_statistics_against_plain_counts():
    text = "One two two. Three!\n\nthree # | é\nOne two two. Three!"
    got = dict(zip(quality_classifier.FEATURES, quality_classifier.statistics(text), strict=True))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    assert got["chars"] == pytest.approx(np.log1p(len(text))) and got["words"] == pytest.approx(np.log1p(len(words)))
    assert got["word_mean"] == pytest.approx(np.mean([len(w) for w in words])) and got["distinct_words"] == pytest.approx(len(set(words)) / len(words))
    assert got["repeated_lines"] == pytest.approx(1 - len(set(lines)) / len(lines)) and got["ended_lines"] == pytest.approx(2 / 3)
    assert got["symbols"] == pytest.approx(1 / len(words)) and got["bars"] == pytest.approx(1 / len(words)) and got["shouts"] == pytest.approx(2 / len(words))
    assert got["upper"] == pytest.approx(4 / len(text)) and got["non_ascii"] == pytest.approx(2 / len(text.encode())) and got["same_as_before"] == pytest.approx(0)
    assert quality_classifier.statistics(None) == quality_classifier.statistics("") == [0.0] * len(quality_classifier.FEATURES)


def test_first_split_is_the_best_one():
    draw = np.random.default_rng(3)
    x = draw.integers(0, 12, (300, 3)).astype(np.float32)
    y = (x[:, 1] + draw.normal(0, 2, 300) > 6).astype(float)
    model = quality_classifier.grow(x, y, trees=1, depth=1)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(f, t):
        low = x[:, f] <= t
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality_classifier.RIDGE)
        return part(low) + part(~low) - part(np.ones(len(y), bool))

    best = max(gain(f, t) for f in range(3) for t in range(11))
    assert gain(int(model.feature[0, 0]), model.threshold[0, 0]) == pytest.approx(best)


def test_trees_learn_and_flatten():
    draw = np.random.default_rng(1)
    x = draw.random((600, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_classifier.grow(x[:400], y[:400])
    assert ((model.probability(x[400:]) > 0.5) == y[400:]).mean() > 0.9

    def walk(row):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert model.probability(x[:20]) == pytest.approx([walk(r) for r in x[:20]])


def plain_contamination(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, met = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        m = min(10, len(w))
        wanted = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
        for k in range(len(words) - m + 1 if m else 0):
            if tuple(words[k : k + m]) in wanted:
                hit.update(range(k, k + m))
                met.add(str(item))
    return len(words), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most_bytes", [16 << 20, 150])
def test_decontamination(spark, most_bytes):
    draw = random.Random(2)
    say = lambda n: " ".join(draw.choice(["a", "B", "c", "é", "d-e"]) for _ in range(n))
    items = [(k, say(draw.randint(1, 25))) for k in range(12)] + [(20, None), (21, "!!"), (3, say(12)), (22, "é")]
    texts = [None, "", "!!", "é"] + [say(draw.randint(0, 60)) for _ in range(40)] + [say(5) + " " + items[k][1] + " " + say(4) for k in range(12)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    from pyspark.sql import functions as F

    got = decontamination.find_contamination(table(spark, rows), bench, [F.col("doc_id")], most_bytes).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: plain_contamination(t, items) for i, t, _ in rows}
    assert decontamination.contamination_table(table(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    kept = decontamination.drop_contaminated(table(spark, rows), bench)
    assert kept.columns == table(spark, rows).columns and kept.count() == sum(not plain_contamination(t, items)[4] for _, t, _ in rows)


def test_contamination_of_odd_tables(spark):
    items = spark.createDataFrame([(1, "needle in the hay", 3)], "item_id long, text string, item long")
    docs = clashing(spark, [(1, "x " * 200_000 + "Needle in the hay"), (2, None), (2, "needle"), (2, "needle")], ["bench_text", "bench_hit", "bench_row", "item_id", "n_hit"])
    got = Counter((r.doc_id, r.n_words, r.n_hit) for r in decontamination.contamination_table(docs, items).collect())
    assert got == Counter({(1, 200_004, 4): 1, (2, 0, 0): 1, (2, 1, 0): 2})
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(map(tuple, docs.where("doc_id = 2").collect()))
    assert decontamination.contamination_table(docs.limit(0), items).collect() == []
    assert len(decontamination.benchmark_blocks(items, 5)) == 4


ADDRESS = st.text(st.sampled_from("ab1-./?\u212a\u017fKSé"), max_size=14)
WORDS = st.lists(st.sampled_from(["a", "b", "ab", "k", "s", "1"]), min_size=1, max_size=3).map("-".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(WORDS.map(lambda w: url_filter.word_rule("block", w)), st.tuples(st.sampled_from(["allow", "block"]), WORDS, st.sampled_from(["", "/", "/a", "/K-b/", "/s"])).map(lambda r: url_filter.host_rule(*r))), max_size=12), ADDRESS, ADDRESS, st.dictionaries(st.sampled_from(["a", "b", "ab", "k", "s", "1"]), st.integers(0, 9)))
def test_url_index_finds_what_all_rules_find(rules, host, path, frequencies):
    host, path = host.replace("/", "").replace("?", "").translate(url_filter._LOWER), "/" + path.replace("?", "")
    index = url_filter.RuleIndex(tuple(rules), frequencies)
    fitting = [k for k, r in enumerate(rules) if re.search(r.pattern, host + path)]
    assert set(fitting) <= set(index.candidates(host + path))


def test_urls_of_odd_tables(spark):
    table = spark.createDataFrame([("block", "k.org", "/", None), ("allow", "k.org", "/ok/", None), ("block", None, None, "cheap-pills"), ("allow", "", None, ""), ("other", "x", "/", None)], "action string, host string, path string, words string")
    assert sum(len(url_filter.read_rules(b)) for b in url_filter.rule_blocks(table)) == 3
    pages = spark.createDataFrame([(1, "http://K.org/ok/x", 1, 2), (1, "http://K.org/ok/x", 1, 2), (2, "http://a.k.org/OK/", 1, 2), (3, "http://x.y/\u212acheap-pills", 1, 2), (None, "http://x.y/CHEAP-pills?" + "z" * 50_000, 1, 2)], "page_id long, url string, host long, filter_url long")
    wanted = Counter({(1, "k.org", "k.org/ok/", "allow"): 2, (2, "a.k.org", "k.org/", "block"): 1, (3, "x.y", None, "block"): 1, (None, "x.y", None, "block"): 1})
    for most in (1_000_000, 2, 1):
        got = url_filter.judge_urls(pages, [F.col("page_id")], table, most)
        assert Counter((r.page_id, r.host, r.rule, r.verdict) for r in got.collect()) == wanted and got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert url_filter.url_table(pages.limit(0)).collect() == []
    none = url_filter.url_table(pages, table.limit(0)).collect()
    assert len(none) == 5 and all(r.rule is None and r.verdict == "allow" for r in none)


def test_blocks_of_rules_judge_as_all_rules_do(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    whole, parts = ({(r.page_id, r.rule, r.verdict) for r in url_filter.judge_urls(pages, [F.col("page_id")], None, most).collect()} for most in (1_000_000, 100))
    assert whole == parts


def test_url_index_equals_all_rules(spark):
    rules = url_filter.read_rules(url_filter.default_rules(spark))
    assert len(rules) == len(url_filter.HOST_RULES) + len(url_filter.spam_words())
    index = url_filter.RuleIndex(rules, {"net": 50, "example": 90, "en": 3})
    hosts = ["net", "a.net", "example.net", "x.example.net", "notexample.net", "example.com", "org", "b.org", "borg", "www.cheap-pills.example.org", "free-bets.x", "a.b", ""]
    for host in hosts:
        for path in ["", "/", "/en/x", "/en", "/EN/x", "/de/", "/fr/1", "/spam-farm/x", "/spam-farms"]:
            fitting = [r for r in rules if re.search(r.pattern, host + path)] if host else []
            deciding = sorted((r for r in fitting if r.weight), key=lambda r: -r.weight)
            plain = (deciding[0].weight, deciding[0].name, deciding[0].action) if deciding else None
            assert index.judge(host, path) == (plain, any(not r.weight for r in fitting)), (host, path)
    assert index.judge("a.example.net", "/en/1")[0][1:] == ("example.net/en/", "allow") and index.judge("a.example.net", "/x")[0][1:] == ("net/", "block")


def test_url_table(spark):
    urls = [None, "", "no scheme", "http://A.NET/x?y#z", "https://ex.org", "ftp://u@h:1#f", "x://y/p?q://z", "http://m.example.com/de/a"]
    got = {r.page_id: tuple(r)[1:] for r in url_filter.url_table(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.net", "/x", "net/", "block") and got[4][:2] == ("ex.org", "") and got[5][:2] == ("u@h:1", "") and got[6][:2] == ("y", "/p") and got[7][2:] == ("example.com/de/", "block")


def plain_links(rows, words=5, threshold=0.8):
    def grams(t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = [grams(t) for _, t, _ in rows]
    near = lambda a, b: (rows[a][1] or "") == (rows[b][1] or "") or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9)
    links = [[b for b in range(len(rows)) if b != a and near(a, b)] for a in range(len(rows))]
    root = list(range(len(rows)))
    for a in sorted(range(len(rows))):
        stack = [a] if root[a] == a else []
        while stack:
            for b in links[stack.pop()]:
                if root[b] > a:
                    root[b] = a
                    stack.append(b)
    ids = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    return [(rows[k][0], ids[root[k]], len(links[k])) for k in range(len(rows))]


def near_corpus():
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(3))
    base = [word() for _ in range(120)]
    rows = [(0, None, "x"), (1, "", "x"), (2, "!!", "x"), (3, "!!", "x"), (4, "one two", "x"), (5, "One, two", "x"), (None, "lone text here", "x"), (None, "lone text here", "x")]
    for k in range(330):  # one component of more than a block
        copy = list(base)
        copy[draw.randrange(120)] = word()
        rows.append((100 + k, " ".join(copy), "x"))
    for k in range(60):
        copy = list(base)
        for _ in range(draw.randint(2, 20)):
            copy[draw.randrange(120)] = word()
        rows.append((600 + k, " ".join(copy), "x"))
    rows += [(800 + k, " ".join(base), "x") for k in range(30)] + [(900, "again and again and so on", "x")] * 2
    return rows + [(1000 + k, " ".join(word() for _ in range(60)), "x") for k in range(30)]


def test_near_duplicates(spark):
    rows = near_corpus()
    got = near_duplicates.near_duplicate_table(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter(plain_links(rows))
    kept = near_duplicates.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    classes = {(c, i) for i, c, _ in plain_links(rows)}
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter({c for c, i in classes if c is not None} | {i for c, i in classes if c is None})
    assert near_duplicates.near_duplicate_table(table(spark, rows).limit(0)).collect() == []


def test_near_duplicates_of_odd_tables(spark):
    names = ["near_id", "near_node", "near_row", "near_n", "near_salt", "node", "root", "class_id"]
    long = " ".join(f"w{k}" for k in range(30_000))
    docs = spark.createDataFrame([("null", "lone words of one text here", 1), (None, "lone words of one text here", 2), ("a", long, 3), ("b", long + " end", 4), ("c", None, 5), ("c", None, 5)], "doc_id string, text string, near_id long")
    got = {(r.doc_id, r.class_id, r.n_links) for r in near_duplicates.near_duplicate_table(docs).collect()}
    assert got == {("null", "null", 1), (None, "null", 1), ("a", "a", 1), ("b", "a", 1), ("c", "c", 1)}
    assert {tuple(r) for r in near_duplicates.keep_one(docs).collect()} == {("null", "lone words of one text here", 1), ("a", long, 3), ("c", None, 5)}
    wide = clashing(spark, [(1, "a b c"), (2, "A b c!"), (3, "d")], names)
    assert {tuple(r) for r in near_duplicates.keep_one(wide).collect()} == {tuple(r) for r in wide.where("doc_id <> 2").collect()}


def test_a_chain_of_texts_is_compared_by_bands(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 2)
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    long = [word() for _ in range(1120)]
    rows = [(k, " ".join(long[5 * k : 5 * k + 120]), "x") for k in range(200)] + [(500 + k, " ".join(long[:120]), "x") for k in range(3)]
    rows += [(600 + k, " ".join([*long[-60:], word(), *long[-60:-1]]), "x") for k in range(40)]
    seen = []
    plain = near_duplicates.placements
    monkeypatch.setattr(near_duplicates, "placements", lambda *a: seen.append(plain(*a)) or seen[-1])
    monkeypatch.setattr(near_duplicates, "forget", lambda *a: None)
    got = near_duplicates.near_duplicate_table(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter(plain_links(rows))
    ways = Counter(r.places[0].band < 0 for r in seen[0].collect())
    assert ways[False] == 200 and ways[True] == 40
    texts = {r.doc_id: r.n_text_links for r in got}
    assert texts[0] == 2 and texts[100] == 4 and texts[600] == 39


def test_links_do_not_depend_on_the_size_of_blocks(spark, monkeypatch):
    draw = random.Random(19)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    long, dense = [word() for _ in range(340)], [word() for _ in range(80)]
    rows = [(k, " ".join(long[5 * k : 5 * k + 120]), "x") for k in range(40)]
    rows += [(200 + k, " ".join([word(), *[word() if draw.random() < 0.02 else w for w in dense]]), "x") for k in range(24)]
    docs, found = table(spark, rows), []
    for block, size in ((3, 1 << 30), (256, 1 << 30), (256, 3000)):
        monkeypatch.setattr(near_duplicates, "BLOCK", block)
        monkeypatch.setattr(near_duplicates, "BLOCK_BYTES", size)
        _, nodes = near_duplicates.join_near(docs, recall=0.5)
        found.append(sorted((r.node, r.root, r.texts, r.docs) for r in nodes.collect()))
    assert found[0] == found[1] == found[2]
    bands, per_band = near_duplicates.choose_bands(recall=0.5)
    sets = [near_duplicates.shingles(t) for _, t, _ in rows]
    hashes = [near_duplicates.band_hashes(s, bands, per_band) for s in sets]
    links = sum(len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-6 and bool((hashes[i] == hashes[j]).any()) for i in range(len(sets)) for j in range(i))
    assert sum(x[2] for x in found[0]) == 2 * links > 100


def test_pairs_of_earlier_bands():
    bands = np.array([[1, 2, 3], [1, 5, 3], [4, 2, 3]])
    assert not near_duplicates.agree_before(bands, 0).any()
    assert near_duplicates.agree_before(bands, 1)[0, 1] and not near_duplicates.agree_before(bands, 1)[0, 2] and near_duplicates.agree_before(bands, 2)[0, 2]
    assert not near_duplicates.agree_before(bands, 2)[1, 2] and near_duplicates.agree_before(bands, 3)[1, 2]


def test_heavy_keys_join_like_others(spark):
    left = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(100)], "key int, v int")
    right = left.groupBy("key").count().withColumnRenamed("count", "near_n").withColumn("w", left.key * 2)
    for most in (0, 5, 1000):
        got = near_duplicates.skew_join(left, right, "key", "v", most)
        assert {(r.key, r.v, r.w) for r in got.collect()} == {(k % 3 if k < 90 else k, k, 2 * (k % 3 if k < 90 else k)) for k in range(100)} and got.count() == 100


def test_components_of_a_star_with_heavy_hub(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "LEAST_HEAVY", 2)
    edges = spark.createDataFrame([(k, 1) for k in range(2, 300)] + [(300 + k, 301 + k) for k in range(50)], "a long, b long")
    got = {r.node: r.root for r in near_duplicates.components(edges, "star").collect()}
    assert got == {k: 1 for k in range(1, 300)} | {300 + k: 300 for k in range(51)}


def test_shingles_and_bands():
    bands, rows = near_duplicates.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= near_duplicates.MOST_HASHES
    assert len(near_duplicates.shingles("a b c d e f a b c d e")) == 6 + 0 and len(near_duplicates.shingles("x" * 1000 + " y")) == 1
    assert (near_duplicates.shingles("A,b c") == near_duplicates.shingles("a b C!")).all() and len(near_duplicates.shingles(" .,")) == 0


def records(n=6):
    return [warc.encode_record(str(k), f"http://h/{k}", b"payload %d " % k * 40, hashlib.sha256(b"payload %d " % k * 40).hexdigest(), None) for k in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.gzip_member(r) if packed else r for r in records()]
    whole = b"".join(parts)
    assert [r.page_key for _, r, _, _ in warc.read_archive(whole)] == list("012345")
    starts = [sum(map(len, parts[:k])) for k in range(7)]
    hurt = bytearray(whole)
    hurt[starts[2] + len(parts[2]) // 2] ^= 0xFF
    got = list(warc.read_archive(bytes(hurt)))
    assert [r.page_key for _, r, _, _ in got if r] == list("01345")
    assert [(s, e) for s, r, e, _ in got if r is None] == [(starts[2], starts[3])]
    cut = list(warc.read_archive(b"junk" + whole[: starts[5] + 20]))
    assert [r.page_key for _, r, _, _ in cut if r] == list("01234") and [(s, e) for s, r, e, _ in cut if r is None] == [(0, 4), (starts[5] + 4, starts[5] + 24)]
    assert list(warc.read_archive(b"")) == []


def test_members_are_gzip():
    assert gzip.decompress(warc.gzip_member(records(1)[0])) == records(1)[0]


def test_warc_table(spark):
    big = "<p>é</p>" * 40
    pages = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (1, "http://b\r\nX: y", big), (9, "u", "z" * 200_000)]
    got = warc.warc_table(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    wanted = Counter((i, len((t or "").encode()), sha(t), "revisit" if t == big and i != 1 else "response", 1 if t == big and i != 1 else None) for i, _, t in pages)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == wanted


def test_warc_of_odd_tables(spark, tmp_path):
    pages = spark.createDataFrame([("a/b <1>", "u", "text", 1, 2), ("null", "u", "z" * 120, 1, 2), (None, "u", "z" * 120, 1, 2), ("z", "u", "z" * 120, 1, 2)], "page_id string, url string, html string, digest long, hot_id long")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.warc_table(pages).collect()}
    assert got == {("a/b <1>", "response", None), ("null", "response", None), (None, "revisit", "null"), ("z", "revisit", "null")}
    assert warc.warc_table(pages.limit(0)).collect() == []


def test_heavy_digests_are_spread(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_HEAVY", 1)
    pages = spark.createDataFrame([(k, "u", "z" * 120 if k % 2 else "y" * 150 if k < 5 else f"{k} " * 60) for k in range(40)], "page_id long, url string, html string")
    got = {r.page_key: r.refers_to_key for r in warc.with_revisits(pages).collect()}
    assert {k for k, v in got.items() if v == "=1"} == {f"={k}" for k in range(3, 40, 2)} and {k for k, v in got.items() if v == "=0"} == {"=2", "=4"}


def test_damage_is_told_and_quarantined(spark, tmp_path):
    import os

    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}</p>" * 50) for k in range(30)], "page_id long, url string, html string").coalesce(1)
    folder = str(tmp_path / "warc")
    archives = warc.write_archives(warc.with_revisits(pages).coalesce(1), warc.store_uri(folder))
    name = archives.first()["archive"]
    with open(os.path.join(folder, name), "r+b") as f:
        whole = f.read()
        spot = whole.index(warc.MAGIC, len(whole) // 2) + 60  # inside a member's packed bytes
        f.seek(spot)
        f.write(bytes([whole[spot] ^ 0xFF]))
    with pytest.raises(warc.Damaged, match="29 of 30 records; gaps"):
        warc.read_back(archives, warc.store_uri(folder))
    assert warc.read_back(archives, warc.store_uri(folder), strict=False).count() == 29
    records, gaps = warc.salvage(archives, warc.store_uri(folder))
    assert records.count() == 29 and gaps.count() == 1 and gaps.first()["gap_reason"]
