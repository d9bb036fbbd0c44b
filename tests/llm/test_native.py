"""Sharding, quality rules and mixing against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sorrel.llm import mixing, quality_rules, sharding

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, size int, part int, shard string, key string"


def table(spark, rows):
    """rows of (doc_id, text, source), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, 1, 7, 8, "x", "k") for i, t, s in rows], EXTRA).repartition(3)


def corpus(n=120, seed=1):
    draw = random.Random(seed)
    texts = [None, "", " \n\t ", "a", "dup dup dup", "x" * 5000] + [" ".join(draw.choice("abcdefgh") * draw.randint(1, 5) for _ in range(draw.randint(1, 80))) for _ in range(40)]
    rows = [(i, draw.choice(texts), draw.choice(["s1", "s2", "s3", None])) for i in range(n)] + [(None, "null id", "s1"), (5, "again", "s2"), (5, "again", "s2")]
    return rows + [(1000 + i, "hot copy of one text", "s1") for i in range(60)]


def least_capacity(sizes, shards):
    """Brute force: the smallest capacity at which greedy packing in order fits."""
    def fits(c):
        used, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= shards

    return next(c for c in range(max(max(sizes), -(-sum(sizes) // shards)), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("seed", range(8))
def test_minimax_equals_brute_force(seed):
    draw = random.Random(seed)
    groups = sorted((f"{draw.getrandbits(128):032x}", draw.randint(1, 60)) for _ in range(draw.randint(1, 150)))

    def spans(prefixes, digits):
        found = defaultdict(list)
        for key, size in groups:
            if prefixes is None or any(key.startswith(p) for p in prefixes):
                found[key[:digits]].append((key, size))
        return [sharding.Span(p, sum(s for _, s in g), g[0][0], g[-1][0]) for p, g in sorted(found.items())]

    shards = draw.randint(1, 9)
    alone, firsts, capacity = sharding.minimax(spans(None, 1), shards, lambda ps: spans(ps, len(next(iter(ps))) + 1))
    rest = [s for k, s in groups if k not in alone]
    if rest:
        assert capacity == least_capacity(rest, shards - len(alone))
    loads = Counter()
    for k, s in groups:
        loads[alone.index(k) if k in alone else len(alone) + sum(k >= f for f in firsts)] += s
    assert max(loads) < shards and all(v <= capacity for s, v in loads.items() if s >= len(alone))


def test_shard_table(spark):
    rows = corpus()
    got = sharding.shard_table(table(spark, rows), 6).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in got:
        by_text[r.size, r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 6
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_table(table(spark, rows).limit(0)).collect() == []
    assert sharding.assign_shards(table(spark, rows), 6).count() == len(rows)


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    draw = random.Random(4)
    made = ["\n".join(" ".join(draw.choice(["a", "b", "Ünï", "c*", "|", "<d>", "\u00a0", "é"]) for _ in range(draw.randint(0, 9))) for _ in range(draw.randint(1, 12))) for _ in range(150)]
    rows = [(i, t, "s") for i, t in enumerate([None, "", "  ", "\n\n", "one", "a b c d e a b c d e", "x " * 3000, *made])]
    got = {r.doc_id: r for r in quality_rules.quality_table(table(spark, rows)).collect()}
    for i, t, _ in rows:
        r = got[i]
        stats = plain_stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats, t
        assert r.base_failed == (stats[0] < 10 or 100 * stats[4] > 20 * stats[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_table(table(spark, rows).limit(0)).collect() == []


def test_label_model_finds_the_bad_class():
    draw = random.Random(9)
    patterns = Counter()
    for _ in range(3000):
        good = draw.random() < 0.85
        patterns[tuple(quality_rules.ABSTAIN if draw.random() < 0.2 else int(good) if draw.random() < 0.9 else int(not good) for _ in range(5))] += 1
    model = quality_rules.fit_label_model(sorted(patterns.items()), 5)
    assert all(g > 0 > b for g, b in zip(model.good, model.bad, strict=True))
    assert model.prior + sum(model.bad) < 0 < model.prior + sum(model.good)
    assert quality_rules.fit_label_model([], 3).prior == 0


def test_good_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = quality_rules.quality_table(docs).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in seen}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()


def plain_verdicts(texts):
    """Which of the texts the rules keep, from plain statistics and the label model over plain votes."""
    G, B, A = quality_rules.GOOD, quality_rules.BAD, quality_rules.ABSTAIN

    def ballot(text):
        text = text or ""
        n_words, chars, symbols, dup, repeat = plain_stats(text)
        lines = len([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        import regex

        marks = regex.sub(r"[\p{Ll}\p{Lo}\p{Nd}\x20\x09-\x0D,]+", "", text)
        upper, stops, shouts = len(regex.findall(r"\p{Lu}", marks)), len(re.findall("[.?]", marks)), marks.count("!")
        distinct = len(set(re.findall(r"[^\x20\x09-\x0D]+", text)))
        w, ln, c = max(n_words, 1), max(lines, 1), max(chars, 1)
        rules = [
            (symbols > 0.1 * w, symbols < 0.02 * w), (len(marks) - upper > 0.1 * c, len(marks) - upper < 0.05 * c), (symbols > 0.08 * c, symbols < 0.01 * c), (repeat > 0.1 * w, repeat < 0.03 * w),
            (dup > 0.3 * ln, dup == 0 and ln > 1), (c < 2.5 * w or c > 15 * w, 3 * w < c < 10 * w), (w < 20, w > 50), (upper > 0.4 * c, upper < 0.15 * c),
            (shouts > 0.2 * w, shouts < 0.05 * w), (stops == 0 and w > 50, 0.02 * w < stops < 0.4 * w), (distinct < 0.1 * w and w > 50, distinct > 0.3 * w),
        ]
        return tuple(B if bad else G if good else A for bad, good in rules), n_words < 10 or 100 * repeat > 20 * n_words

    ballots = [ballot(t) for t in texts]
    model = quality_rules.fit_label_model(sorted(Counter(b for b, _ in ballots).items()), 11)
    odds = [model.prior + sum(model.good[k] if v == G else model.bad[k] if v == B else 0 for k, v in enumerate(b)) for b, _ in ballots]
    return [not failed and 1 / (1 + math.exp(-o)) >= quality_rules.KEEP_AT for (_, failed), o in zip(ballots, odds, strict=True)]


def test_verdicts_against_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r.doc_id: r.kept for r in quality_rules.quality_table(docs).collect()}
    assert got == dict(zip([r.doc_id for r in rows], plain_verdicts([r.text for r in rows]), strict=True))


def test_columns_of_any_name_pass_through(spark):
    names = ["q_words", "q_lines", "q_marks", "q_hashes", "q_two", "q_four", "q_grams", "q_pairs", "quality_stats", "quality_votes", "quality_kept", "quality_posterior", "quality_row"]
    names += ["size", "shard", "gkey", "part", "known", "key", "tie", "mix_row", "k", "time", "weight", "target", "before", "shard_row", "range"]
    schema = "doc_id long, text string, source string" + "".join(f", {n} string" for n in names)
    body = "A fine line of words that says something new in every part of it, and ends well.\nAnother one follows it here."
    rows = [(i, f"{body} Number {i}.", "s", *[f"{n}{i}" for n in names]) for i in range(30)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    assert {tuple(r) for r in quality_rules.keep_good(docs).collect()} == set(rows)
    assert {tuple(r) for r in mixing.mix(docs).collect()} == set(rows)
    placed = sharding.assign_shards(docs, 4)
    assert placed.columns == [*docs.columns, "shard_size", "shard_number"] and {tuple(r)[:-2] for r in placed.collect()} == set(rows)
    assert len(sharding.shard_table(docs, 4).collect()) == len(mixing.mix_table(docs).collect()) == len(quality_rules.quality_table(docs).collect()) == 30


def plain_mix(rows):
    """taken words of each of the (id, text, source) rows: copies in order of finish time, up to the budget."""
    import hashlib

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    copies = []
    for nth, name in enumerate(names):
        weight = (5, 2, 1)[nth % 3]
        mine = sorted((md5(":".join([*([str(i)] if i is not None else []), md5(t or "")])), words(t), k) for k, (i, t, s) in enumerate(rows) if s == name)
        done = 0
        for p in range(3):
            for _, size, k in mine:
                done += size
                copies.append((Fraction(done, weight), nth, size, k))
    budget, sent, taken = sum(words(t) for _, t, _ in rows), 0, Counter()
    for _, _, size, k in sorted(c for c in copies if c[2]):
        if sent + Fraction(size, 2) > budget:
            break
        sent += size
        taken[k] += size
    return [taken[k] for k in range(len(rows))]


@pytest.mark.parametrize("seed", [3, 4])
def test_mix_is_the_sorted_order_cut_at_the_budget(spark, seed):
    rows = corpus(150, seed) + [(4000 + k, "w " * (900 if k == 0 else 3), f"t{k % 4}") for k in range(9)]
    got = Counter((r.doc_id, r.size, r.taken) for r in mixing.mix_table(table(spark, rows)).collect())
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert got == Counter((i, words(t), n) for (i, t, _), n in zip(rows, plain_mix(rows), strict=True))


def test_many_sources_are_numbered_in_order(spark):
    sizes = spark.createDataFrame([(f"={k:04d}", 7) for k in range(500)] + [(">", 3)], "known string, source_size long")
    got = {r.known: r["rank"] for r in mixing.numbered_sources(sizes.repartition(7)).collect()}
    assert got == {f"={k:04d}": k for k in range(500)} | {">": 500}


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, budget = {}, set(names), sum(sizes.values())
    while True:
        share = (budget - sum(target.values())) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * share for s in free}
        target |= {s: 3 * sizes[s] for s in over}
        free -= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rows = corpus(200, seed) + [(3000 + k, "few words here", "a-small-source") for k in range(2)]
    got = mixing.mix_table(table(spark, rows)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    wanted = plain_targets(sizes)
    by_size = {(sizes[s], round(wanted[s], 6)): s for s in sizes}
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.taken <= 3 * r.size
        taken[by_size[r.source_size, r.target]] += r.taken
    largest = max(words(t) for _, t, _ in rows)
    assert all(abs(taken[s] - wanted[s]) <= largest for s in sizes)
    again = mixing.mix_table(table(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    copies = mixing.mix(table(spark, rows))
    mixed = Counter(r.doc_id for r in copies.select("doc_id").collect())
    assert all(mixed[r.doc_id] == r.taken // r.size for r in got if r.size and r.doc_id not in (5, None))
    assert copies.columns == table(spark, rows).columns
    assert mixing.mix_table(table(spark, rows).limit(0)).collect() == []
    assert {r.taken for r in mixing.mix_table(table(spark, [(1, None, None), (2, "", "s")])).collect()} == {0}
