"""The pipeline against plain versions of all its stages."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline

from test_free import plain_contamination, plain_links
from test_native import plain_mix, plain_verdicts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, near_id string, quality_kept string, size string, shard string, bench_text string, k long"


def sentence(draw):
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(8, 14))).capitalize() + "."


def fixture():
    draw = random.Random(11)
    items = [(k, " ".join(sentence(draw).lower().strip(".") for _ in range(2))) for k in range(5)]
    texts = ["\n".join(sentence(draw) for _ in range(draw.randint(4, 9))) for _ in range(60)]
    texts += texts[:8] + [t + " More at the end." for t in texts[8:16]] + [t.replace("a", "e", 1) for t in texts[16:20]]
    texts += [f"{sentence(draw)}\n{sentence(draw)} {items[k][1]} {sentence(draw)}\n{sentence(draw)}" for k in range(5)]
    texts += [None, "", "too short", "# $ % | " * 30, "same words again and again " * 40, "x" * 50_000]
    rows = [(k, t, draw.choice(["s1", "s2", "s3", None])) for k, t in enumerate(texts)]
    rows += [(None, "\n".join(sentence(draw) for _ in range(6)), "s1"), rows[30], rows[30], (1031, rows[31][1] + "\nAnd one line more of it.", "s2")]
    return rows, items


def plain_pipeline(rows, items):
    """(doc_id, text, source, shard groups) of the copies that a plain version of the stages leaves, and of all texts that share a shard."""
    rows = [r for r, kept in zip(rows, plain_verdicts([t for _, t, _ in rows]), strict=True) if kept]
    classes = defaultdict(list)
    keyed = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    for (k, t, s), (_, root, _) in zip(keyed, plain_links(keyed), strict=True):
        classes[root].append(rows[k])
    least = lambda r: (r[0] is None, r[0] or 0)
    firsts = []
    for members in classes.values():
        low = min(map(least, members))
        firsts.append([r for r in members if least(r) == low])
    assert all(len({r[1] for r in f}) == 1 for f in firsts)  # the fixture leaves no choice between unlike texts of one id
    rows = [f[0] for f in firsts]
    rows = [r for r in rows if not plain_contamination(r[1], items)[4]]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    return Counter({r: n // words(r[1]) for r, n in zip(rows, plain_mix(rows), strict=True) if n})


def folder_of(spark, tmp_path, rows, items):
    wide = [(i, t, "en", s, 1, "n", "q", "z", "h", "b", 5) for i, t, s in rows]
    spark.createDataFrame(wide, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_run_equals_the_plain_version(spark, tmp_path):
    rows, items = fixture()
    wanted = plain_pipeline(rows, items)
    got = corpus_pipeline.run(spark, folder_of(spark, tmp_path, rows, items))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")] + ["shard_size", "shard_number"]
    found = got.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in found) == wanted and len(wanted) > 30
    assert all(r[5:11] == ("n", "q", "z", "h", "b", 5) and r.shard_size == len(r.text.encode()) + 8 and 0 <= r.shard_number < 24 for r in found)
    shards = defaultdict(set)
    loads = Counter()
    for r in found:
        shards[r.text].add(r.shard_number)
        loads[r.shard_number] += r.shard_size
    assert all(len(s) == 1 for s in shards.values()) and len(loads) == 24
    groups = Counter()
    for r in found:
        groups[r.text] += r.shard_size
    assert max(loads.values()) <= sum(groups.values()) / 24 + max(groups.values())
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, found))


def test_run_of_an_empty_table(spark, tmp_path):
    got = corpus_pipeline.run(spark, folder_of(spark, tmp_path, [], [(1, "x")]))
    assert got.collect() == []


def test_stages_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    state, left = docs, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        state = corpus_pipeline.written(stage(spark, state, folder), f"test-{k}")
        left.append(state.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert state.columns == docs.columns
    assert left[0] > left[1] > left[2] > left[3] and left[4] == left[5]
