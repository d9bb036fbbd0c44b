"""URL filter: pattern rules indexed by their rarest literal token.

A rule's literal tokens are counted over all URLs; the rule is filed under the rarest. The tokens of a URL fetch candidate
rules, and only those run their regular expressions. A rule without a token that a match must hold whole is tried always.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, ship, written

TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """action on URLs that fit. name: what to report. pattern: a regular expression for host + path with the host in
    lower case. literals: tokens, in lower case, that stand whole in any fitting URL. Of fitting rules that decide, the one
    with the most weight wins; rules without weight only speak where none of those fits."""

    action: str
    name: str
    pattern: str
    literals: tuple[str, ...]
    weight: int = 0


#: Fixed rule: A-Z become a-z and nothing else does, in patterns, tokens and URLs alike.
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_rule(action: str, host: str, path: str) -> UrlRule:
    """A rule for a host and all its subdomains, with paths that start with path. Longer rules weigh more."""
    host = host.translate(_LOWER)
    ended = path if re.search(r"[^A-Za-z0-9]$", path) else re.sub(r"[A-Za-z0-9]+$", "", path)  # a last token may go on in a URL
    whole = re.findall(TOKEN, host) + re.findall(TOKEN, ended.translate(_LOWER))
    return UrlRule(action, host + path, rf"^(?:[^/]*\.)?{re.escape(host)}(?={re.escape(path[:1]) or '/|$'}){re.escape(path)}", tuple(whole), len(host) + len(path))


def word_rule(action: str, words: str) -> UrlRule:
    """A rule for URLs in which words, as hyphen-joined tokens, stand between other characters than ASCII letters and digits. A-Z match a-z."""
    words = words.translate(_LOWER)
    either = "".join(f"[{c}{c.upper()}]" if "a" <= c <= "z" else re.escape(c) for c in words)
    return UrlRule(action, words, rf"(?<![A-Za-z0-9]){either}(?![A-Za-z0-9])", tuple(re.findall(TOKEN, words)))


#: The contract's rules.
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The method's own verdicts elsewhere: kinds of spam, each as what is offered and how. Every pair is a rule, joined by a hyphen in either order.
SPAM = {
    "gambling": (("casino", "casinos", "poker", "slots", "bet", "bets", "betting", "roulette", "jackpot", "lottery"), ("win", "wins", "free", "online", "bonus", "live", "cash", "spins", "best")),
    "pharmacy": (("pills", "pharmacy", "meds", "viagra", "cialis", "steroids"), ("cheap", "buy", "online", "discount", "order", "generic")),
    "adult": (("adult", "xxx", "porn", "sex"), ("cams", "chat", "dating", "video", "videos", "live", "free", "x")),
    "advertising": (("ads", "ad", "adserver", "popup", "banner"), ("track", "tracker", "tracking", "click", "clicks", "server", "serve")),
    "money": (("money", "loans", "loan", "credit", "crypto"), ("free", "fast", "payday", "easy", "cheap", "instant")),
    "link farms": (("spam", "link", "links", "seo"), ("farm", "farms", "exchange", "wheel")),
}


def spam_words() -> list[str]:
    return sorted({w for what, how in SPAM.values() for a in what for b in how for w in (f"{a}-{b}", f"{b}-{a}")})


#: Rules that are with the driver and every worker at a time; a longer list is tried in blocks, one after another.
BLOCK_RULES = 1_000_000
RULE_SCHEMA = "action string, host string, path string, words string"


def default_rules(spark: SparkSession) -> DataFrame:
    """The contract's host rules and the method's own word rules, as a table (action, host, path, words)."""
    return spark.createDataFrame([(a, h, p, None) for a, h, p in HOST_RULES] + [("block", None, None, w) for w in spam_words()], RULE_SCHEMA)


def rule_blocks(rules: DataFrame, most: int = BLOCK_RULES) -> list[DataFrame]:
    """The different rules of a table (action, host, path, words) in blocks of about most rows. Rows with neither host nor words, or another action, count for nothing."""
    filled = (F.coalesce("host", F.lit("")) != "") | (F.coalesce("words", F.lit("")) != "")
    rows = rules.where(filled & F.col("action").isin("allow", "block")).select("action", "host", "path", "words").distinct()
    blocks = max(-(-rows.count() // most), 1)
    return [rows.where(F.pmod(F.xxhash64("action", "host", "path", "words"), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [rows]


def read_rules(rules: DataFrame) -> tuple[UrlRule, ...]:
    """Rules of a block: a host rule where host is filled, else a word rule."""
    made = [host_rule(r["action"], r["host"], r["path"] or "") if r["host"] else word_rule(r["action"], r["words"]) for r in rules.collect()]
    return tuple(sorted(made, key=lambda r: (r.name, r.action)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case; path: then up to ? or #. Empty if there is none."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(filter_url, locate('://', filter_url) + 3)")).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(ascii_lower, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def token_frequencies(addresses: DataFrame, rules: tuple[UrlRule, ...]) -> dict[str, int]:
    """In how many of all URLs each literal token of a block of rules stands. One row for each such token reaches the driver."""
    wanted = sorted({t for r in rules for t in r.literals})
    if not wanted:
        return {}
    literals = addresses.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    tokens = F.explode(F.array_distinct(F.regexp_extract_all(F.translate(F.concat("host", "path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TOKEN), F.lit(0)))).alias("token")
    counted = addresses.select(tokens).join(literals, "token").groupBy("token").count()
    return {t: 0 for t in wanted} | {r[0]: r[1] for r in counted.collect()}


class RuleIndex:
    def __init__(self, rules: tuple[UrlRule, ...], frequencies: dict[str, int]):
        self.filed: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        self.rules = rules
        self.compiled: dict[int, re.Pattern] = {}
        for k, rule in enumerate(rules):
            if rule.literals:
                self.filed[min(rule.literals, key=lambda t: (frequencies.get(t, 0), t))].append(k)
            else:
                self.always.append(k)
        self.tokens = re.compile(TOKEN)

    def candidates(self, address: str) -> list[int]:
        found = set(self.always)
        for token in set(self.tokens.findall(address.translate(_LOWER))):
            found.update(self.filed.get(token, ()))
        return sorted(found)

    def pattern(self, k: int) -> re.Pattern:
        if k not in self.compiled:
            self.compiled[k] = re.compile(self.rules[k].pattern)
        return self.compiled[k]

    def judge(self, host: str, path: str) -> tuple[tuple[int, str, str] | None, bool]:
        """((weight, name, action) of the deciding rule, whether a rule without weight blocks)."""
        address = host + path
        fitting = [self.rules[k] for k in self.candidates(address) if self.pattern(k).search(address)] if host else []
        return max(((r.weight, r.name, r.action) for r in fitting if r.weight), default=None), any(r.action == "block" for r in fitting if not r.weight)


def judge_urls(pages: DataFrame, keep: list[Column], rules: DataFrame | None = None, most: int = BLOCK_RULES) -> DataFrame:
    """keep's columns and host, path, rule, verdict for each row of pages. Reads only url; moves only token counts.

    rules: a table, see rule_blocks. Each block is a step over the pages that keeps the best rule so far; what a step but the
    last returns is written, so a plan never holds two blocks.
    """
    kept = pages.select(F.struct(*keep).alias("url_row"), F.col("url").alias("filter_url"))
    host, path = host_and_path(F.col("filter_url"))
    state = T.StructType([T.StructField("best", BEST), T.StructField("blocked", T.BooleanType())])
    judged = kept.select("url_row", host.alias("host"), path.alias("path"), F.lit(None).cast(BEST).alias("best"), F.lit(False).alias("blocked"))
    schema = T.StructType([*judged.schema.fields[:3], *state.fields])
    context, blocks = pages.sparkSession.sparkContext, rule_blocks(default_rules(pages.sparkSession) if rules is None else rules, most)
    for n, block in enumerate(blocks):
        made = read_rules(block)
        shared = context.broadcast(([astuple(r) for r in made], token_frequencies(judged, made)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            fields, frequencies = shared.value
            index = RuleIndex(tuple(UrlRule(*f) for f in fields), frequencies)
            for batch in batches:
                bests, blocked = [], []
                for h, p, before, stopped in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "best", "blocked")), strict=True):
                    best, stops = index.judge(h, p)
                    known = None if before is None else (before["weight"], before["name"], before["action"])
                    best = max((x for x in (best, known) if x is not None), default=None)
                    bests.append(None if best is None else dict(zip(("weight", "name", "action"), best, strict=True)))
                    blocked.append(stopped or stops)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("url_row", "host", "path")], pa.array(bests, BEST_ARROW), pa.array(blocked, pa.bool_())], schema.names)

        before, judged = judged, judged.mapInArrow(run, schema)
        if n + 1 < len(blocks):
            judged = written(judged, "url-step")
            forget(before)
    verdict = F.coalesce("best.action", F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select("url_row.*", "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"))


BEST = T.StructType([T.StructField("weight", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("action", T.StringType())])
BEST_ARROW = pa.struct([("weight", pa.int32()), ("name", pa.string()), ("action", pa.string())])


def url_table(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A URL that is null, empty or has no :// has an empty host, fits no rule and is allowed. Repeated rows and null ids are
    judged each; of rules of equal length that fit, the last by name and then block before allow. Very long URLs are
    searched whole. An empty table gives no rows. Only page_id and url are read, so other columns can't clash.
    """
    return judge_urls(pages, [F.col("page_id")], rules)


ship(__name__)
