"""URL verdicts by Bloom filter cascades (DataFrame functions only).

A cascade answers "is this key on the list?" exactly for every key of the corpus: level 1 is a
Bloom filter of the listed keys, level 2 one of the corpus keys that pass level 1 without being
listed, level 3 one of the listed keys that pass level 2, and so on until no key passes wrongly.
The corpus keys come from the whole table, so no key can be asked for that was not seen when the
cascade was built. Asking is a few hashes against bit arrays in the plan: no join, no shuffle.

A key is a host suffix followed by a path prefix. From a URL only those keys are made that a list
could hold: suffixes of up to the most labels, prefixes of the path lengths, that occur in it.

Listed are the rules' keys and the hosts to block where no rule fits. The latter come from a rule that is
fixed beforehand and knows no host: those with a label that has one of ``BLOCKED_WORDS`` between its
dashes, whatever domain it belongs to. They are found in all pages and written as a table.

The bits of a level are bounded by ``MAX_FILTER_BITS``. A longer list of hosts is matched by joins instead,
on distinct hosts, with the same result.

Defined cases: a null URL, or one without ``://``, has empty host and path and gets the verdict of
no match; an empty path starts with no rule path but the empty one; of several rules that fit, the
longest wins, of equally long ones the greater string; repeated rows are pages of their own; an
empty table gives no rows, an empty list matches nothing.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import let, written

MAX_FILTER_BITS = 64 << 20
FIRST_BITS, NEXT_BITS = 12, 6  # bits per key of the first level and of the others
HASHES = 4

RULES = {
    "allow": ["org/", "com/fr/"],
    "block": ["example.org/es/", "example.org/en/1", "com/de/"],
}
#: What a host's label tells of its pages, by the usual categories of block lists (fixed values).
BLOCKED_WORDS = [
    "ads", "adult", "bet", "bets", "casino", "gambling", "malware", "phishing", "pills", "poker", "porn", "spam", "viagra",
    "warez", "xxx",
]
#: The host from the first label on that has such a word.
BLOCKED_HOST = rf"(?s)(?:^|\.)((?:[^.]*-)?(?:{'|'.join(BLOCKED_WORDS)})(?:-[^.]*)?(?:\..*)?)$"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column, labels: int) -> Column:
    """The host's suffixes of up to so many labels."""
    parts = F.slice(F.reverse(F.split(host, r"\.")), 1, labels)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.reverse(F.slice(parts, F.lit(1), i)), "."),
    )


def candidate_keys(host: Column, path: Column, listed: Sequence[str]) -> Column:
    """All keys of a URL that could be in ``listed``."""
    split = [key.partition("/") for key in listed]
    labels = max((h.count(".") + 1 for h, _, _ in split), default=1)
    lengths = sorted({len(slash + rest) for _, slash, rest in split}) or [0]
    suffixes = _suffixes(host, labels)
    prefixes = F.array_distinct(
        F.filter(
            F.array(*[F.substring(path, 1, n) if n else F.lit("") for n in lengths]),
            lambda p: F.length(p).isin(lengths),
        )
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


@dataclass(frozen=True)
class Level:
    words: np.ndarray
    seed: int

    def passes(self, key: Column) -> Column:
        def asked(words: Column) -> Column:
            found = F.lit(True)
            for position in _positions(key, self.seed, len(self.words) * 64):
                word = F.get(words, F.floor(position / 64).cast("int"))
                found = found & (F.getbit(word, (position % 64).cast("int")) == 1)
            return found

        return let(F.lit(self.words), asked)  # the bits stand in the plan once


def _positions(key: Column, seed: int, bits: int) -> list[Column]:
    return [
        F.pmod(F.xxhash64(key, F.lit(seed * HASHES + i)), F.lit(bits).cast("long"))
        for i in range(HASHES)
    ]


def _level(keys: DataFrame, n: int, seed: int, bits_per_key: int) -> Level:
    size = max(1, -(-n * bits_per_key // 64))
    if size * 64 > MAX_FILTER_BITS:
        raise ValueError(f"{n} keys need {size * 64} bits; the bound is {MAX_FILTER_BITS}: use a join")
    positions = keys.select(
        F.explode(F.array(*_positions(F.col("key"), seed, size * 64))).alias("position")
    )
    rows = (
        positions.select(
            F.floor(F.col("position") / 64).cast("int").alias("word"),
            (F.col("position") % 64).cast("int").alias("bit"),
        )
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        .collect()  # at most `size` words, bounded above
    )
    words = np.zeros(size, dtype=np.int64)
    for row in rows:
        words[row["word"]] = row["bits"]
    return Level(words, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            answer = F.when(self.levels[i - 1].passes(key), answer).otherwise(F.lit(i % 2 == 0))
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 0) -> Cascade:
    """``listed`` and ``universe``: one column ``key``, distinct; the universe is the corpus's."""
    inside, n = listed, listed.count()
    outside = universe.join(listed, "key", "left_anti")
    levels: list[Level] = []
    while True:
        encoded, other = (inside, outside) if len(levels) % 2 == 0 else (outside, inside)
        level = _level(encoded, n, seed * 1000 + len(levels), NEXT_BITS if levels else FIRST_BITS)
        levels.append(level)
        wrong = written(other.filter(level.passes(F.col("key"))), "cascade-level")
        n = wrong.count()
        if not n:
            return Cascade(tuple(levels))
        if len(levels) % 2:
            outside = wrong
        else:
            inside = wrong


def blocked_hosts(hosts: DataFrame) -> DataFrame:
    """(key): the hosts to block among those in the column ``host``, from the telling label on."""
    keys = hosts.select(F.regexp_extract("host", BLOCKED_HOST, 1).alias("key"))
    return keys.filter("key <> ''").distinct()


def _hosts_in(parts: DataFrame, listed: DataFrame, labels: int) -> DataFrame:
    """(host): the distinct hosts of ``parts`` that have a listed suffix."""
    hosts = parts.select("host").distinct()
    keys = hosts.select("host", F.explode(_suffixes(F.col("host"), labels)).alias("key"))
    return keys.join(listed, "key", "left_semi").select("host").distinct()


def _tagged(tag: str, key: Column) -> Column:
    """Keys of several lists in one universe."""
    return F.concat(F.lit(f"{tag}|"), key)


def url_verdicts(
    pages: DataFrame,
    rules: dict[str, Sequence[str]],
    blocked: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    max_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null) and verdict. ``blocked``: hosts to block
    where no rule fits (column ``key``); by default :func:`blocked_hosts` of the pages."""
    spark = pages.sparkSession
    every_rule = [r for keys in rules.values() for r in keys]
    parts = pages.select(
        F.col(id_col).alias("page_id"),
        url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"),
    )
    host, path = F.col("host"), F.col("path")
    chosen = blocked_hosts(parts) if blocked is None else blocked.select("key").filter("key is not null").distinct()
    hosts = written(chosen, "blocked-hosts")
    n_hosts, labels = hosts.agg(F.count("key"), F.max(F.size(F.split("key", r"\.")))).first()
    by_join = n_hosts * FIRST_BITS > max_bits
    rule_keys = candidate_keys(host, path, every_rule)
    host_keys = _suffixes(host, labels or 1)
    # One parameter each: a second one would be taken for the position in the array.
    tagger = lambda tag: lambda k: _tagged(tag, k)
    asked = [F.transform(rule_keys, tagger(tag)) for tag in rules]
    if not by_join:
        asked.append(F.transform(host_keys, tagger("host")))
    universe = written(parts.select(F.explode(F.concat(*asked)).alias("key")).distinct(), "url-keys")
    listed = spark.createDataFrame(sorted({(f"{tag}|{key}",) for tag, keys in rules.items() for key in keys}), "key string")
    if not by_join:
        listed = listed.union(hosts.select(_tagged("host", F.col("key"))))
    cascade = build_cascade(listed, universe)

    def on(tag: str, key: Column) -> Column:
        return cascade.contains(_tagged(tag, key))

    fits = F.filter(rule_keys, lambda k: on("allow", k) | on("block", k))
    longest = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))
    judged = parts.withColumn("rule", longest["rule"])
    if by_join:
        found = _hosts_in(parts, hosts, labels).withColumnRenamed("host", "listed_host")
        judged = judged.join(found, judged["host"] == found["listed_host"], "left")
        is_blocked = F.col("listed_host").isNotNull()
    else:
        is_blocked = F.exists(host_keys, lambda k: on("host", k))
    verdict = (
        F.when(F.col("rule").isNull(), F.when(is_blocked, "block").otherwise("allow"))
        .when(on("allow", F.col("rule")), "allow")
        .otherwise("block")
    )
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rule_host, rule_path, says) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
)
SELECT page_id, host, path,
       (SELECT arg_max(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
        WHERE ends_with('.' || host, '.' || rule_host) AND starts_with(path, rule_path)) AS rule,
       coalesce((SELECT arg_max(says, length(rule_host || rule_path)) FROM rules
                 WHERE ends_with('.' || host, '.' || rule_host) AND starts_with(path, rule_path)),
                CASE WHEN regexp_matches(host, '(^|[.-])(ads|adult|bet|bets|casino|gambling|malware|phishing|pills|poker|porn|spam|viagra|warez|xxx)([.-]|$)')
                     THEN 'block' ELSE 'allow' END) AS verdict
FROM parts
"""


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
