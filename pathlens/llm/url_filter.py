"""URL filters by a Bloom filter cascade [native].

Level 1 encodes the listed keys, level 2 those unlisted keys of the corpus that pass level 1,
level 3 the listed keys that pass level 2, and so on until no key passes wrongly. Over the key
universe that the cascade was built on, membership is exact, and a lookup is a few hashes in a
projection: no join. The rate of level 1 (sqrt(1/2) * listed / unlisted, 1/2 below it) is that of
Larisch et al., "CRLite", IEEE S&P 2017.

Keys are ``host suffix + path prefix``, cut to the shapes (labels, path length) that the rules
have. The rules are a parameter held by the driver; every level is in proportion to their number,
whatever the corpus, so the bits are literals of the plan. A url's keys are an array that one
expression runs over, so the plan does not grow with the shapes, and the listed keys leave the
universe by a join while the cascade is built.

Defined cases: a null url, or one without ``://``, has empty host and path and fits no rule;
very long urls are judged whole; a url that fits no rule gets ``default``; of a key listed both ways block wins; repeated rows are
judged alike; an empty table gives an empty result; other columns pass through ``judge``, and
columns named like its results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

# fixed values: (host, path, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Level(NamedTuple):
    bits: int
    hashes: int
    seed: int
    words: list[int]        # 64 bits each


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(j)), F.lit(bits)) for j in range(hashes)]


def in_level(key: Column, level: Level) -> Column:
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")     # folded to a literal
    bits = [F.getbit(F.get(words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1
            for p in _positions(key, level.bits, level.hashes, level.seed)]
    return reduce(lambda a, b: a & b, bits)


def in_cascade(key: Column, levels: Sequence[Level]) -> Column:
    """Whether ``key``, one of the universe that the cascade was built on, is listed."""
    found = F.lit(False)
    for level in reversed(levels):
        found = in_level(key, level) & ~found
    return F.coalesce(found, F.lit(False))


def build_cascade(universe: DataFrame, listed: Sequence[str], name: str = "cascade") -> list[Level]:
    """Levels for the ``listed`` keys over ``universe`` (column ``key``, each key once).

    One pass over the universe per level, and the levels after the first meet only the few keys
    that passed the one before. The driver fetches a level's words, whose number follows
    ``len(listed)``.
    """
    spark = universe.sparkSession
    inside = sorted(set(listed))
    if not inside:
        return []
    encoded = spark.createDataFrame([(k,) for k in inside], "key string")
    unlisted = universe.where(F.col("key").isNotNull()).select("key").join(encoded, "key", "left_anti")
    others, n, n_others = unlisted, len(inside), unlisted.count()
    levels: list[Level] = []
    while n:
        rate = min(0.5, n * math.sqrt(0.5) / n_others) if not levels and n_others else 0.5
        bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        hashes, seed = max(1, round(-math.log2(rate))), len(levels)
        at = F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("p")
        words = [0] * math.ceil(bits / 64)
        for row in (encoded.select(at).groupBy(F.floor(F.col("p") / 64).alias("word"))
                    .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("ones"))
                    .collect()):
            words[row["word"]] = row["ones"]
        levels.append(Level(bits, hashes, seed, words))
        passed = written(others.where(in_level(F.col("key"), levels[-1])), f"{name}-{len(levels)}")
        encoded, others, n_others = passed, encoded, n
        n = passed.count()
    return levels


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_keys(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> list[Column]:
    """The keys under which rules could list a url, one per shape of the rules."""
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    return [F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)) for labels, length in shapes]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """``pages`` plus host, path, rule (of those that fit, the longest) and verdict.

    A rule fits its host and all subdomains, and the paths that start with its path.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    universe = written(pages.select(F.explode(F.array(*rule_keys(host, path, rules))).alias("key")).distinct(),
                       "url-keys")
    block = build_cascade(universe, [h + p for h, p, v in rules if v == "block"], "url-block")
    allow = build_cascade(universe, [h + p for h, p, v in rules if v == "allow"], "url-allow")
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*keep, host.alias("host"), path.alias("path"))
    verdict = lambda k: F.when(in_cascade(k, block), F.lit("block")).when(in_cascade(k, allow), F.lit("allow"))
    keys = F.array(*rule_keys(F.col("host"), F.col("path"), rules))
    fitting = F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), verdict(k).alias("verdict")))
    best = parts.withColumn("_best", F.array_max(F.filter(fitting, lambda f: f["verdict"].isNotNull())))
    return best.select(*keep, "host", "path", F.col("_best.rule").alias("rule"),
                       F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


OP4_SQL = r"""
with u as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r(rule_host, rule_path, rule_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f as (
  select p.page_id, p.host, p.path, max_by(rule_host || rule_path, length(rule_host || rule_path)) as rule,
         max_by(rule_verdict, length(rule_host || rule_path)) as rule_verdict
  from p left join r on (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path)
  group by p.page_id, p.host, p.path)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(rule_verdict, 'allow') as verdict from f
"""
