"""URL filters by a sort-merge range join.

A rule (host, path, verdict) fits a url whose host is the rule's or a subdomain of it and whose path starts with the rule's. The longest fitting
rule decides (host and path together, then the longer host); no rule: `default`.

Canonical keys are the host's labels in reverse, "?", then the path ("?" stands in neither), so that a rule is the interval of keys that it
starts. A url has one key for each number of labels that some rule's host has, as a rule's path is counted from its own host. Keys are dealt
in ranges, whose borders come from a bounded sample and break ties by row, so a hot host or url is spread. A rule is copied to each range that its
interval meets. Each range is sorted, rules ahead of equal keys, and swept once with the stack of the rules that are active: what
doesn't start the current key is popped, the top is the longest. Memory is the stack: rules that start one another.

Cases: a null url, or one without "://", has an empty host and path and fits no rule; only A-Z are lowered; an empty label ("a..b", a trailing
dot) is a label like others; repeated rows stay, each judged; null ids stay; of rules with one host and path, the verdict that sorts last holds
(block before allow); a rule needs a host; without rules, or for an empty table, nothing is swept; urls of any length are keyed whole (borders
are cut, which only moves a border). Other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, saved

#: Rows of the sample for each range, and bytes of a border.
SAMPLE, BORDER = 32, 256
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def rule(said: str) -> Rule:
    """Such as "block example.org/es/"."""
    verdict, at = said.split(" ", 1)
    host, slash, path = at.partition("/")
    return Rule(verdict, host, slash + path)


#: The rules of the query. Fixed values.
RULES = [rule(x) for x in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """What follows the first "://", or nothing."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def _labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def _key(labels: Column, path: Column) -> Column:
    """labels: from the host's end."""
    return F.concat(F.array_join(labels, "."), F.lit("?"), path).cast("binary")


def _rule_table(pages: DataFrame, rules: DataFrame | Iterable[Rule]) -> DataFrame:
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    host = F.translate("host", _UPPER, _UPPER.lower())
    host = F.when(F.coalesce(F.length(host), F.lit(0)) == 0, F.raise_error(F.lit("a rule needs a host")).cast("string")).otherwise(host)
    each = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = _labels(F.col("host"))
    return saved(each.select("host", "path", "verdict", F.size(labels).alias("level"), _key(F.reverse(labels), F.col("path")).alias("key")), "rules")


def _dealt(rows: DataFrame, borders: list[tuple[bytes, int]], rules: bool) -> DataFrame:
    """The rows with the number of their range; a rule once for each range that its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, row = b.column("key").to_pylist(), b.column("row").to_pylist()
            low = [bisect_right(borders, x) for x in zip(keys, row, strict=True)]
            if not rules:
                yield b.append_column("part", pa.array(low, pa.int32()))
                continue
            high = [bisect_right(borders, (k + b"\xff", 0)) for k in keys]  # no UTF-8 has this byte
            at = [i for i, (a, z) in enumerate(zip(low, high, strict=True)) for _ in range(a, z + 1)]
            yield b.take(pa.array(at, pa.int64())).append_column("part", pa.array([p for a, z in zip(low, high, strict=True) for p in range(a, z + 1)], pa.int32()))

    return rows.mapInArrow(run, rows.select("*", F.lit(0).alias("part")).schema)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, level, rule) of each key that a rule starts; the rows come in order of (part, key, rules first)."""
    stack: list[tuple[bytes, dict]] = []
    last = None
    for b in batches:
        out: list[tuple] = []
        for part, key, row, level, it in zip(*(b.column(c).to_pylist() for c in ("part", "key", "row", "level", "rule")), strict=True):
            if part != last:
                stack, last = [], part
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if it is not None:
                stack.append((key, it))
            elif stack:
                out.append((row, level, stack[-1][1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], b.schema.field(c).type) for i, c in enumerate(("row", "level", "rule"))], ["row", "level", "rule"])


def judged(pages: DataFrame, rules: DataFrame | Iterable[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row; rule is null where none fits."""
    spark = pages.sparkSession
    of = _rule_table(pages, rules)
    levels = sorted(r[0] for r in of.select("level").distinct().collect())  # numbers of labels: 127 at most in real hosts
    seen = pages.select(named(key).alias("id"), host_of(named(url)).alias("host"), path_of(named(url)).alias("path"))
    if not levels:
        return seen.select(F.col("id").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    seen = saved(seen.withColumn("row", F.monotonically_increasing_id()), "urls")
    back = seen.select("row", "path", F.reverse(_labels(F.col("host"))).alias("labels"))
    probes = back.select("row", "path", "labels", F.explode(F.array(*map(F.lit, levels))).alias("level")).filter(F.size("labels") >= F.col("level"))
    probes = probes.select(_key(F.slice("labels", F.lit(1), F.col("level")), F.col("path")).alias("key"), "row", "level")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = probes.orderBy(F.xxhash64("row", "level")).select(F.substring("key", 1, BORDER), "row").limit(SAMPLE * parts).collect()
    drawn = sorted((bytes(k), r) for k, r in drawn)
    borders = sorted(set(drawn[SAMPLE // 2 :: SAMPLE]))[: parts - 1]

    one = F.struct("host", "path", "verdict")
    none = F.lit(None).cast("struct<host:string,path:string,verdict:string>")
    starts = _dealt(of.select("key", F.lit(-1).cast("long").alias("row"), "level", one.alias("rule")), borders, True)
    asked = _dealt(probes.select("key", "row", "level", none.alias("rule")), borders, False)
    swept = starts.unionByName(asked).repartitionByRange(parts, "part").sortWithinPartitions("part", "key", F.col("rule").isNull(), "row")
    best = swept.mapInArrow(_sweep, "row long, level int, rule struct<host:string,path:string,verdict:string>")
    size = F.length("rule.host") + F.length("rule.path")
    best = best.groupBy("row").agg(F.max_by("rule", F.struct(size, "level")).alias("best"))
    return seen.join(best, "row", "left").select(
        F.col("id").alias(key), "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
