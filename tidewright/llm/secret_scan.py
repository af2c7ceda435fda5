"""Secret scans through an incremental blob ledger, in DataFrame functions only.

Every version of a path is content-addressed by the SHA-256 of its text. The ledger holds, for each blob and rule
version scanned so far, the findings (an empty list if there are none). A run scans only the pairs of blob and rule
version that the ledger lacks, adds them, and joins findings back to every path that has the blob.

Positions are code points, end exclusive. A rule's matches are leftmost and not overlapping; `least` drops matches
whose group is shorter. As split() gives the text between matches, starts are running sums, without searching again.

Cases: null text counts as empty and has no findings; equal texts share one scan; repeated rows stay; an empty table
gives an empty result; columns of the input other than the key and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in the order in which ties are listed. Fixed values.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),  # the same runs as + with shorter ones dropped, without listing each short run
)
#: What this scanner adds to them.
ADDED = (
    Rule("forge", 1, r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED


def versions(df: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, text) of every historical version."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(path).alias("path"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("blob"), t.alias("text"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, version, spans) for every blob and rule, from one pass over (blob, text)."""
    found = blobs.select("blob", *[F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias(f"m{i}") for i, r in enumerate(rules)], "text")
    per_rule = []
    for i, r in enumerate(rules):
        m = F.col(f"m{i}")
        gaps = F.transform(F.split("text", r.pattern, -1), F.length)
        sizes = F.transform(m, F.length)
        kept = F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), F.length) if r.group else sizes
        per_rule.append(F.when(F.size(m) > 0, F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), kept.alias("kept")).alias("hits"))))
    listed = F.filter(F.array(*per_rule), lambda x: x.isNotNull())
    # a blob may stand twice if its row is repeated: one of its rows, already without the text, is enough
    hits = found.select("blob", F.explode(listed).alias("x")).select("blob", "x.*").dropDuplicates(["blob", "rule", "version"])
    rows = hits.select("blob", "rule", "version", "least", F.posexplode("hits").alias("at", "h")).filter(F.col("h.size").isNotNull())
    w = Window.partitionBy("blob", "rule", "version").orderBy("at")
    end = F.sum(F.col("h.gap") + F.col("h.size")).over(w).cast("long")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("h.size")).filter(F.col("h.kept") >= F.col("least"))
    return rows.groupBy("blob", "rule", "version").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def update(seen: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after `seen` (from versions()): (blob, rules, findings). `rules` lists what was scanned, as name:version.

    With a ledger, a blob is scanned by just those rules that its entry lacks."""
    spark = seen.sparkSession
    ids = [f"{r.name}:{r.version}" for r in rules]
    first = seen.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        have = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("have"))
        first = first.join(have, "blob", "left").withColumn("lack", F.array_except(F.array(*map(F.lit, ids)), F.coalesce("have", F.array().cast("array<string>")))).drop("have").filter(F.size("lack") > 0)
    else:
        first = first.withColumn("lack", F.array(*map(F.lit, ids)))
    first = saved(first, "unseen")
    texts = seen.filter(F.col("text") != "").alias("s").join(first.alias("f"), (F.col("s.blob") == F.col("f.blob")) & F.col("s.path").eqNullSafe(F.col("f.path"))).select("s.blob", "s.text", "f.lack")
    out = None
    groups = [tuple(ids)] if ledger is None else [tuple(r["lack"]) for r in first.select("lack").distinct().limit(1 << len(rules)).collect()]
    for lack in groups:  # the sets of lacking rules: as many as there are histories of the rule list
        part = scan(texts.filter(F.col("lack") == F.array(*map(F.lit, lack))) if ledger is not None else texts, tuple(r for r in rules if f"{r.name}:{r.version}" in lack))
        out = part if out is None else out.unionByName(part)
    by_blob = F.collect_list(F.struct("rule", "version", "spans"))
    empty = "array<struct<rule:string,version:int,spans:array<struct<start:bigint,end:bigint>>>>"
    if out is None:
        entries = first.select("blob", F.col("lack").alias("rules"), F.array().cast(empty).alias("findings"))
    else:
        found = saved(out.groupBy("blob").agg(by_blob.alias("findings")), "found")
        entries = first.join(found, "blob", "left").select("blob", F.col("lack").alias("rules"), F.coalesce("findings", F.array().cast(empty)).alias("findings"))
    entries = entries.withColumn("findings", F.col("findings").cast(empty))
    return saved(entries if ledger is None else ledger.unionByName(entries), "ledger")


def findings(seen: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, rule, start, end) rows of every path that has a blob with findings."""
    flat = ledger.select("blob", F.explode("findings").alias("x")).select("blob", "x.rule", "x.version", F.explode("x.spans").alias("s")).select("blob", "rule", "version", "s.start", "s.end")
    return seen.select("path", "blob").join(flat, "blob").drop("blob")


def digest(seen: DataFrame, ledger: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each path: counts and digests of the base rules, and all spans."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    items = F.flatten(F.transform("findings", lambda x: F.transform(x["spans"], lambda s: F.struct(s["start"].alias("start"), rank[x["rule"]].alias("k"), x["rule"].alias("rule"), s["end"].alias("end")))))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")

    def count(i: int) -> Column:
        return F.size(F.filter("all", lambda s: s["k"] == i)).cast("long")

    by = ledger.filter(F.size("findings") > 0).select("blob", F.sort_array(items).alias("all"))
    by = by.select("blob", *[count(i).alias(f"n_{r.name}") for i, r in enumerate(base)], text(F.filter("all", lambda s: s["k"] < len(base))).alias("base"), text(F.col("all")).alias("spans"))
    by = saved(by, "digests")
    out = seen.select("path", "blob").join(by, "blob", "left")
    return out.select("path", *[F.coalesce(f"n_{r.name}", F.lit(0).cast("long")).alias(f"n_{r.name}") for r in base], F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
