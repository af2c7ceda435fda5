"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source with share p of all tokens gets weight p**a / sum(p**a). a = 1 keeps the shares, a smaller a flattens them.
Bisection finds the largest a in [0, 1] whose entropy reaches `entropy` times log(sources), then raises it, again by
bisection, to the least a at which no source is repeated more than `repeat` times. The budget, if not given, is the
least one that takes every source whole, so that mixing adds copies of small sources and drops nothing.

Each pass over a source is a block: a permutation of its documents by a hash of seed, block and id. Whole blocks
are followed by the start of one more, as far as the source's quota goes. Running sums are taken in two steps (over hash
buckets, then within a bucket), so that a source with most of the rows is spread over many tasks.

Cases: a null source is the source ''; null text has 0 tokens; a document without tokens is in every whole block and in
the last one if its place is within the quota; ties of the hash go by id; repeated rows are placed one by one (ties by
hash of their text). An empty table gives an empty result. Input columns may have any name: they are packed in a struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import named, saved

STEPS = 40


def shares(docs: DataFrame) -> DataFrame:
    """(source, n_docs, tokens) of (source, tokens)."""
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"))


def weights(sizes: DataFrame, entropy: float = 0.97, repeat: float = 2.0, budget: int | None = None) -> DataFrame:
    """(source, n_docs, tokens, exponent, weight, quota, epochs) in one small plan; the sources of one array."""
    packed = sizes.filter(F.col("tokens") > 0).agg(F.sort_array(F.collect_list(F.struct("source", "n_docs", "tokens"))).alias("s"))
    packed = packed.filter(F.size("s") > 0).withColumn("t", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])).withColumn("p", F.transform("s", lambda x: x["tokens"] / F.col("t")))
    fsum = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    powers = lambda a: F.transform("p", lambda p: F.pow(p, a))

    def entropy_of(a):  # log z - sum(q log q)/z, with q = p**a
        z = fsum(powers(a))
        return F.log(z) - fsum(F.transform("p", lambda p: F.pow(p, a) * F.log(p) * a)) / z

    def most_of(a):  # the largest weight over share, times the budget over all tokens
        ratio = F.transform("p", lambda p: F.pow(p, a - 1))
        scale = F.lit(budget) / F.col("t") / fsum(powers(a)) if budget else 1 / F.array_min(ratio)
        return F.array_max(ratio) * scale

    def bisect(low, good_low):
        """The border in [low, 1] between exponents for which good_low holds (below) and not."""
        step = lambda s: F.struct(F.when(good_low((s["lo"] + s["hi"]) / 2), (s["lo"] + s["hi"]) / 2).otherwise(s["lo"]).alias("lo"), F.when(good_low((s["lo"] + s["hi"]) / 2), s["hi"]).otherwise((s["lo"] + s["hi"]) / 2).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(low.alias("lo"), F.lit(1.0).alias("hi")), lambda s, _: step(s))

    goal = F.lit(float(entropy)) * F.log(F.size("s").cast("double"))
    out = packed.withColumn("a0", F.when(entropy_of(F.lit(1.0)) >= goal, F.lit(1.0)).otherwise(bisect(F.lit(0.0), lambda a: entropy_of(a) >= goal)["lo"]))
    out = out.withColumn("a", F.when(most_of(F.col("a0")) <= repeat, F.col("a0")).otherwise(bisect(F.col("a0"), lambda a: most_of(a) > repeat)["hi"]))
    out = out.withColumn("a", F.round("a", 9)).withColumn("z", fsum(powers(F.col("a"))))
    out = out.withColumn("budget", F.lit(budget).cast("long") if budget else F.ceil(F.round(F.array_max(F.transform("p", lambda p: F.col("t") * F.pow(p, 1 - F.col("a")) * F.col("z"))), 3)))
    out = out.select("t", "a", "z", "budget", F.explode("s").alias("x")).select("x.*", F.col("a").alias("exponent"), (F.pow(F.col("x.tokens") / F.col("t"), F.col("a")) / F.col("z")).alias("weight"), "budget")
    return out.withColumn("quota", F.floor(F.round(F.col("weight") * F.col("budget"), 3))).withColumn("epochs", F.col("quota") / F.col("tokens")).drop("budget")


def mix(docs: DataFrame, seed: int = 0, entropy: float = 0.97, repeat: float = 2.0, budget: int | None = None, hex_digits: int = 3, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(row, source, tokens, block, place): the input row as a struct, for every copy that the mix takes.

    Ordered by place within (source, block), a block is one permutation; 16**hex_digits buckets share its sums."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.size(words).cast("long").alias("tokens"))
    light = saved(docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.size(words).cast("long").alias("tokens")).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens")), "sizes")
    plan = saved(weights(light, entropy, repeat, budget), "weights")
    # one row a source: small by the number of sources, which is checked before it is broadcast
    few = plan.count() <= 100_000
    side = plan.select("source", F.col("tokens").alias("all_tokens"), "quota")
    rows = rows.join(F.broadcast(side) if few else side, "source", "left").withColumn("whole", F.coalesce(F.floor(F.col("quota") / F.col("all_tokens")), F.lit(1).cast("long")))
    place = lambda block: F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.col("key")).cast("binary"))
    full = rows.withColumn("block", F.explode(F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).otherwise(F.array().cast("array<bigint>")))).withColumn("place", place(F.col("block")))
    last = rows.filter(F.col("quota") > F.col("whole") * F.col("all_tokens")).withColumn("block", F.col("whole")).withColumn("place", place(F.col("block"))).withColumn("bucket", F.substring("place", 1, hex_digits))
    sums = saved(last.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")), "bucket_sums")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ahead = saved(sums.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("ahead")), "ahead")
    # buckets that the quota passes or takes whole need no order; only the one it ends in does
    upto = last.join(ahead.join(sums, ["source", "bucket"]), ["source", "bucket"]).withColumn("rest", F.col("quota") - F.col("whole") * F.col("all_tokens") - F.col("ahead")).filter(F.col("rest") >= 0)
    inside = upto.filter(F.col("rest") >= F.col("n"))
    within = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("place", "key", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, 0))
    cut = upto.filter(F.col("rest") < F.col("n")).withColumn("upto", within).filter(F.col("upto") <= F.col("rest"))
    cols = ["row", "source", "tokens", "block", "place"]
    return full.select(cols).unionByName(inside.select(cols)).unionByName(cut.select(cols))
