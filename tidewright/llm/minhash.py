"""Near-duplicates by b-bit MinHash, with every link confirmed on the full sets of word shingles.

1. One pass reads every whole text: words, distinct shingles (64-bit hashes), MINIMA minima. Of each minimum the low two
   bits are kept, packed in longs; the first BANDS * ROWS minima in bands are hashed to buckets. Documents with the same set form a
   class.
2. In each bucket every class meets one hub: the one that shares most buckets with others, as the text that copies were made
   from does. A pair goes on if its sizes allow the similarity and its estimate - matching bits, corrected for chance:
   J = (p - 1/4) / (3/4) - is no more than SLACK below the limit. Up to TRIES best hubs of a class are confirmed on the full sets.
   This links nearly all of a large group with a few pairs for each member.
3. What the hubs may have missed: buckets that still hold more than one component. In each such bucket, and only there, every pair of
   different components is estimated; members with a partner whose estimate passes go on with their sets, and those pairs are
   confirmed. A large bucket is cut in blocks, and each pair of blocks is a group by itself, so that no task holds more than two
   blocks at once; pairs are never rows, only the links found are. Nothing is capped, and buckets within one component need no pair.
4. Components: each label hooks to its least neighbour, pointers are halved, and edges between labels remain, until none do.

A shingle is a 64-bit hash of its words' hashes, a set's digest 128 bits; n distinct shingles have n*n/2**65 expected clashes, which
change an intersection by one. With J = 0.8 a pair shares no band with probability (1 - 0.8**rows)**bands, 5e-8 as set here; SLACK is five standard
deviations of the estimate.

Cases: null or empty text and text without words: an empty set, linked with nothing (component is the id itself).
Fewer words than a shingle: the whole sequence is one shingle. Equal texts and repeated rows share a class; a repeated
row has the same result in each copy. One id with several texts: each row goes with the class of its own text; a class is named by its
least id, and classes of one name count as linked. A null id is linked with nothing and has a null component. An empty table gives an empty result. Very long texts are
read whole, in working memory of about 60 times a text that is longer than common.CHUNK.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, flat, lowered, mix, named, saved, tidy, word_keys

BANDS, ROWS, BITS, MINIMA = 32, 4, 2, 256
SLACK, TRIES = 0.15, 4
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
SPREAD = 512  # members of a bucket that one task joins with its hub
PAIRS = 1 << 20  # pairs estimated at once
LONGS = T.ArrayType(T.LongType())
_ODD = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return x[:n] | np.uint64(1), x[n:]


def shingles(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and n+1 offsets of the rows in them."""
    t, row = word_keys(lowered(raw), off)
    n = len(off) - 1
    if not len(t):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    total = len(t)
    h = np.zeros(total, np.uint64)
    size = np.minimum(count, k)[row].astype(np.uint64)  # words in the shingles of this row
    for j in range(k):
        part = np.zeros(total, np.uint64)
        part[: total - j] = t[j:] * _ODD[j] if j else t * _ODD[0]
        h += np.where(size > j, part, np.uint64(0))
    h = mix(h + size * np.uint64(0xA0761D6478BD642F))
    keep = np.arange(total) < (first[:-1] + np.maximum(count - k + 1, np.minimum(count, 1)))[row]
    h, row = h[keep], row[keep]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(n + 1))


def minima(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(rows with shingles) x n minima, 32 bits each."""
    a, b = _seeds(n)
    start = at[:-1][np.diff(at) > 0]
    out = np.empty((len(start), n), np.uint64)
    v = np.empty_like(h)
    for j in range(n):
        np.multiply(h, a[j], out=v)
        v += b[j]
        v >>= np.uint64(32)
        out[:, j] = np.minimum.reduceat(v, start)
    return out


def digests(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """128 bits for each row's set, null if it is empty."""
    full = np.flatnonzero(np.diff(at))
    out: list[bytes | None] = [None] * (len(at) - 1)
    if len(full):
        two = np.stack([np.add.reduceat(x, at[:-1][full]) for x in (h, mix(h ^ np.uint64(0x5851F42D4C957F2D)))], axis=1).astype(">u8").tobytes()
        for k, i in enumerate(full.tolist()):
            out[i] = two[16 * k : 16 * k + 16]
    return pa.array(out, pa.binary())


def sketch(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(id, n, set, bits, buckets) of every row; set is a 128-bit digest of the shingle set, null if it is empty."""
    src = docs.select(named(key).alias("id"), named(text).cast("binary").alias("text"))
    schema = src.select("id").schema.add("n", "long").add("set", "binary").add("bits", LONGS).add("buckets", LONGS)
    n = MINIMA
    per = 64 // BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            h, at = shingles(*flat(b.column("text")), k)
            count = np.diff(at)
            full = np.flatnonzero(count)
            offsets = np.zeros(b.num_rows + 1, np.int32)
            bits = buckets = np.zeros(0, np.int64)
            if len(full):
                m = minima(h, at, n)
                low = (m & np.uint64((1 << BITS) - 1)).reshape(len(full), n // per, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
                bits = np.bitwise_or.reduce(low, axis=2).view(np.int64).ravel()
                g = m[:, : BANDS * ROWS].reshape(len(full), BANDS, ROWS)
                buckets = mix((g * _ODD[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[60]).view(np.int64).ravel()
            has = (count > 0).astype(np.int32)
            np.cumsum(has, out=offsets[1:])
            lists = [pa.ListArray.from_arrays(pa.array(offsets * w, pa.int32()), pa.array(x)) for w, x in ((n // per, bits), (BANDS, buckets))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(count), digests(h, at), *lists], schema.names)
        tidy()

    return src.mapInArrow(run, schema)


def hashed_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, set, shingles) of (id, text); set is the digest."""
    src = docs.select("id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            h, at = shingles(*flat(b.column("text")), k)
            yield pa.RecordBatch.from_arrays([b.column("id"), digests(h, at), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], ["id", "set", "shingles"])
        tidy()

    return src.mapInArrow(run, src.select("id").schema.add("set", "binary").add("shingles", LONGS))


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: the share of equal ones, corrected for those equal by chance."""
    odd = F.lit(0x5555555555555555)
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd)))
    chance = 0.5**BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


def _sized(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * intersection >= num * union."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared * den >= (F.size("sa") + F.size("sb") - shared) * num).select("a", "b")


def cluster_links(t: pa.Table, num: int, den: int, limit: float) -> pa.Table:
    """Links (a, b) between the components within a pair of blocks; a link that others already imply is left out."""
    ids, label, block = (t.column(c).to_pylist() for c in ("id", "label", "mine"))
    m = len(ids)
    n = t.column("n").to_numpy()
    bits = np.array(t.column("bits").to_pylist(), np.int64).view(np.uint64).reshape(m, -1)
    sets = [np.array(x, np.int64) for x in t.column("shingles").to_pylist()]
    code = {x: i for i, x in enumerate(dict.fromkeys(label))}
    up = list(range(len(code)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    values, times = np.unique(np.concatenate(sets), return_counts=True)
    values = values[times > 1]
    packed = None
    if m * len(values) <= 1 << 29:
        packed = np.zeros((m, -(-max(len(values), 1) // 64) * 8), np.uint8)
        for i, x in enumerate(sets):
            at = np.searchsorted(values, x)
            at = at[values[np.minimum(at, len(values) - 1)] == x] if len(values) else at[:0]
            row = np.zeros(packed.shape[1] * 8, np.uint8)
            row[at[at < len(values)]] = 1
            packed[i] = np.packbits(row)
        packed = packed.view(np.uint64)
    odd, chance = np.uint64(0x5555555555555555), 0.5**BITS
    most = MINIMA * (1 - chance - limit * (1 - chance))  # bits that may differ
    two = block[0] != block[-1] or len(set(block)) > 1
    of, side = np.array([code[x] for x in label]), np.array(block)
    out = []
    for i in range(m):
        js = np.arange(i + 1, m)
        js = js[(of[js] != of[i]) & ((side[js] != side[i]) if two else True)]
        js = js[np.minimum(n[js], n[i]) * den >= np.maximum(n[js], n[i]) * num]
        if not len(js):
            continue
        x = bits[js] ^ bits[i]
        js = js[np.bitwise_count((x | (x >> np.uint64(1))) & odd).sum(axis=1) <= most]
        js = [j for j in js if root(of[j]) != root(of[i])]
        if not js:
            continue
        if packed is not None:
            shared = np.bitwise_count(packed[js] & packed[i]).sum(axis=1, dtype=np.int64)
        else:
            shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in js])
        for j in np.array(js)[shared * den >= (n[js] + n[i] - shared) * num]:
            a, b = root(of[i]), root(of[j])
            if a != b:
                up[a] = b
                out.append((ids[i], ids[j]))
    kind = t.schema.field("id").type
    return pa.table([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], kind)], names=["a", "b"])


def partnered(dealt: DataFrame, num: int, den: int, limit: float) -> DataFrame:
    """The rows of groups (bucket, i, j) that have a partner there: of another label, and of another block where i and j differ, with sizes
    and an estimate that allow the similarity. Of the buckets that a pair shares only the first band's counts."""
    odd, chance = np.uint64(0x5555555555555555), 0.5**BITS
    most = MINIMA * (1 - chance - limit * (1 - chance))  # bits that may differ

    def able(rows: pa.Table) -> np.ndarray:
        """Of whole groups."""
        group, n, two = (np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")]), rows.column("n").to_numpy(), rows.column("i").to_numpy() != rows.column("j").to_numpy())
        block = rows.column("mine").to_numpy()
        label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        bits = np.array(rows.column("bits").combine_chunks().flatten()).view(np.uint64).reshape(len(n), -1)
        buckets = rows.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        first = np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0)))
        end = np.repeat(np.append(first[1:], len(n)), np.diff(np.append(first, len(n))))
        later = end - np.arange(len(n)) - 1
        upto = np.cumsum(later)
        out, x = np.zeros(len(n), bool), 0
        while x < len(n):
            y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + PAIRS, "right")))
            k = later[x:y]
            one = np.repeat(np.arange(x, y), k)
            other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(k) - k, k)
            go = (label[one] != label[other]) & ((block[one] != block[other]) | ~two[one])
            one, other = one[go], other[go]
            go = np.minimum(n[one], n[other]) * den >= np.maximum(n[one], n[other]) * num
            one, other = one[go], other[go]
            differ = np.zeros(len(one), np.int64)
            for c in range(bits.shape[1]):
                z = bits[one, c] ^ bits[other, c]
                differ += np.bitwise_count((z | (z >> np.uint64(1))) & odd)
            go = differ <= most
            one, other = one[go], other[go]
            for c in range(0, len(one), PAIRS >> 4):
                a, b = one[c : c + (PAIRS >> 4)], other[c : c + (PAIRS >> 4)]
                here = buckets[a, (buckets[a] == buckets[b]).argmax(axis=1)] == group[0, a]
                out[a[here]] = out[b[here]] = True
            x = y
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = [rows.column(c)[-1].as_py() for c in ("bucket", "i", "j")]
            whole = ~np.logical_and.reduce([rows.column(c).to_numpy() == v for c, v in zip(("bucket", "i", "j"), last, strict=True)])
            ready, held = rows.slice(0, int(whole.sum())), rows.slice(int(whole.sum()))
            if ready.num_rows:
                yield from ready.filter(pa.array(able(ready))).to_batches()
        if held is not None:
            yield from held.filter(pa.array(able(held))).to_batches()
        tidy()

    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, dealt.schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of an edge (a, b); the label is the smallest id reachable."""
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = saved(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("label")), "labels")
    while edges.count():
        up = edges.groupBy("a").agg(F.min("b").alias("to"))
        up = saved(up, "hooks")
        over = up.select(F.col("a").alias("to"), F.col("to").alias("over"))
        up = saved(up.join(over, "to", "left").select("a", F.coalesce("over", "to").alias("to")), "hooks")
        labels = saved(labels.join(up.withColumnRenamed("a", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        one = edges.join(up, "a", "left").select(F.coalesce("to", "a").alias("x"), "b")
        two = one.join(up.withColumnRenamed("a", "b"), "b", "left").select("x", F.coalesce("to", "b").alias("y")).filter("x <> y")
        edges = saved(two.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    # hooks taken in the last rounds may leave a label one step short
    while True:
        nxt = labels.join(labels.select(F.col("id").alias("label"), F.col("label").alias("up")), "label", "left").select("id", F.coalesce("up", "label").alias("new"), "label")
        nxt = saved(nxt, "labels")
        if not nxt.filter("new <> label").limit(1).count():
            return nxt.select("id", "label")
        labels = nxt.select("id", F.col("new").alias("label"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs: links at similarity num/den or more."""
    return _labelled(docs, k, num, den, key, text).drop("set")


def _labelled(docs: DataFrame, k: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """What near_duplicates() returns, with the digest of each row's shingle set."""
    all_rows = saved(sketch(docs, k, key, text), "sketches")
    classes = all_rows.filter(F.col("set").isNotNull() & F.col("id").isNotNull()).groupBy("set").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("buckets").alias("buckets"))
    classes = saved(classes, "classes")
    spread = lambda: classes.select("id", F.explode("buckets").alias("bucket"))
    shared = saved(spread().groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = saved(spread().join(shared, "bucket"), "members")
    weight = saved(members.groupBy("id").agg(F.sum("size").alias("weight")), "weights")
    _parts = F.expr(f"1 + size div {SPREAD}")
    hub = F.max(F.struct(F.col("weight"), F.xxhash64("id").alias("h"), F.col("id").alias("hub")))
    hubs = members.join(weight, "id").groupBy("bucket").agg(hub.alias("h"), F.max("size").alias("size"))
    hubs = saved(hubs.select("bucket", "h.hub", F.explode(F.sequence(F.lit(0).cast("long"), _parts - 1)).alias("part")), "hubs")
    mine = classes.select("id", "n", "bits", "buckets")
    info = lambda c: mine.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    limit = num / den - SLACK

    # members of a large bucket meet copies of its hub in several tasks
    pairs = members.withColumn("part", F.pmod(F.xxhash64("id"), _parts)).join(hubs, ["bucket", "part"]).filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = pairs.join(info("a"), "a").join(info("b"), "b").filter(_sized(F.col("n_a"), F.col("n_b"), num, den)).select("a", "b", estimate(F.col("bits_a"), F.col("bits_b")).alias("est")).filter(F.col("est") >= limit)
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("est"), "b"))
    pairs = saved(pairs.withColumn("r", best).filter(F.col("r") <= TRIES).select("a", "b"), "hub_pairs")
    need = weight.select("id")
    texts = docs.select(named(key).alias("id"), named(text).alias("text")).join(need, "id")
    sets = saved(hashed_sets(texts, k).dropDuplicates(["id", "set"]).join(classes.select("id", "set"), ["id", "set"], "left_semi").drop("set"), "sets")
    links = saved(confirm(pairs, sets, num, den), "links")
    labels = components(links)

    # buckets with more than one component
    told = mine.join(labels, "id", "left").select("id", "n", "bits", "buckets", F.coalesce("label", "id").alias("label"))
    placed = saved(members.select("id", "bucket").join(told.select("id", "n", "label"), "id"), "placed")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    open_ = saved(placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), blocks.alias("blocks")).filter("lo <> hi").select("bucket", "blocks"), "open")
    rest = saved(placed.select("bucket", "id").join(open_, "bucket"), "rest")
    dealt = rest.join(told, "id").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "label", "n", "bits", "buckets")
    able = saved(partnered(dealt, num, den, limit).drop("buckets"), "able")
    extra = able.join(sets, "id").groupBy("bucket", "i", "j")
    extra = saved(extra.applyInArrow(lambda t: cluster_links(t, num, den, limit), T.StructType([T.StructField("a", mine.schema["id"].dataType), T.StructField("b", mine.schema["id"].dataType)])), "more_links")
    if extra.limit(1).count():
        labels = components(links.unionByName(extra))
    by_set = saved(classes.select("set", "id").join(labels, "id", "left").select("set", F.coalesce("label", "id").alias("component")), "by_set")
    out = all_rows.select("id", "n", "set").join(by_set, "set", "left")
    component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), "set").withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, one of each component, with all their columns. Of repeated rows of a kept id with the same
    shingle set one stays; rows of one id with other sets are decided each by its own. Rows with a null id stay."""
    rows = saved(_labelled(docs, k, num, den, key, text).select(F.col(key).alias("id"), "set", "kept"), "labelled")
    many = saved(rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
    apart = saved(rows.filter("not kept").select("id").unionByName(many).distinct(), "dropped")
    left = docs.join(apart, named(key) == apart["id"], "left_anti").select([named(c) for c in docs.columns])
    whole = docs.select(F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("whole"), named(text).alias("body"))
    again = whole.join(many, F.col(f"whole.c{docs.columns.index(key)}") == many["id"], "left_semi")
    again = sketch(again, k, "whole", "body").select(F.col(f"id.c{docs.columns.index(key)}").alias("of"), "set", F.col("id").alias("whole"))
    good = rows.filter("kept").join(many, "id", "left_semi").select("id", F.col("set").alias("kept_set")).distinct()
    again = again.join(good, (F.col("of") == F.col("id")) & F.col("set").eqNullSafe(F.col("kept_set"))).dropDuplicates(["of", "set"])
    return left.union(again.select("whole.*").toDF(*docs.columns))
