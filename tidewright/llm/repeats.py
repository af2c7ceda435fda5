"""Removal of repeated strings by a sparse enhanced suffix array and its tree of common-prefix intervals.

Every `least`-byte window has an anchor: the place of its smallest GRAM-byte hash (the first of equals). Equal windows
have anchors at equal places, so all copies of a window meet under their anchor's gram, and only anchors' suffixes are
sorted. The windows of one anchor are a run of starts; their union is its span.

Pass 1 counts anchors' grams and puts the repeated ones in a Bloom filter of bounded size; if they are more than it can tell apart,
they stay a table and pass 2's spans are joined to it instead. Pass 2 lists the spans under repeated grams. A span that occurs twice
(by a 128-bit hash) is removed whole, with no comparison. Where a
gram has different spans, one copy of each is read from a text that has it; these form a bucket of the suffix array: sorted by what
follows the anchor, neighbours' common prefixes, a stack scan that yields the intervals of the tree, and in each interval the test of
what stands left: members are sorted by their reversed left sides, so each member's longest common left side within
the interval is at a neighbour. An interval whose right and left lengths reach `least` is a repeat, with all its members as
occurrences. Buckets with more than `crowd` spans are not sorted in one task: there every window of each span is hashed and counted.

The unit of results is the distinct text (by MD5), so equal texts share them and are joined back at the end.

Cases: null text is empty; texts shorter than `least` keep all their bytes; repeated rows count as occurrences of their text and
have equal results. An empty table gives an empty result. Matches never cross texts; overlapping occurrences count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, chunks, flat, mix, saved

LEAST, GRAM, CROWD = 200, 32, 4096
CHUNK_IN = 1 << 19
MOST_BITS, MOST_KEYS = 27, 1 << 24  # of the filter, and of the grams in it


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by prefix and suffix minima of blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    full = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


class Anchors:
    """Anchors of a slice of texts: text, gram hash, place, and first and last start of the anchor's windows."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, least: int = LEAST, gram: int = GRAM):
        self.raw, self.off = raw, off
        self.hash = Rolling(raw)
        n = len(raw)
        self.row = self.place = self.lo = self.hi = np.zeros(0, np.int64)
        self.gram = np.zeros(0, np.uint64)
        if n < least:
            return
        s = np.arange(n - gram + 1)
        g = self.hash(s, s + gram)
        order = ((g >> np.uint64(32)) << np.uint64(32)) | s.astype(np.uint64)
        best = (sliding_min(order, least - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        room = np.zeros(n - least + 2, np.int64)  # starts whose window ends in their text
        size = np.diff(off)
        long = size >= least
        np.add.at(room, off[:-1][long], 1)
        np.add.at(room, off[1:][long] - least + 1, -1)
        starts = np.flatnonzero(np.cumsum(room[:-1]) > 0)
        if not len(starts):
            return
        at = best[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        self.lo, self.place = starts[first], at[first]
        self.hi = starts[np.append(first[1:], len(starts)) - 1]
        self.gram = g[self.place]
        self.row = np.searchsorted(off, self.lo, "right") - 1
        self.least = least

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """A 128-bit hash (xxh3) of each span, as two numbers."""
        text = self.raw.tobytes()
        got = b"".join(xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(self.lo.tolist(), (self.hi + self.least).tolist(), strict=True))
        both = np.frombuffer(got, np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()

    def take(self, keep: np.ndarray) -> None:
        self.row, self.place, self.lo, self.hi, self.gram = (x[keep] for x in (self.row, self.place, self.lo, self.hi, self.gram))


class Bloom:
    """A set of 64-bit keys in at most 2**MOST_BITS bits, two of them a key."""

    def __init__(self, keys: DataFrame, column: str):
        n = keys.count()
        self.bits = int(min(MOST_BITS, max(16, np.ceil(np.log2(max(n, 1) * 24)))))
        mask = (1 << self.bits) - 1
        k = F.col(column)
        places = keys.select(F.explode(F.array(k.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(k, 32).bitwiseAND(F.lit(mask)).bitwiseXOR(k.bitwiseAND(F.lit(0xFFFF))))).alias("b"))
        rows = places.groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("v")).toArrow()
        self.words = np.zeros(1 << (self.bits - 5), np.uint32)
        self.words[rows.column("w").to_numpy()] = rows.column("v").to_numpy().astype(np.uint32)

    def has(self, g: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        out = np.ones(len(g), bool)
        for b in (g & mask, ((g >> np.uint64(32)) & mask) ^ (g & np.uint64(0xFFFF))):
            out &= ((self.words[(b >> np.uint64(5)).astype(np.int64)] >> (b & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).astype(bool)
        return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    hi = min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    lo = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the tree's inner nodes, deepest first within a branch; lcp[i] is that of suffixes i-1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        d, left = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > d:
            depth, left = stack.pop()
            yield depth, left, i - 1
        if not stack or stack[-1][0] < d:
            stack.append((d, left))


def repeats(rights: list[bytes], lefts: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Repeats among suffixes with their reversed left sides: (right length, [(suffix, left length)]).

    An interval whose members all continue alike to the left yields that longer string: what is tested is where left sides part."""
    if not rights:
        return
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [0] + [common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    for depth, i, j in intervals(lcp):
        inside = sorted(order[i : j + 1], key=lefts.__getitem__)
        side = [common(lefts[a], lefts[b]) for a, b in zip(inside, inside[1:], strict=False)]
        best = [max(a, b) for a, b in zip([0, *side], [*side, 0], strict=True)]
        if found := [(x, a) for x, a in zip(inside, best, strict=True) if a + depth >= least]:
            yield depth, found


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(tid, starts, ends) of each distinct text with repeats: merged byte ranges. docs: (tid, text)."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast

    def pass_1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", CHUNK_IN):
            g, n = np.unique(Anchors(*flat(b.column("text")), least, gram).gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.minimum(n, 2))], ["g", "n"])

    grams = docs.mapInArrow(pass_1, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1").select("g")
    grams = saved(grams, "grams")
    few = grams.count() <= MOST_KEYS
    first = send(Bloom(grams, "g")) if few else None

    def pass_2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", CHUNK_IN):
            a = Anchors(*flat(b.column("text")), least, gram)
            if first is not None:
                a.take(first.value.has(a.gram))
            if not len(a.gram):
                continue
            h1, h2 = a.spans()
            order = np.lexsort((a.row, h2, h1))
            h1, h2 = h1[order], h2[order]
            new = np.ones(len(order), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            f = np.flatnonzero(new)
            ends = np.append(f, len(order)).astype(np.int32)
            o = a.off[a.row[order]]
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (b.column("tid").take(pa.array(a.row[order])), pa.array((a.lo[order] - o).astype(np.int32)))]
            span = order[f]
            yield pa.RecordBatch.from_arrays([pa.array(a.gram[span].view(np.int64)), pa.array(h1[f].view(np.int64)), pa.array(h2[f].view(np.int64)), pa.array((a.hi - a.lo)[span].astype(np.int32) + least), pa.array((a.place - a.lo)[span].astype(np.int32)), pa.array(np.diff(ends).astype(np.int64)), *lists], ["g", "h1", "h2", "size", "at", "n", "tids", "los"])

    listed = docs.mapInArrow(pass_2, "g long, h1 long, h2 long, size int, at int, n long, tids array<binary>, los array<int>")
    listed = saved(listed if few else listed.join(grams, "g", "left_semi"), "spans")
    spans = saved(listed.groupBy("g", "h1", "h2", "size").agg(F.sum("n").alias("n")), "distinct_spans")
    several = spans.groupBy("g").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("g", "m")
    several = saved(several, "several")
    # one text that has the span; what a text is asked for is bounded by its own length
    sample = F.min(F.struct(F.col("tids")[0].alias("tid"), F.col("los")[0].alias("lo"), "size")).alias("o")
    asked = saved(listed.join(several, "g"), "asked").groupBy("g", "h1", "h2", "at").agg(sample)
    asked = asked.groupBy(F.col("o.tid").alias("tid")).agg(F.collect_list(F.struct("g", "h1", "h2", "at", "o.lo", "o.size")).alias("spans"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", CHUNK_IN):
            rows = [(x["g"], x["h1"], x["h2"], x["at"], text[x["lo"] : x["lo"] + x["size"]]) for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True) for x in spans]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["g", "h1", "h2", "at", "body"])

    copies = docs.join(saved(asked, "asked_of_texts"), "tid").select("text", "spans").mapInArrow(bodies, "g long, h1 long, h2 long, at int, body binary")
    copies = saved(copies.groupBy("g", "h1", "h2", "at").agg(F.first("body").alias("body")), "copies")
    copies = saved(copies.join(several, "g"), "buckets")  # of two written tables: a gram with very many spans can be split

    def bucket(t: pa.Table) -> pa.Table:
        body, at = t.column("body").to_pylist(), t.column("at").to_pylist()
        right, left = [x[i:] for x, i in zip(body, at, strict=True)], [x[:i][::-1] for x, i in zip(body, at, strict=True)]
        lo, hi = [0] * len(body), [0] * len(body)
        for depth, members in repeats(right, left, least):
            for x, a in members:  # all of them hold the anchor, so their union is one range
                lo[x], hi[x] = max(lo[x], a), max(hi[x], depth)
        rows = [x for x in range(len(body)) if hi[x]]
        return pa.table([t.column("h1").take(pa.array(rows, pa.int64())), t.column("h2").take(pa.array(rows, pa.int64())), pa.array([at[x] - lo[x] for x in rows], pa.int32()), pa.array([at[x] + hi[x] for x in rows], pa.int32())], names=["h1", "h2", "from", "to"])

    schema = "h1 long, h2 long, from int, to int"
    sorted_ = copies.filter(F.col("m") <= crowd).groupBy("g").applyInArrow(bucket, schema)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "body", CHUNK_IN >> 4):
            raw, off = flat(b.column("body"))
            n = np.diff(off) - least + 1
            row = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            s = off[row] + j
            w = [mix(Rolling(raw, k)(s, s + least)) for k in (0, 1)]
            h = [b.column(c).take(pa.array(row)) for c in ("h1", "h2")]
            yield pa.RecordBatch.from_arrays([*h, pa.array(j.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in w]], ["h1", "h2", "j", "w1", "w2"])

    crowded = copies.filter(F.col("m") > crowd)
    if crowded.limit(1).count():
        each = saved(crowded.select("h1", "h2", "body").mapInArrow(windows, "h1 long, h2 long, j int, w1 long, w2 long"), "windows")
        twice = saved(each.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"), "twice")
        counted = each.join(twice, ["w1", "w2"]).groupBy("h1", "h2").agg(F.min("j").alias("from"), (F.max("j") + least).cast("int").alias("to"))
        sorted_ = sorted_.unionByName(counted)
    # a span's windows that repeat are those of one range: each holds the anchor
    partial = saved(sorted_, "partial")
    whole = spans.filter("n > 1").select("h1", "h2", F.lit(0).alias("from"), F.col("size").alias("to"))
    cover = saved(whole.unionByName(partial.join(whole.select("h1", "h2"), ["h1", "h2"], "left_anti")), "cover")
    marked = listed.join(cover, ["h1", "h2"]).select(F.explode(F.arrays_zip("tids", "los")).alias("o"), "from", "to").select(F.col("o.tids").alias("tid"), (F.col("o.los") + F.col("from")).alias("s"), (F.col("o.los") + F.col("to")).alias("e"))
    # one row a text and task first; what a text gathers is bounded by its own length
    return saved(marked.groupBy("tid").agg(F.collect_set(F.struct("s", "e")).alias("ranges")), "ranges")


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]) of every row; spans are the removed runs."""
    src = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")).withColumn("tid", F.unhex(F.md5("text")))
    ranges = repeated_spans(src.filter(F.length("text") >= least).select("tid", "text"), least, gram, crowd)
    joined = src.join(ranges, "tid", "left").select("id", "text", F.col("ranges.s").alias("s"), F.col("ranges.e").alias("e"))
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if with_text else [])]
    schema = joined.select("id").schema
    for n, t in zip(names[1:], ("long", "long", "long", "string", "string", "binary"), strict=False):
        schema = schema.add(n, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", CHUNK_IN):
            rows = []
            for body, s, e in zip(b.column("text").to_pylist(), b.column("s").to_pylist(), b.column("e").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for x, y in sorted(zip(s, e, strict=True)) if s else []:
                    if runs and x <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], y)
                    else:
                        runs.append([x, y])
                kept = b"".join(body[x:y] for x, y in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(body)], strict=True))
                rows.append((len(body), len(body) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), ",".join(f"{x}:{y}" for x, y in runs), kept)[: len(names) - 1])
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()), strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], names)

    return joined.mapInArrow(run, schema).withColumnRenamed("id", key)
