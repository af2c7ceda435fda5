"""LM scoring by prediction by partial matching over bytes.

Training counts every (order+1)-gram of every training text, in one pass with sums inside each task and then by key; the
written table of grams is the model, with every context that occurs and nothing cut. Symbol 0 stands before and after a text,
byte b is symbol b+1. A context's distribution is PPM's: seen symbols share by escape method D, what is left goes to the
distribution of the context that is one shorter, with the symbols seen here excluded. As a symbol seen after a context is seen
after its suffix too, a seen symbol's probability is its own share, and any other symbol's is that of the suffix times one number
for each context, its back-off: so the trie's rows are sparse and tables of counts are all that scoring needs.

Texts are written in blocks (a slice of a task's texts) with the lists of their distinct grams and words, so that what is in all
texts is one row a block. The grams of all blocks meet the model's by their last two symbols of context, whose subtree of longer
contexts is scored in one task; orders 0 and 1 (257 x 257 counts, whatever the corpus) are broadcast. Each block gets its grams'
log10 back by a join and sums them for each text: its bytes, A-Z in lower case, and its end.

word_scores() adds the add-one unigram score of words, joined back by block in the same way. Words are keyed by 64-bit hashes; n
distinct words have n*n/2**65 expected clashes.

Cases: null text is empty: its score is that of the end alone, and its only token is the end. No training text: uniform
predictions, every count 0. Repeated rows are scored one by one. A null id counts as training text.

build() and score() are the same model as a dense trie in memory, over classes of symbols; tests hold the tables against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chunks, flat, lowered, saved, tidy, word_keys

ORDER = 5
SIZE, CLASSES = 257, 64
CHUNK_IN, BLOCK = 3 << 19, 32 << 20  # bytes of text handled at once, and in a block with its lists of words and grams
_END = np.uint64(0x1D8E4E27C47D124F)  # the key of the end token


@dataclass
class Model:
    child: np.ndarray  # (nodes + 1, CLASSES): the node of one more symbol of context, or 0
    log10: np.ndarray  # (nodes + 1, CLASSES)
    order: int
    classes: np.ndarray  # of each symbol
    inside: np.ndarray  # log10 of a symbol's share of its class


@dataclass
class Grams:
    table: DataFrame  # (gram, c): every (order+1)-gram of the training texts
    order: int


def symbols(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as symbols with a 0 before each and after the last; places of the zeros."""
    n = len(off) - 1
    edge = off + np.arange(n + 1)
    seq = np.zeros(len(raw) + n + 1, np.int64)
    inner = np.ones(len(seq), bool)
    inner[edge] = False
    seq[inner] = lowered(raw).astype(np.int64) + 1
    return seq, edge


def _back(seq: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For each place but the first, the symbols 1 to `order` before it; what is before a 0 is 0."""
    n, over = len(seq), None
    for j in range(1, order + 1):
        s = np.zeros(n - 1, seq.dtype)
        s[j - 1 :] = seq[: max(n - j, 0)]
        if over is not None:
            s[over] = 0
        over = s == 0
        yield s


def places(raw: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order+1)-gram of each place, as a number to the base 257 with the predicted symbol last, and where texts start."""
    seq, edge = symbols(raw, off)
    made, m = {1: seq}, 1  # the last m symbols of each place, whatever they are
    while m <= order:
        more = 1 << (min(m, order + 1 - m).bit_length() - 1)
        key = made[m].copy()
        key[m:] += made[more][: max(len(seq) - m, 0)] * SIZE**m
        if not (order + 1) & m:
            del made[m]
        m += more
        made[m] = key
    key = made[m][1:]
    # places that reach back over a 0: what is before it is 0
    near = np.unique((edge[:, None] + np.arange(1, order + 1)).ravel())
    near = near[near < len(seq)]
    if len(near):
        some, scale, on = seq[near], 1, np.ones(len(near), bool)
        for j in range(1, order + 1):
            scale *= SIZE
            s = np.where(on, seq[np.maximum(near - j, 0)], 0)
            on = s > 0
            some += s * scale
        key[near - 1] = some
    return key, edge[:-1]


def grams(raw: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (order+1)-grams and their counts."""
    return np.unique(places(raw, off, order)[0], return_counts=True)


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, c) of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in chunks(batches, "text", CHUNK_IN):
            held.append(grams(*flat(b.column("text")), order))
            n += len(held[-1][0])
            if n > 2_500_000:
                held = [merged(held)]
                n = len(held[0][0])
                if n > 1_500_000:
                    yield batch(*held.pop())
                    n = 0
        if held:
            yield batch(*merged(held))

    def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        g, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order_ = np.argsort(g, kind="stable")
        g, c = g[order_], c[order_]
        first = np.flatnonzero(np.diff(g, prepend=-1))
        return g[first], np.add.reduceat(c, first)

    def batch(g: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(c.astype(np.int64))], ["gram", "c"])

    src = texts.select(F.col("text").cast("binary").alias("text"))
    splits = src.rdd.getNumPartitions()  # four splits a task, while all cores have one: fewer sums of the same gram
    parts = src.coalesce(max(1, min(splits, texts.sparkSession.sparkContext.defaultParallelism), splits // 4)).mapInArrow(run, "gram long, c long")
    return parts.groupBy("gram").agg(F.sum("c").alias("c"))


def train(texts: DataFrame, order: int = ORDER) -> Grams:
    """A model of (text); every text counts."""
    return Grams(saved(count_grams(texts, order), "grams"), order)


def shares(k: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The distributions of contexts with counts k, one a row; `below` has their suffixes'."""
    seen, total = k > 0, k.sum(1, keepdims=True)
    d = seen.sum(1, keepdims=True)
    rest = np.where(seen, 0.0, below)
    left = rest.sum(1, keepdims=True)
    own = np.where(seen, (k - 0.5) / np.maximum(total, 1), 0.0)
    escape = np.where(total > 0, d / (2 * np.maximum(total, 1)), 1.0)
    return np.where(left > 1e-12, own + escape * rest / np.maximum(left, 1e-300), own / np.maximum(own.sum(1, keepdims=True), 1e-300))


def _whole(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What the shares of a context's seen symbols are divided by: nothing escapes where all symbols are seen."""
    return np.where(d == SIZE, n - SIZE / 2, n)


def _at(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each of `what` in the sorted `where`, and whether it is there."""
    at = np.minimum(np.searchsorted(where, what), max(0, len(where) - 1))
    return at, (where[at] == what) if len(where) else np.zeros(len(what), bool)


def subtree(gram: np.ndarray, c: np.ndarray, order: int, first: np.ndarray, log10: np.ndarray) -> np.ndarray:
    """log10 of each gram's last symbol. gram: distinct, with all that share two symbols of context with any of them; c: counts in
    training, or 0; first, log10: counts and probabilities of all symbols after each symbol."""
    out = log10[gram // SIZE % SIZE, gram % SIZE].copy()
    known, times = gram[c > 0], c[c > 0].astype(np.float64)
    shorter = None
    for j in range(2, order + 1):
        key, inv = np.unique(known % SIZE ** (j + 1), return_inverse=True)
        if not len(key):
            break
        count = np.bincount(inv, times)
        start = np.flatnonzero(np.diff(key // SIZE, prepend=-1))
        context, n, d = key[start] // SIZE, np.add.reduceat(count, start), np.diff(start, append=len(key))
        if shorter is None:
            under, suffix = first[key // SIZE % SIZE, key % SIZE], first[context % SIZE]
            whole = _whole(suffix.sum(1), (suffix > 0).sum(1))
        else:
            under = shorter[1][_at(shorter[0], key % SIZE**j)[0]]
            whole = shorter[3][_at(shorter[2], context % SIZE ** (j - 1))[0]]
        left = (whole - np.add.reduceat(under, start) + d / 2) / whole  # of the suffix's distribution, without what is seen here
        mine = _whole(n, d)
        own = np.log10((count - 0.5) / np.repeat(mine, d))
        down = np.log10(d / (2 * n)) - np.log10(np.where(d == SIZE, 1.0, left))
        ask = gram % SIZE ** (j + 1)
        node, there = _at(context, ask // SIZE)
        out[there] += down[node[there]]
        entry, there = _at(key, ask)
        out[there] = own[entry[there]]
        shorter = key, count, context, mine
    return out


def points(model: Grams, asked: DataFrame) -> DataFrame:
    """(gram, points): log10 of the last symbol of each distinct (gram) asked for."""
    top = model.table.groupBy((F.col("gram") % SIZE**2).alias("k")).agg(F.sum("c").alias("c")).toArrow()  # at most 257 * 257 rows
    first = np.zeros(SIZE * SIZE)
    first[top.column("k").to_numpy()] = top.column("c").to_numpy()
    first = first.reshape(SIZE, SIZE)
    zero = shares(first.sum(0)[None, :], np.full((1, SIZE), 1.0 / SIZE))
    log10 = np.log10(np.maximum(shares(first, zero) if model.order else np.repeat(zero, SIZE, 0), 1e-300))
    shared, order = asked.sparkSession.sparkContext.broadcast((first, log10)), model.order
    every = model.table.select("gram", "c", F.lit(False).alias("asked")).unionByName(asked.select("gram", F.lit(0).cast("long").alias("c"), F.lit(True).alias("asked")))
    every = every.groupBy("gram").agg(F.sum("c").alias("c"), F.max("asked").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.Table.from_batches(rows)
        gram, c, wanted = (rows.column(x).to_numpy() for x in ("gram", "c", "asked"))
        got = subtree(gram, c, order, *shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(gram[wanted]), pa.array(got[wanted])], ["gram", "points"])

    # every context of two symbols is whole in one task; hashed, as nearby numbers would meet in few tasks
    return every.repartition(F.expr(f"gram div {SIZE}L % {SIZE**2}L")).mapInArrow(run, "gram long, points double")


def build(j: np.ndarray, context: np.ndarray, s: np.ndarray, c: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The trie of (order, context, symbol, count) entries."""
    key = np.unique(np.stack([j, context], 1), axis=0) if len(j) else np.zeros((0, 2), np.int64)
    key = key[key[:, 0] > 0]
    n = len(key) + 1
    at = {(0, 0): 0} | {(int(a), int(b)): i + 1 for i, (a, b) in enumerate(key)}
    child = np.zeros((n, CLASSES), np.int32)
    count = np.zeros((n, CLASSES), np.float64)
    node = np.array([at[int(a), int(b)] for a, b in zip(j, context, strict=True)], np.int64)
    if len(node):
        np.add.at(count, (node, s.astype(np.int64)), c)
    p = np.full((n, CLASSES), 1.0 / CLASSES)

    def fill(rows: np.ndarray, below: np.ndarray) -> None:
        p[rows] = shares(count[rows], below)

    fill(np.array([0]), np.full((1, CLASSES), 1.0 / CLASSES))
    for o in range(1, order + 1):
        rows = np.flatnonzero(key[:, 0] == o) + 1
        if not len(rows):
            continue
        ctx = key[rows - 1, 1]
        last = CLASSES ** (o - 1)
        parents = np.array([at[o - 1, int(x % last)] for x in ctx], np.int64)
        child[parents, ctx // last] = rows
        for i in range(0, len(rows), 1024):
            fill(rows[i : i + 1024], p[parents[i : i + 1024]])
    return child, np.log10(np.maximum(p, 1e-300)).astype(np.float32)


def score(model: Model, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """log10 probability of each text with its end."""
    n = len(off) - 1
    if not n:
        return np.zeros(0)
    seq, edge = symbols(raw, off)
    child, node, alive = model.child.ravel(), np.zeros(len(seq) - 1, np.int32), None
    folded = model.classes[seq].astype(np.int32)
    for s in _back(folded, model.order):
        nxt = child[node * np.int32(CLASSES) + s]
        go = nxt > 0
        alive = go if alive is None else alive & go
        node = np.where(alive, nxt, node)
    got = model.log10.ravel()[node * np.int32(CLASSES) + folded[1:]] + model.inside[seq[1:]]
    return np.add.reduceat(got, edge[:-1])


def _hashed(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of texts and, after them, of the texts' ends; each one's row."""
    h, row = word_keys(low, off)
    h = np.concatenate([h, np.full(len(off) - 1, _END)])
    return h.view(np.int64), np.concatenate([row, np.arange(len(off) - 1)])


def listed_blocks(docs: DataFrame, order: int, key: str, text: str, held: Column) -> DataFrame:
    """For each block rows of its texts and one row of its distinct words with training counts and its distinct grams."""
    src = docs.select(F.col(key).alias("id"), held.alias("held"), F.col(text).cast("binary").alias("text"))
    of = lambda t: T.ArrayType(t)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", of(src.schema["id"].dataType)), T.StructField("held", of(T.BooleanType())), T.StructField("texts", of(T.BinaryType())), T.StructField("keys", of(T.LongType())), T.StructField("train", of(T.LongType())), T.StructField("grams", of(T.LongType()))])

    arrow = [f.type for f in to_arrow_schema(schema)][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        parts, size, k = [], 0, 0
        for b in chunks(batches, "text", CHUNK_IN):
            raw, off = flat(b.column("text"))
            h, row = _hashed(lowered(raw), off)
            coded = pa.array(h).dictionary_encode()
            keys, inv = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            held = np.array(b.column("held").to_pylist(), bool)
            parts.append((keys, np.bincount(inv[~held[row]], minlength=len(keys)), grams(raw, off, order)[0]))
            yield one(base + k, b.column("id"), b.column("held"), b.column("text"), None, None, None)
            size += len(raw)
            if size >= BLOCK:
                yield lists(base + k, parts)
                parts, size, k = [], 0, k + 1
        if parts:
            yield lists(base + k, parts)

    def lists(number: int, parts: list[tuple]) -> pa.RecordBatch:
        """The words and grams of all slices of a block."""
        keys, train, found = zip(*parts, strict=True)
        every, inv = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inv, np.concatenate(train), len(every)).astype(np.int64)
        return one(number, None, None, None, pa.array(every), pa.array(total), pa.array(np.unique(np.concatenate(found))))

    def one(number: int, *columns: pa.Array | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.nulls(1, t) if x is None else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x, t in zip(columns, arrow, strict=True)]], schema.names)

    return src.mapInArrow(run, schema)


def word_scores(docs: DataFrame, model: Grams, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    order = model.order
    blocks = saved(listed_blocks(docs, order, key, text, held), "blocks")
    listed = blocks.select(F.explode(F.arrays_zip("keys", "train")).alias("x")).select(F.col("x.keys").alias("k"), F.col("x.train").alias("c"))
    vocab = saved(listed.filter("c > 0").groupBy("k").agg(F.sum("c").alias("c")), "vocabulary")
    total = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    got = saved(points(model, blocks.select(F.explode("grams").alias("gram"))), "points")
    # counts of words are above 0, log10 of grams are not: that tells them apart
    known = blocks.select("block", F.explode("keys").alias("k")).join(vocab, "k").select(F.col("block").alias("of"), "k", F.col("c").cast("double").alias("value"))
    scored = blocks.select("block", F.explode("grams").alias("gram")).join(got, "gram").select(F.col("block").alias("of"), F.col("gram").alias("k"), F.col("points").alias("value"))
    texts = blocks.filter(F.col("texts").isNotNull()).select("block", "ids", "held", "texts")
    schema = T.StructType([T.StructField("id", blocks.schema["ids"].dataType.elementType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(found: pa.Table, block: pa.Table) -> pa.Table:
        ids, held, body = (block.column(c).combine_chunks().flatten() for c in ("ids", "held", "texts"))
        k, value = found.column("k").to_numpy(), found.column("value").to_numpy()
        word = value > 0
        keys, listed = pa.array(k[word]), pa.array(k[~word])
        counts, logs = np.append(value[word], 0.0), np.append(value[~word], np.nan)
        shares_ = np.log10(counts + 1.0) - np.log10(n + v + 1.0)
        spot = lambda x, among: pc.fill_null(pc.index_in(pa.array(x), among), -1).to_numpy()
        sums = []
        for b in chunks([pa.RecordBatch.from_arrays([body], ["text"])], "text", CHUNK_IN):
            raw, off = flat(b.column("text"))
            h, row = _hashed(lowered(raw), off)
            token = spot(h, keys)
            place, start = places(raw, off, order)
            by_row = lambda x: np.bincount(row, x, b.num_rows)  # noqa: E731, B023
            sums.append((np.bincount(row, minlength=b.num_rows), by_row(counts[token] > 0).astype(np.int64), by_row(shares_[token]), np.add.reduceat(logs[spot(place, listed)], start)))
        tokens, hits, base, score_ = map(np.concatenate, zip(*sums, strict=True))
        return pa.table([ids, held, pa.array(tokens.astype(np.int64)), pa.array(hits), pa.array(np.full(len(ids), n, np.int64)), pa.array(base), pa.array(score_)], names=schema.names)

    return known.unionByName(scored).groupBy("of").cogroup(texts.groupBy("block")).applyInArrow(run, schema).withColumnRenamed("id", key)
