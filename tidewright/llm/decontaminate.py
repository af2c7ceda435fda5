"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as bytes of a plain form: letters in lower case, every run of other ASCII characters one space.
An item of n such bytes has an edit budget e = min(rate * n, what leaves at least `floor` shared q-grams). By the
q-gram lemma a copy with at most e edits shares at least n - q + 1 - q * e q-grams with it, on diagonals at most
e apart; so diagonals are cut in overlapping bands of width 2e at steps of e, and a band that fewer of a text's q-grams hit holds no
copy. What is left is aligned: the whole item in the band and e diagonals on each side of it, many bands at once.

A q-gram's places in an item are kept in steps of e, so that one q-gram of a text hits an item n / e times at most, however often
the item repeats itself; a step hits all bands that any of its places would. Hits are counted in bounded slices.

The items are a stated query set: they are read in blocks of at most BLOCK bytes, each broadcast by itself, against
all documents. Items shorter than q + floor - 1 plain bytes are looked for with no edits.

Cases: null or empty text or item: no match. Items without letters or digits are skipped. Repeated rows of either table
are matched one by one. A null item id is an id like others. Of an item's matches in a text the one with the fewest edits counts, of these
the first. Extra columns stay as they are. Empty tables: no match, every document is kept. Very long texts: their plain form is matched in
overlapping windows, so working memory is about 60 times CHUNK_IN bytes, or the length of the longest item if that is more, and the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Rolling, chunks, filtered, flat, named, tidy

Q, RATE, FLOOR = 16, 0.05, 8
BLOCK = 4 << 20
HITS, CELLS = 2 << 20, 8 << 20  # hits counted at once, and bytes of text aligned at once
CHUNK_IN = 1 << 20
MERGED = 16  # bands side by side that are aligned at once

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
for _a, _b in ((48, 58), (97, 123)):
    _PLAIN[_a:_b] = np.arange(_a, _b)
_PLAIN[65:91] = np.arange(97, 123)


def plain(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The plain form of every row, with a space before each, and their places. Only at a row's end can a space be doubled."""
    n = len(off) - 1
    a = np.full(len(raw) + n + 1, 32, np.uint8)
    rows = np.repeat(np.arange(n), np.diff(off))
    a[np.arange(len(raw)) + rows + 1] = _PLAIN[raw]
    after = a[1:]
    latin = (a[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)  # capital letters of Latin-1
    after[latin] += 0x20
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 32) | (a[:-1] != 32)
    edge = off + np.arange(n + 1)  # the space before each row, and the last one
    keep[edge] = True
    upto = np.cumsum(keep)
    return a[keep], upto[edge] - 1


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[object, bytes]], q: int = Q, rate: float = RATE, floor: int = FLOOR):
        self.q = q
        texts = [t for _, t in items]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        body, at = plain(raw, off)
        self.ids, self.text, self.budget, self.need = [], [], [], []
        grams, posts, each = [], [], {}
        for i, (key, _) in enumerate(items):
            t = body[at[i] : at[i + 1] + 1].tobytes().strip()
            n = len(t)
            if not t:
                continue
            e = max(0, min(int(rate * n), (n - q + 1 - floor) // q))
            j = len(self.ids)
            self.ids.append(key)
            self.text.append(t)
            self.budget.append(e)
            self.need.append(max(1, n - q + 1 - q * e))
            if n >= q:
                s = np.arange(n - q + 1)
                g = each[j] = Rolling(np.frombuffer(t, np.uint8))(s, s + q)
                step = s // max(e, 1)
                order = np.lexsort((step, g))
                g, step = g[order], step[order]
                new = np.append(True, (g[1:] != g[:-1]) | (step[1:] != step[:-1]))
                grams.append(g[new])
                posts.append((np.int64(j) << 32) | step[new])
        self.short = [j for j, t in enumerate(self.text) if len(t) < q]
        self.longest = max(map(len, self.text), default=0) + max(self.budget, default=0)
        g = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(g, kind="stable")
        self.posts = np.concatenate([np.zeros(0, np.int64), *posts])[order]
        self.grams, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.grams)) * 32))))
        self.flags = np.zeros(1 << self.bits, bool)
        self.flags[self._slot(self.grams)] = True
        self.reach, self.lack = np.array(self.budget, np.int64), np.array(self.need, np.int64)
        self.own = [self._rarest(each.get(j), e) for j, e in enumerate(self.budget)]

    def _rarest(self, g: np.ndarray | None, e: int) -> tuple[int, int]:
        """The part of an item, 4e long, whose q-grams the fewest items have; the whole of a short item."""
        long = 4 * e
        if g is None or len(g) < 2 * long or not e:
            return 0, 0 if g is None else len(g) + self.q - 1
        upto = np.append(0, np.cumsum(self.count[np.searchsorted(self.grams, g)]))
        inside = long - self.q + 1 if long > self.q else 1
        a = int(np.argmin(upto[inside:] - upto[:-inside]))
        return a, min(a + long, len(g) + self.q - 1)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g >> np.uint64(64 - self.bits)).astype(np.int64)

    def _bands(self, s: np.ndarray, k: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, band) that enough q-grams hit: those at places s of the text's, of number k."""
        times = self.count[k]
        upto = np.cumsum(times)
        kept, a = [], 0
        least = int((self.posts & 0xFFFFFFFF).max(initial=0)) + 3
        span = int(s.max(initial=0)) + least + 1
        while a < len(s):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right")))
            spread = np.repeat(np.arange(a, b), times[a:b])
            nth = np.arange(len(spread)) - np.repeat(upto[a:b] - times[a:b] - (upto[a - 1] if a else 0), times[a:b])
            post = self.posts[self.first[k[spread]] + nth]
            item = post >> 32
            step = np.maximum(self.reach[item], 1)
            # places [p*step, (p+1)*step) lie on diagonals (s - (p+1)*step, s - p*step], and band b holds [b*step, (b+2)*step]
            high = s[spread] // step - (post & 0xFFFFFFFF)
            kept.append(np.unique((row[spread] * len(self.ids) + item) * span + high + least, return_counts=True))
            a = b
        if not kept:
            z = np.zeros(0, np.int64)
            return z, z, z
        keys, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        # a hit counts in the band of its number and the two before it; `least` leaves room for them in a pair's span
        keys, which = np.unique((keys[:, None] - np.arange(3)).ravel(), return_inverse=True)
        n = np.bincount(which.ravel(), np.repeat(n, 3))
        pair, band = np.divmod(keys, span)
        item = pair % len(self.ids)
        enough = n >= self.lack[item]
        return pair[enough] // len(self.ids), item[enough], band[enough] - least

    def match(self, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, edits, start) of the best match of each row and item; start is in the plain form."""
        if len(raw) <= 2 * CHUNK_IN:
            return self._match(*plain(raw, off))
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for r in range(len(off) - 1):
            body = long_plain(raw[off[r] : off[r + 1]])
            window = max(CHUNK_IN, 2 * self.longest)
            for a in range(0, max(1, len(body)), window):
                part = body[max(0, a - 1) : a + window + self.longest + 2]
                for _, i, d, p in self._match(part, np.array([0, len(part) - 1])):
                    found[r, i] = min(found.get((r, i), (d, p + max(0, a - 1))), (d, p + max(0, a - 1)))
        return [(r, i, d, p) for (r, i), (d, p) in sorted(found.items())]

    def _match(self, body: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        found: dict[tuple[int, int], tuple[int, int]] = {}
        whole, n = body.tobytes(), len(body)
        if n >= self.q and len(self.grams):
            s = np.arange(n - self.q + 1)
            g = Rolling(body)(s, s + self.q)
            s = s[self.flags[self._slot(g)]]
            g = g[s]
            k = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
            hit = self.grams[k] == g
            s, k = s[hit], k[hit]
            row = np.searchsorted(at, s, "right") - 1
            inside = (row < len(at) - 1) & (s + self.q <= at[np.minimum(row + 1, len(at) - 1)] + 1)
            row, item, band = self._bands(s[inside], k[inside], row[inside])
            pair = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])) if len(row) else np.zeros(0, bool)
            for r, i in zip(row[pair].tolist(), item[pair].tolist(), strict=True):
                if (p := whole.find(self.text[i], at[r], at[r + 1] + 1)) >= 0:
                    found[r, i] = (0, p - int(at[r]))
            number = np.cumsum(pair) - 1
            whole_copy = np.array([(r, i) in found for r, i in zip(row[pair].tolist(), item[pair].tolist(), strict=True)], bool)
            open_ = ~whole_copy[number] & (self.reach[item] > 0) if len(row) else pair
            row, item, band, many = _merged(row[open_], item[open_], band[open_])
            kinds = np.stack([self.reach[item], many])
            for e, m in np.unique(kinds, axis=1).T.tolist():
                mine = np.flatnonzero((kinds[0] == e) & (kinds[1] == m))
                size = max(1, CELLS // (max(len(self.text[i]) for i in item[mine].tolist()) + 2 * (m + 3) * e + 8))
                for c in range(0, len(mine), size):
                    part = mine[c : c + size]
                    low, first, last, width = band[part] * e - e, at[row[part]], at[row[part] + 1] + 1, (m + 3) * e + 1
                    # a copy's rarest part has no more edits than the copy, and what items share ends there
                    own = [self.own[i] for i in item[part].tolist()]
                    some, _ = align([self.text[i][a:b] for i, (a, b) in zip(item[part].tolist(), own, strict=True)], body, low + [a for a, _ in own], first, last, e, width)
                    part, low, first, last = (x[some <= e] for x in (part, low, first, last))
                    if not len(part):
                        continue
                    edits, start = align([self.text[i] for i in item[part].tolist()], body, low, first, last, e, width)
                    for r, i, d, p in zip(row[part].tolist(), item[part].tolist(), edits.tolist(), start.tolist(), strict=True):
                        if d <= e:
                            here = (d, p - int(at[r]))
                            found[r, i] = min(found.get((r, i), here), here)
        for i in self.short:
            t = b" " + self.text[i] + b" "
            p = whole.find(t)
            while p >= 0:
                r = int(np.searchsorted(at, p, "right") - 1)
                if p + len(t) <= at[r + 1] + 1:
                    found.setdefault((r, i), (0, p + 1 - int(at[r])))
                p = whole.find(t, p + 1)
        return [(r, i, d, p) for (r, i), (d, p) in sorted(found.items())]


def _merged(row: np.ndarray, item: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, first band, number of bands): runs of bands side by side as one, MERGED of them at most. A band alone is aligned on 4e diagonals, and
    each one more adds only e."""
    if not len(row):
        return row, item, band, band
    new = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1] + 1))
    place = np.arange(len(row)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.flatnonzero(place % MERGED == 0)
    return row[first], item[first], band[first], np.diff(np.append(first, len(row)))


def long_plain(raw: np.ndarray) -> np.ndarray:
    """The plain form of one long text, made from parts that end where a run of other characters starts."""
    out, a = [], 0
    while a < len(raw):
        b = a + CHUNK_IN
        while b < len(raw):
            other = np.flatnonzero(_PLAIN[raw[b : b + CHUNK_IN]] == 32)
            if len(other):
                b += int(other[0])
                break
            b += CHUNK_IN
        part = raw[a:b]
        out.append(plain(part, np.array([0, len(part)]))[0].tobytes().rstrip(b" "))
        a = b
    return np.frombuffer(b"".join(x for x in out if x) + b" ", np.uint8)


def align(items: list[bytes], body: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits between each whole item and a part of body[begin:end] on the `width` diagonals from `low`, and the part's start;
    more than `most` edits stand for none. A cell holds cost * scale + the diagonal it came from, so the least is the first of the best."""
    c = len(items)
    scale = 1 << width.bit_length()
    size = np.array([len(t) for t in items])
    order = np.argsort(-size, kind="stable")
    size, low, begin, end = size[order], low[order], begin[order], end[order]
    longest = int(size[0])
    letters = np.zeros((c, longest), np.uint8)
    for x, j in enumerate(order.tolist()):
        letters[x, : size[x]] = np.frombuffer(items[j], np.uint8)
    # what stands beside the text never matches: reading it costs as much as leaving out the item's letter
    place = low[:, None] + np.arange(longest + width)
    region = np.where((place >= begin[:, None]) & (place < end[:, None]), body.take(place, mode="clip"), np.uint8(0))
    kind = np.int32 if (most + 3) * scale < 1 << 31 else np.int64
    diagonal = np.arange(width, dtype=kind)
    cell = np.tile(diagonal, (c, 1))
    live = np.arange(c)
    edits, start = np.full(c, most + 1), np.zeros(c, np.int64)
    one, beyond = kind(scale), kind((most + 2) * scale)
    climb = diagonal * one
    for i in range(longest):
        n = int(np.searchsorted(-size[live], -i, "left"))  # items longer than i
        if n < len(live):
            _settle(cell[n:], live[n:], scale, edits, start)
            live, cell = live[:n], cell[:n]
        if not n:
            break
        if i % 8 == 0:
            some = cell.min(axis=1) < (most + 1) * scale
            if not some.all():
                live, cell = live[some], cell[some]
                if not len(live):
                    break
        best = cell + one * (region[live, i : i + width] != letters[live, i][:, None])
        np.minimum(best[:, :-1], cell[:, 1:] + one, out=best[:, :-1])
        best -= climb
        np.minimum.accumulate(best, axis=1, out=best)
        best += climb
        cell = np.minimum(best, beyond)
    else:
        _settle(cell, live, scale, edits, start)
    start = np.clip(low + start, begin, end)
    back = np.empty(c, np.int64)
    back[order] = np.arange(c)
    return edits[back], start[back]


def _settle(cell: np.ndarray, live: np.ndarray, scale: int, edits: np.ndarray, start: np.ndarray) -> None:
    least = cell.min(axis=1)
    edits[live], start[live] = least // scale, least % scale


def blocks(items: DataFrame, key: str = "item_id", text: str = "text", size: int = BLOCK) -> Iterator[list[tuple[object, bytes]]]:
    """The query set, a bounded block at a time: blocks are dealt by hash, and split again if one comes out too large."""
    rows = items.select(named(key).alias("key"), named(text).cast("binary").alias("text")).filter(F.length("text") > 0).withColumn("h", F.xxhash64("text", "key"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // size)) if total > size else 1
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod("h", F.lit(n)) == k)
        yield [(r["key"], bytes(r["text"])) for r in part.select("key", "text").orderBy("key", "text").toLocalIterator()]


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc key, item key, edits, budget, start) of every document and item that match."""
    spark = docs.sparkSession
    out = None
    src = docs.select(named(key).alias("key"), named(text).cast("binary").alias("text"))
    item_type = to_arrow_type(items.schema[item_key].dataType)
    schema = src.select("key").schema.add("item", items.schema[item_key].dataType).add("edits", "long").add("budget", "long").add("start", "long")
    for block in blocks(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of = shared.value
            for b in chunks(batches, "text", CHUNK_IN):
                if got := of.match(*flat(b.column("text"))):
                    yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array([x[0] for x in got])), pa.array([of.ids[x[1]] for x in got], item_type), *[pa.array(c, pa.int64()) for c in ([x[2] for x in got], [of.budget[x[1]] for x in got], [x[3] for x in got])]], schema.names)
            tidy()

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"key": key, "item": item_key})


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that match no item, with all their columns, in one pass a block."""
    spark = docs.sparkSession
    for block in blocks(items, item_key, item_text):
        shared = spark.sparkContext.broadcast(Index(block))

        def free(b: pa.RecordBatch, shared=shared) -> list[bool]:
            hit = {x[0] for x in shared.value.match(*flat(b.column("text")))}
            return [r not in hit for r in range(b.num_rows)]

        docs = filtered(docs, text, free, CHUNK_IN)
    return docs
