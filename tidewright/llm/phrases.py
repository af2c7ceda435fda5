"""Phrase collocations from compressed position bitmaps.

Texts are cut into pieces and words, and packed into shards of one language. In a shard every word has a bitmap of its positions, kept as its
non-empty bytes and the gaps between them; pieces are set apart by a position that no word has. Shifting a phrase's bitmap by one and ANDing it with
a word's gives the longer phrase's bitmap, its popcount the count in the shard; counts are summed over the shards. Nothing crosses a piece, as its
next position is empty.

Three passes: words; pairs of words that are frequent in the whole corpus; then, depth-first from each shard's frequent pairs, phrases of three
words and more whose neighbouring pairs are all frequent. A shard's extension handles a batch of phrases against the bitmaps of the bytes they
reach, and goes down before it goes on, so a batch of each length is held at most. What is frequent comes back to a shard by joins,
never as a broadcast.

A phrase's cut after k words has the counts l and r of its parts, score floor(2000000 * a / (l + r)); the lowest cut counts, of equals the
first. A candidate goes where a longer one holds its words in a row and has at least 80 % of its count. Sums and products are decimals of
38 digits.

Cases: a null text is empty; a null language is `und`; a piece without words gives nothing; repeated rows count each time; a phrase that
overlaps itself counts each time; an empty table gives an empty result; a text longer than a shard is a shard of its own, and very long words are
words. Ties in rank go by count, then by the phrase's bytes. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, chunks, distinct_words, lowered, named, release, saved, tidy, words

#: Bytes of text in a shard, and of all languages' texts that a task holds back for shards.
SHARD, HELD = 6 << 20, 24 << 20
#: Pairs of bitmap bytes that are ANDed at once, and phrases' bytes in a batch.
PAIRS, BATCH = 1 << 22, 1 << 18

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_APART = _BREAK.copy()
_APART[[32, 9]] = True
_BITS = np.array([i.bit_count() for i in range(256)], np.uint8)
_FAR = 255  # a gap of so many bytes or more is kept apart


class Bitmaps:
    """Bitmaps of ids 0..: (id, place, bits) of their non-empty bytes, by id and place."""

    def __init__(self, of: np.ndarray, place: np.ndarray, bits: np.ndarray):
        self.of, self.place, self.bits = of, place, bits

    @classmethod
    def of_positions(cls, of: np.ndarray, at: np.ndarray) -> Bitmaps:
        """at: each id's positions, rising. A position belongs to one id."""
        place, order = at >> 3, np.argsort(of, kind="stable")
        of, place, at = of[order], place[order], at[order]
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (place[1:] != place[:-1])) if len(of) else np.zeros(0, bool))
        bits = np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first) if len(of) else np.zeros(0, np.uint8)
        return cls(of[first], place[first], bits)

    def packed(self, n: int) -> tuple[np.ndarray, bytes, bytes, bytes]:
        """Of n ids: non-empty bytes of each; the gaps before them, their bits, and the gaps that a byte doesn't hold, end to end."""
        new = np.append(True, self.of[1:] != self.of[:-1]) if len(self.of) else np.zeros(0, bool)
        gap = self.place - np.where(new, 0, np.append(0, self.place[:-1]))
        far = gap >= _FAR
        return np.bincount(self.of, minlength=n), np.where(far, _FAR, gap).astype(np.uint8).tobytes(), self.bits.tobytes(), gap[far].astype("<u4").tobytes()

    def popcounts(self, n: int) -> np.ndarray:
        return np.bincount(self.of, _BITS[self.bits], n).astype(np.int64)

    @classmethod
    def unpacked(cls, size: np.ndarray, gaps: bytes, bits: bytes, far: bytes) -> Bitmaps:
        """What packed() gives."""
        gap = np.frombuffer(gaps, np.uint8).astype(np.int64)
        gap[gap == _FAR] = np.frombuffer(far, "<u4")
        total = np.cumsum(gap)
        before = np.append(0, total)[np.cumsum(size) - size]
        return cls(np.repeat(np.arange(len(size)), size), total - np.repeat(before, size), np.frombuffer(bits, np.uint8))

    def only(self, keep: np.ndarray) -> Bitmaps:
        return Bitmaps(self.of[keep], self.place[keep], self.bits[keep])

    def shifted(self) -> Bitmaps:
        """Every bit one position on; what leaves a byte is an entry of the next."""
        over = self.bits >> 7
        out = np.flatnonzero(over)
        new = Bitmaps(np.append(self.of, self.of[out]), np.append(self.place, self.place[out] + 1), np.append(self.bits << 1, over[out]))
        return new.only(new.bits != 0)


class Words:
    """A shard's words by the bytes of positions they have bits in."""

    def __init__(self, of: Bitmaps):
        order = np.argsort(of.place, kind="stable")
        self.word, self.bits, place = of.of[order], of.bits[order], of.place[order]
        last = int(place[-1]) if len(place) else -1
        self.first = np.searchsorted(place, np.arange(last + 3))  # one place more: bits that leave the last byte
        self.last = last

    def extended(self, of: Bitmaps) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(index, word, place, bits) where the shifted bitmaps, by the number of their entry's id, AND a word's bitmap are not empty."""
        s = of.shifted()
        s = s.only(s.place <= self.last)
        there = self.first[s.place + 1] - self.first[s.place]
        upto = np.cumsum(there)
        a = 0
        while a < len(there):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            left = np.repeat(np.arange(a, b), there[a:b])
            right = np.arange(len(left)) + np.repeat(self.first[s.place[a:b]] - (upto[a:b] - there[a:b]) + (upto[a - 1] if a else 0), there[a:b])
            both = s.bits[left] & self.bits[right]
            hit = np.flatnonzero(both)
            left, right = left[hit], right[hit]
            yield s.of[left], self.word[right], s.place[left], both[hit]
            a = b


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint8),)


def grown(words: Words, of: Bitmaps, n_words: int, allowed: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Bitmaps]:
    """(parent, word, count) of the phrases one word longer, and their bitmaps. allowed: sorted keys last word * n_words + word of the pairs
    that may follow; last: each phrase's last word."""
    kept = []
    for of_, word, place, bits in words.extended(of):
        if allowed is not None:
            key = last[of_] * n_words + word
            at = np.minimum(np.searchsorted(allowed, key), max(len(allowed) - 1, 0))
            ok = allowed[at] == key if len(allowed) else np.zeros(len(key), bool)
            of_, word, place, bits = of_[ok], word[ok], place[ok], bits[ok]
        kept.append((of_, word, place, bits))
    of_, word, place, bits = _joined(kept)
    key, which = np.unique(of_ * n_words + word, return_inverse=True)
    order = np.lexsort((place, which))
    maps = Bitmaps(which[order], place[order], bits[order])
    n = np.bincount(which, _BITS[bits], len(key)).astype(np.int64)
    return key // max(n_words, 1), key % max(n_words, 1), n, maps


_BITMAPS = "sizes array<int>, gaps binary, bits binary, far binary"


def shards(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(shard, lang, words, counts, and the words' bitmaps end to end), a written table with a row a shard."""

    def build(lang: str, texts: list[bytes], number: int) -> pa.RecordBatch:
        low, off = lowered(np.frombuffer(b"".join(texts), np.uint8)), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        ink = ~_APART[low]
        found, word, _ = distinct_words(low, off, ink)
        start, _, row = words(low, off, ink)
        cuts = np.cumsum(_BREAK[low])[start] if len(start) else start
        new = np.append(False, (row[1:] != row[:-1]) | (cuts[1:] != cuts[:-1])) if len(start) else np.zeros(0, bool)
        maps = Bitmaps.of_positions(word, np.arange(len(word)) + np.cumsum(new))
        shard = (TaskContext.get().partitionId() << 32) + number
        sizes, gaps, bits, far = maps.packed(len(found))
        return _row(shard=shard, lang=lang, words=[w.decode() for w in found], counts=maps.popcounts(len(found)), sizes=sizes, gaps=gaps, bits=bits, far=far)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        number = count()
        for b in chunks(batches, size=CHUNK):
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if t:
                    held.setdefault(name, []).append(t)
                    size[name] = size.get(name, 0) + len(t)
                    if size[name] >= SHARD:
                        yield build(name, held.pop(name), next(number))
                        del size[name]
            while sum(size.values()) > HELD:
                name = max(size, key=size.get)
                yield build(name, held.pop(name), next(number))
                del size[name]
        for name in list(held):
            yield build(name, held.pop(name), next(number))
        tidy()

    src = docs.select(F.coalesce(named(lang), F.lit("und")).alias("lang"), named(text).cast("binary").alias("text"))
    return saved(src.mapInArrow(run, f"shard long, lang string, words array<string>, counts array<long>, {_BITMAPS}"), "shards")


_KINDS = {"lang": pa.string(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "shard": pa.int64(), "sizes": pa.list_(pa.int32()), "gaps": pa.binary(), "bits": pa.binary(), "far": pa.binary()}


def _row(**cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], _KINDS[c]) for c, v in cells.items()], list(cells))


def _packed(b: pa.RecordBatch | pa.Table, i: int = 0) -> tuple[np.ndarray, bytes, bytes, bytes]:
    return b.column("sizes")[i].values.to_numpy().astype(np.int64), *[b.column(c)[i].as_py() for c in ("gaps", "bits", "far")]


def _kept(t: pa.Table, mine: pa.Table) -> pa.Table:
    """A shard's row with only its frequent words, which are known by their ids."""
    if not t.num_rows or not mine.num_rows:
        return pa.Table.from_batches([_row(shard=0, ids=[], sizes=[], gaps=b"", bits=b"", far=b"").slice(0, 0)])
    at = np.argsort(mine.column("place").to_numpy())
    place, ids = mine.column("place").to_numpy()[at], mine.column("id").to_numpy()[at]
    size, gaps, bits, far = _packed(t)
    stays = np.zeros(len(size), bool)
    stays[place] = True
    stay = np.repeat(stays, size)
    gaps, bits, far = np.frombuffer(gaps, np.uint8), np.frombuffer(bits, np.uint8), np.frombuffer(far, "<u4")
    row = _row(shard=t.column("shard")[0].as_py(), ids=ids, sizes=size[place], gaps=gaps[stay].tobytes(), bits=bits[stay].tobytes(), far=far[stay[gaps == _FAR]].tobytes())
    return pa.Table.from_batches([row])


def _index(b: pa.RecordBatch | pa.Table, i: int = 0) -> tuple[np.ndarray, Bitmaps]:
    """Ids of a shard's words, and their bitmaps by their place among them."""
    return b.column("ids")[i].values.to_numpy(), Bitmaps.unpacked(*_packed(b, i))


def _frequent(rows: DataFrame, by: tuple[str, ...], least: int) -> DataFrame:
    """The shards' rows of what is frequent over all shards, with f: one shuffle, as a shard has one row for each."""
    return rows.withColumn("f", F.sum("n").over(Window.partitionBy(*by))).filter(F.col("f") >= least)


def counts(of: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Of shards(), which goes with this: the frequent words (id, lang, word, f) and the frequent phrases (ids, f) of 2 to `longest` words, written."""
    each = of.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    each = each.select("shard", "lang", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"), F.monotonically_increasing_id().alias("row"))
    each = each.withColumn("id", F.min("row").over(Window.partitionBy("lang", "word")))  # one of its rows names a word
    first = F.col("row") == F.col("id")
    each = saved(_frequent(each, ("lang", "word"), least).select("shard", "place", "id", F.when(first, F.col("lang")).alias("lang"), F.when(first, F.col("word")).alias("word"), "f"), "frequent")
    vocabulary = saved(each.filter("word is not null").select("id", "lang", "word", "f"), "vocabulary")
    mine = of.select("shard", "sizes", "gaps", "bits", "far").groupBy("shard").cogroup(each.select("shard", "place", "id").groupBy("shard"))
    mine = saved(mine.applyInArrow(_kept, f"shard long, ids array<long>, {_BITMAPS}"), "bitmaps")
    release(of.sparkSession, of, each)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, maps = _index(b, i)
                x, y, n, _ = grown(Words(maps), maps, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), b.column("shard")[i].as_py())), *map(pa.array, (ids[x], ids[y], n))], ["shard", "x", "y", "n"])
        tidy()

    two = saved(_frequent(mine.mapInArrow(pairs, "shard long, x long, y long, n long"), ("x", "y"), least).select("shard", "x", "y", "f"), "pairs")

    release(of.sparkSession)
    names = [f"w{i}" for i in range(longest)]

    def deeper(t: pa.Table, p: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64())] * (longest + 1), [*names, "n"])
        if not t.num_rows or not p.num_rows:
            return none
        ids, maps = _index(t)
        order = np.argsort(ids)
        local = lambda c: order[np.searchsorted(ids[order], p.column(c).to_numpy())]
        allowed = np.sort(local("x") * len(ids) + local("y"))
        # the words that a frequent pair has here; others can't be in a longer phrase
        used = np.zeros(len(ids), bool)
        used[local("x")] = used[local("y")] = True
        maps = maps.only(used[maps.of])
        index, out = Words(maps), []
        stack = [(np.arange(len(ids))[:, None], maps)]  # phrases, by the numbers of their words, and their bitmaps
        while stack:
            of_, maps = stack.pop()
            if len(maps.of) > BATCH and maps.of[0] != maps.of[-1]:  # down with the first half first
                mid = maps.of[len(maps.of) // 2]
                mid = mid if mid > maps.of[0] else mid + 1
                stack += [(of_, maps.only(maps.of >= mid)), (of_, maps.only(maps.of < mid))]
                continue
            up, word, n, maps = grown(index, maps, len(ids), allowed, of_[:, -1])
            of_ = np.column_stack([of_[up], word])
            if of_.shape[1] > 2 and len(n):
                none_there = [pa.nulls(len(n), pa.int64())] * (longest - of_.shape[1])
                out.append(pa.table([*map(pa.array, ids[of_].T), *none_there, pa.array(n)], [*names, "n"]))
            if of_.shape[1] < longest and len(n):
                stack.append((of_, maps))
        return pa.concat_tables(out) if out else none

    phrases = two.select(F.array("x", "y").alias("ids"), "f").distinct()
    if longest > 2:
        more = mine.groupBy("shard").cogroup(two.select("shard", "x", "y").groupBy("shard")).applyInArrow(deeper, ", ".join(f"{c} long" for c in (*names, "n")))
        more = more.groupBy(*names).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        phrases = phrases.unionByName(more.select(F.array_compact(F.array(*names)).alias("ids"), "f"))
    phrases = saved(phrases, "phrases")
    release(of.sparkSession, mine, two)
    return vocabulary, phrases


def _exact(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def scored(vocabulary: DataFrame, phrases: DataFrame, longest: int = 4, scale: int = 2_000_000, share: int = 80) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one holds."""
    known = vocabulary.select(F.array("id").alias("ids"), "f").unionByName(phrases)
    cut = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    cut = cut.join(known.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    cut = cut.withColumns({"scale": _exact(F.lit(scale)) * _exact(F.col("a")), "both": _exact(F.col("l")) + _exact(F.col("r"))}).withColumn("score", F.expr("cast(scale div both as long)"))
    best = cut.groupBy("ids").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("ids", "c.*")

    n = F.size("ids")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.slice("ids", i, m))))
    over = phrases.filter(n > 2).select("f", F.explode(inner).alias("ids")).groupBy("ids").agg(F.max("f").alias("over"))
    best = best.join(over, "ids", "left").filter(F.col("over").isNull() | (_exact(F.col("over")) * 100 < _exact(F.col("a")) * share))

    out = best.withColumn("phrase", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    for i in range(longest):  # a word after another
        word = vocabulary.select(F.col("id").alias("at"), F.col("word").alias("next"), F.col("lang").alias("of"))
        out = out.withColumn("at", F.get("ids", F.lit(i))).join(word, "at", "left")
        out = out.withColumns({"phrase": F.concat_ws(" ", "phrase", "next"), "lang": F.coalesce("lang", "of")}).drop("at", "next", "of")
    return out.select("lang", "phrase", "a", "l", "r", "score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score; n counts all words of the language."""
    of = shards(docs, text, lang)
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    all_ = saved(of.groupBy("lang").agg(F.sum(n).alias("n")), "languages")
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    got = scored(*counts(of, least, longest), longest, share=share).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    # the first of each part, then of these: no task orders a whole language
    got = got.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    got = got.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return got.join(all_, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
