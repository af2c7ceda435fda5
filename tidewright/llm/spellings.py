"""Spelling variants: words that are one edit apart, and the form that each belongs to, by errata-trie merging.

The trie of all words is a table of steps: a word's prefixes, each known by its 128-bit hash, with the letter that follows ("" at the end). Counting the steps of
a node gives its subtrees' sizes, and its largest is the heavy one; the others are light. A word has at most log2(number of words) light
steps, and only words of light subtrees move (small to large): at each light step the word goes into the node's errata tree with that letter
replaced (by any letter: terminals of light subtrees that coincide differ there only; and by the heavy letter) or skipped, and with the
heavy letter put before it, which is the heavy subtree's word with its letter skipped. A terminal of an errata tree that is itself a word gives
a pair. Two words part at one node only, so each pair is found once.

Each tree's terminals are rows that are joined or grouped by their text, so no node is held by one task; a merged terminal has one word for each letter at the
place, 90 of the letters that are read. A chain of forms has at most 27 links, as counts grow by `ratio` at each; roots are found by doubling.

Cases: null text has no words; null ids count as empty text; repeated rows count each time; an empty table gives an empty result; of words of one length of
any size (a run of a million letters) only whole copies by light step are made, log2(number of words) of them; ties go to the smallest word
in code-point order. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, distinct_words, flat, lowered, named, saved, tidy

#: Distinct words that a task gathers before it passes them on.
GATHERED = 400_000
#: Words of more bytes have their checksums made one by one.
SHORT = 64

_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
_LATIN = 0xC3  # the first byte of U+00C0 to U+00FF in UTF-8, and of nothing else


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def letters(raw: np.ndarray) -> np.ndarray:
    """Marks the bytes of [A-Za-z] and U+00C0 to U+00FF."""
    ink = _LETTER[raw]
    if len(raw):
        lead = raw == _LATIN
        ink |= lead
        ink[1:] |= lead[:-1]
    return ink


def _checksums(heads: list[bytes], words: list[bytes], word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """crc32(heads[row] + words[word]) of each pair: a head's checksum is carried over the word's length once for all words of that length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    c = np.fromiter(map(zlib.crc32, heads), np.uint32, len(heads))
    over = np.empty((min(SHORT, int(size.max(initial=0))) + 1, len(heads)), np.uint32)
    for n in range(len(over)):
        over[n] = c
        c = (c >> 8) ^ _CRC[c & 255]
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    got = over[np.minimum(size[word], len(over) - 1), row] ^ own[word]
    for i in np.flatnonzero(size[word] > SHORT).tolist():
        got[i] = zlib.crc32(words[word[i]], zlib.crc32(heads[row[i]]))
    return got


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int = 0, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): runs of letters, A-Z lowered, of at least `shortest` code points that occur `least` times. damage: where it divides the crc32 h of
    "<key>:<run>", the run's code point h % length is left out first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for b in chunks(batches):
            raw, off = flat(b.column("text"))
            low = lowered(raw)
            words, word, row = distinct_words(low, off, letters(low))
            if not words:
                continue
            n = np.bincount(word, minlength=len(words))
            if damage:
                h = _checksums([f"{k}:".encode() for k in b.column("key").to_pylist()], words, word, row)
                for i in np.flatnonzero(h % damage == 0).tolist():
                    n[word[i]] -= 1
                    t = words[word[i]].decode()
                    at = int(h[i]) % len(t)
                    t = (t[:at] + t[at + 1 :]).encode()
                    found[t] = found.get(t, 0) + 1
            for w, c in zip(words, n.tolist(), strict=True):
                if c and len(w) >= shortest:
                    found[w] = found.get(w, 0) + c
            if len(found) > GATHERED:
                yield batch()
                found.clear()
        if found:
            yield batch()
            found.clear()
        tidy()

    src = docs.select(F.coalesce(named(key).cast("string"), F.lit("")).alias("key"), named(text).cast("binary").alias("text"))
    each = src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return each.filter((F.col("n") >= least) & (F.length("word") >= shortest))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node, at, letter, whole = [], [], [], []
        for w in b.column("word").to_pylist():
            h, key = xxhash.xxh3_128(), xxhash.xxh3_128_digest(w.encode())
            for d, c in enumerate((*w, "")):
                node.append(h.digest())
                at.append(d)
                letter.append(c)
                whole.append(key)
                h.update(c.encode())
                if len(node) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(at, pa.int32()), pa.array(letter), pa.array(whole, pa.binary())], ["node", "at", "letter", "whole"])
                    node, at, letter, whole = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(at, pa.int32()), pa.array(letter, pa.string()), pa.array(whole, pa.binary())], ["node", "at", "letter", "whole"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("whole", pa.array([xxhash.xxh3_128_digest(w.encode()) for w in b.column("word").to_pylist()], pa.binary()))


def light_steps(words: DataFrame) -> DataFrame:
    """(word, n, at, heavy): each step of a word out of a heavy path, `heavy` being the letter that the path goes on with."""
    steps = saved(words.select("word").mapInArrow(_steps, "node binary, at int, letter string, whole binary"), "steps")
    sizes = steps.groupBy("node", "letter").agg(F.count("*").alias("size"))
    heavy = F.max_by("letter", F.struct(F.col("letter") != "", "size", "letter"))
    nodes = sizes.groupBy("node").agg(heavy.alias("heavy"), F.count("*").alias("children")).filter("children > 1").select("node", "heavy")
    nodes = saved(nodes, "nodes")  # so that the root's steps, one a word, can be split in the join
    light = steps.join(nodes, "node").filter(F.col("letter") != F.col("heavy")).select("whole", "at", "heavy")
    keyed = words.select("word", "n").mapInArrow(_keys, "word string, n long, whole binary")
    return keyed.join(light, "whole").select("word", "n", "at", "heavy")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of words with a near one: their number, and the one of largest n as (lack, word), lack being -n."""
    light = saved(light_steps(words), "light")
    word, at, heavy = F.col("word"), F.col("at"), F.col("heavy")
    head, letter, tail = F.substr(word, F.lit(1), at), F.substr(word, at + 1, F.lit(1)), F.substr(word, at + 2)
    inside = letter != ""
    terminals = F.array(
        F.when(inside, F.concat(head, heavy, tail)),  # the letter replaced by the heavy one
        F.when(inside & ~F.startswith(tail, letter), F.concat(head, tail)),  # skipped; of a run of one letter, the last
        F.concat(head, heavy, letter, tail),  # the heavy subtree's word with its letter skipped
    )
    asked = light.select(word.alias("of"), F.col("n").alias("of_n"), F.explode(F.array_compact(terminals)).alias("word"))
    me, other = F.struct((-F.col("n")).alias("lack"), "word"), F.struct((-F.col("of_n")).alias("lack"), F.col("of").alias("word"))
    both = F.array(F.struct(F.col("word").alias("word"), other.alias("best")), F.struct(F.col("of").alias("word"), me.alias("best")))
    found = asked.join(words.select("word", "n"), "word").select(F.explode(both).alias("p")).select("p.word", F.lit(1).cast("long").alias("n_near"), "p.best")

    merged = light.filter(inside).groupBy(head.alias("head"), tail.alias("tail")).agg(F.array_sort(F.collect_list(me)).alias("all")).filter(F.size("all") > 1)
    merged = merged.select("all", F.explode("all").alias("one"))
    first: Column = F.get("all", F.lit(0))
    merged = merged.select("one.word", (F.size("all") - 1).cast("long").alias("n_near"), F.when(first["word"] == F.col("one.word"), F.get("all", F.lit(1))).otherwise(first).alias("best"))
    return found.unionByName(merged).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n), words being distinct. form: the near word of largest n, where that is at least `ratio` times the word's."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2: else forms may lead back")
    words = saved(words, "words")
    best = words.join(near_words(words), "word", "left")
    there = -F.col("best.lack") >= F.lit(ratio) * F.col("n")
    best = best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(there, F.col("best.word")).alias("form"), F.when(there, -F.col("best.lack")).alias("form_n"))
    best = saved(best, "forms")
    at = best.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(63 / log2(ratio)))):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = saved(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return best.join(at, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
