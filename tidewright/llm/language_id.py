"""Language ID by word-first backoff.

A word that the model knows adds its log frequency in each language. An unseen word is read through character
n-grams: at each place the longest known one, from `top` characters down to one, adds its log frequency. Words are runs of
letters (Unicode's category L) of the text in lower case, split in the same way for training and for prediction; an n-gram may hold the word's
edges, written as spaces.

Training reads at most about `sample` labelled rows of each language, chosen by a hash of their id within the language, so that
every labelled language is in the model; of these rows every word and every n-gram of every length up to `top` is kept. The sample is
the only bound on what is broadcast: each distinct word and n-gram takes 8 bytes, and 12 more for each language that has it. Words and
n-grams are keyed by 64-bit hashes; n of them have n*n/2**65 expected clashes.

Cases: text null or without a letter: `und`, score 0. No labelled row with a letter: every prediction is `und`. A language without a letter in its
sample is left out. Ties go to the language that comes first by name. Repeated rows are predicted one by one; other columns of the input
stay out of the way. Bytes that aren't UTF-8 count as no letters. Very long texts are read whole: working memory is about 60 times a text
that is longer than a slice of common.CHUNK bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, distinct_words, filtered, flat, mix, named, saved, tidy

SAMPLE, TOP = 2000, 4
LANGS = 1 << 16  # beyond so many languages, their shares are joined by shuffles
EVIDENCE = 10.0  # words whose evidence a score weighs at most, so that longer texts don't all end at 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts (bytes) in lower case with a space for every run of anything but letters, as bytes and offsets."""
    try:
        s = texts.cast(pa.string())
    except pa.ArrowInvalid:
        s = pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
    return flat(pc.replace_substring_regex(pc.utf8_lower(s), pattern=r"\P{L}+", replacement=" ").cast(pa.binary()))


def _key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points, each word between spaces, and the places of their starts with the end of all."""
    text = " " + "  ".join(w.decode("utf-8", "replace") for w in words) + " "
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.flatnonzero((code[:-1] == 32) & (np.append(np.uint64(32), code[:-2]) == 32)) if len(words) else np.zeros(0, np.int64)
    return code, np.append(start, len(code))


def _gram(code: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Keys of the k-grams at places."""
    h = np.full(len(at), k, np.uint64)
    for j in range(k):
        h = mix((h + code[at + j]) * _STEP)
    return h


def _grams(words: list[bytes], times: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of the words up to `top` characters, and how often each occurs."""
    code, start = _padded(words)
    size = np.diff(start)
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for k in range(1, top + 1):
        n = np.maximum(size - k + 1, 0)
        at = np.repeat(start[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys.append(_gram(code, at, k))
        counts.append(np.repeat(times, n))
    found, inv = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(inv, np.concatenate(counts), len(found)).astype(np.int64)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, top: int = TOP) -> dict:
    """The model: langs, and for words and grams sorted keys, where each one's languages are, and log(2c + 1) of its counts there."""
    rows = labelled.select(named(lang).alias("lang"), named(text).cast("binary").alias("text"), F.xxhash64(named(key).cast("string"), F.lit("sample")).alias("h")).filter(F.col("lang").isNotNull())
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("share"))
    share = saved(share, "shares")
    picked = rows.join(F.broadcast(share) if share.count() <= LANGS else share, "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            coded = b.column("lang").dictionary_encode()
            found, word, row = distinct_words(*letters(b.column("text")))
            pair, n = np.unique(coded.indices.to_numpy().astype(np.int64)[row] * max(1, len(found)) + word, return_counts=True)
            lang, word = np.divmod(pair, max(1, len(found)))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(lang)), pa.array([found[i] for i in word.tolist()], pa.binary()), pa.array(n.astype(np.int64))], ["lang", "word", "c"])
        tidy()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = b.column("lang").dictionary_encode()
            of, text, times = coded.indices.to_numpy(), b.column("word").to_pylist(), b.column("c").to_numpy()
            for i, name in enumerate(coded.dictionary.to_pylist()):
                mine = np.flatnonzero(of == i)
                keys, n = _grams([text[j] for j in mine.tolist()], times[mine], top)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "key", "c"])
        tidy()

    counts = saved(picked.mapInArrow(words, "lang string, word binary, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")), "words")
    ws = counts.toArrow()
    gs = counts.mapInArrow(grams, "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c")).toArrow()
    langs = sorted(set(ws.column("lang").to_pylist()))
    number = {x: i for i, x in enumerate(langs)}

    def table(keys: np.ndarray, of: pa.ChunkedArray, c: np.ndarray) -> dict:
        coded = of.combine_chunks().dictionary_encode()
        code = np.array([number[x] for x in coded.dictionary.to_pylist()], np.int32)
        lang = code[coded.indices.to_numpy()] if len(keys) else np.zeros(0, np.int32)
        order = np.lexsort((lang, keys))
        keys, lang, c = keys[order], lang[order], c[order]
        found, first = np.unique(keys, return_index=True)
        total = np.bincount(lang, c, len(langs))
        return {"keys": found, "first": np.append(first, len(keys)), "lang": lang, "value": np.log(2.0 * c + 1), "base": np.log(0.5 / (total + 1))}

    word_keys = np.fromiter((_key(w) for w in ws.column("word").to_pylist()), np.uint64, ws.num_rows)
    return {"langs": langs, "top": top, "words": table(word_keys, ws.column("lang"), ws.column("c").to_numpy()), "grams": table(gs.column("key").to_numpy().view(np.uint64), gs.column("lang"), gs.column("c").to_numpy())}


def _find(table: dict, keys: np.ndarray) -> np.ndarray:
    """The place of each key, or -1."""
    if not len(table["keys"]):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table["keys"], keys), len(table["keys"]) - 1)
    return np.where(table["keys"][at] == keys, at, -1)


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    n = last - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _backoff(model: dict, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, gram) of every n-gram that the words are read through."""
    code, start = _padded(words)
    at, end, who = start[:-1].copy(), start[1:], np.arange(len(words))
    of, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(who):
        step = np.ones(len(who), np.int64)
        left = np.arange(len(who))
        for k in range(model["top"], 0, -1):
            ask = left[at[left] + k <= end[who[left]]]
            got = _find(model["grams"], _gram(code, at[ask], k))
            hit = got >= 0
            of.append(who[ask[hit]])
            grams.append(got[hit])
            step[ask[hit]] = k
            done = np.zeros(len(who), bool)
            done[ask[hit]] = True
            left = left[~done[left]]
        at = at + step
        go = at < end[who]
        at, who = at[go], who[go]
    return np.concatenate(of), np.concatenate(grams)


def predictions(model: dict, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and the score of each text (bytes)."""
    n, langs = len(texts), model["langs"]
    found, word, row = distinct_words(*letters(texts))
    if not langs or not len(word):
        return ["und"] * n, np.zeros(n)
    w, g = model["words"], model["grams"]
    spot = _find(w, np.fromiter(map(_key, found), np.uint64, len(found)))
    known, unseen = np.flatnonzero(spot >= 0), np.flatnonzero(spot < 0)
    of, gram = _backoff(model, [found[i] for i in unseen.tolist()])
    of = unseen[of]
    # each distinct word's languages and values, word by word
    a, b = w["first"][spot[known]], w["first"][spot[known] + 1]
    c, d = g["first"][gram], g["first"][gram + 1]
    owner = np.concatenate([np.repeat(known, b - a), np.repeat(of, d - c)])
    order = np.argsort(owner, kind="stable")
    lang = np.concatenate([w["lang"][_spread(a, b)], g["lang"][_spread(c, d)]])[order]
    value = np.concatenate([w["value"][_spread(a, b)], g["value"][_spread(c, d)]])[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(found)))])
    pick = _spread(first[word], first[word + 1])
    cell = np.repeat(row, first[word + 1] - first[word]) * len(langs) + lang[pick]
    total = np.bincount(cell, value[pick], n * len(langs)).reshape(n, len(langs))
    total += np.bincount(row, (spot >= 0)[word], n)[:, None] * w["base"] + np.bincount(row, np.bincount(of, minlength=len(found))[word], n)[:, None] * g["base"]
    times = np.bincount(row, minlength=n)
    mean = total * (np.minimum(times, EVIDENCE) / np.maximum(times, 1))[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    best = p.argmax(axis=1)
    told = times > 0
    return [langs[i] if t else "und" for i, t in zip(best.tolist(), told.tolist(), strict=True)], np.where(told, p.max(axis=1) / p.sum(axis=1), 0.0)


def predict(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, if not given) with lang_pred and score, which replace columns of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    src = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(names)], named(text).cast("binary").alias("text"))
    schema = src.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            lang, score = predictions(shared.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], schema.names)
        tidy()

    return src.mapInArrow(run, schema).toDF(*names, "lang_pred", "score")


def identified(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The documents whose language is told, with their columns as they are; the others go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, text, lambda b: [x != "und" for x in predictions(shared.value, b.column("text"))[0]])
