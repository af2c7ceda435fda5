"""Token-ID output: texts as ids of a public tokenizer, in files of separately coded blocks (see id_codec).

Texts are dealt by ranges of (id, hash of the text, row), so that equal ids too are spread, and sorted; each task writes files of
about FILE_IDS ids, one after another, under names of its attempt. Files end between texts; only a text longer than a file goes on in the
next one. A table lists the files of tasks that ended well; their order gives every text its place among all ids. Reading checks each
block's checksum.

Encoding: a tokenizer's pre-tokens are encoded one by one, so a text is split as the tokenizer splits it and each distinct
piece, told apart by its bytes, is encoded once by the library's model. The split is done on bytes, for texts of ASCII and Latin-1
letters without what looks like a contraction or a special token; other texts go to the library whole. This holds for byte-level BPE
with the usual split pattern and no added prefix space; Tokens checks that the file says so, and otherwise leaves every text to the library.

Cases: null text is empty: its only id is the end. Repeated rows are written one by one. A null id comes first. An empty
table gives an empty result. Very long texts: working memory is about 30 times CHUNK_IN bytes and does not follow a text's length, as a longer text is
encoded in parts, cut where the tokenizer splits in any case; only a text that goes to the library whole, or has no space before a
letter, needs memory by its length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import id_codec
from .common import chunks, flat, named, new_path, saved, tidy
from .warc import filesystem

END = 0
FILE_IDS = 4 << 20
PART, LEAST_PART = 256 << 20, 8 << 20  # bytes of text in a task; in one of a small table
CACHE_IDS, PIECES = 4 << 20, 1_000_000  # what a worker keeps of pieces met
CHUNK_IN = 4 << 20

# classes of bytes: 0 letter, 1 digit, 2 other, 3 white space, 4 not decided here
_CLASS = np.full(256, 4, np.uint8)
_CLASS[33:127] = 2
_CLASS[48:58] = 1
_CLASS[65:91] = _CLASS[97:123] = 0
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_KIND = _CLASS.tobytes()
_SHORT = np.zeros(256, bool)
_SHORT[list(b"stmdrvl")] = True  # what may follow the apostrophe of a contraction



def _letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones of Latin-1 stand for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _kinds(raw: np.ndarray) -> np.ndarray:
    """The class of every byte."""
    return np.frombuffer(bytearray(raw).translate(_KIND), np.uint8)


class Known:
    """Numbers of pieces from 0 on. Pieces are told apart by their bytes: one of at most 16, none of them zero, is two integers, which a table
    of open places leads to; longer ones are in a dict."""

    MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self):
        self.a, self.b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # zero for longer pieces
        self.long: dict[bytes, int] = {}
        self.place = np.full(1 << 12, -1, np.int32)

    def __len__(self) -> int:
        return len(self.a)

    def values(self) -> list[int]:
        return sorted([*self.place[self.place >= 0].tolist(), *self.long.values()])

    def _begin(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place where the search for a piece begins."""
        h = a * self.MIX[0]
        h ^= h >> np.uint64(29)
        h += b
        h *= self.MIX[1]
        h >>= np.uint64(64 - (len(self.place).bit_length() - 1))
        return h.astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of short pieces, -1 of those that weren't met."""
        out = np.full(len(a), -1, np.int64)
        todo, at = np.arange(len(a)), self._begin(a, b)
        while len(todo):
            number = self.place[at]
            taken = number >= 0
            todo, at, number = todo[taken], at[taken], number[taken]
            same = self.a[number] == a[todo]
            same &= self.b[number] == b[todo]
            out[todo[same]] = number[same]
            todo, at = todo[~same], (at[~same] + 1) & (len(self.place) - 1)
        return out

    def add(self, a: np.ndarray, b: np.ndarray, long: list[tuple[int, bytes]]) -> None:
        """Takes in different pieces that weren't met; long: which of them are longer ones, and their bytes."""
        known = len(self.a)
        self.a, self.b = np.concatenate([self.a, a]), np.concatenate([self.b, b])
        self.long.update((piece, known + i) for i, piece in long)
        if 2 * len(self.a) > len(self.place):
            self.place, known = np.full(1 << (4 * len(self.a)).bit_length(), -1, np.int32), 0
        number = known + np.flatnonzero(self.a[known:])
        at = self._begin(self.a[number], self.b[number])
        while len(number):
            free = self.place[at] < 0
            self.place[at[free]] = number[free]
            left = self.place[at] != number
            number, at = number[left], (at[left] + 1) & (len(self.place) - 1)

    def keep(self, stay: np.ndarray) -> None:
        """Forgets the other pieces; those that stay are numbered anew in their order."""
        a, b, new = self.a[stay], self.b[stay], np.cumsum(stay) - 1
        long = [(int(new[k]), piece) for piece, k in self.long.items() if stay[k]]
        self.__init__()
        self.add(a, b, long)


#: The bytes of a word of 8 that count, by how many there are.
_HEAD = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


class Tokens:
    """Ids of texts; pieces met before stay in a bounded cache of one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        self.marks = [t["content"].encode() for t in spec.get("added_tokens", []) if t["content"]]
        self.mark_first, self.mark_next = sorted({m[0] for m in self.marks}), np.zeros(256, bool)
        for m in self.marks:
            self.mark_next[list(m[1:2]) or list(range(256))] = True
        self.letters = np.array([ord(c) for _, c in sorted(_letters().items())], "<u4")
        self.model = self.library.model
        self.clear()

    def clear(self) -> None:
        self.at = Known()
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)  # met in a later chunk too

    def _split(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts start; each ends where the next one starts."""
        kind = _kinds(raw)
        lead = np.flatnonzero(raw == 0xC3)
        kind[lead] = kind[lead + 1] = 0
        edge = off[:-1][off[:-1] < len(raw)]
        new = np.ones(len(raw) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:-1])
        new[edge] = True
        # a run of white space before more text gives up its last character: to the next piece if it is a space
        after = np.flatnonzero(new[1:-1] & (kind[:-1] == 3)) + 1
        ends_text = np.zeros(len(raw) + 1, bool)
        ends_text[edge] = True
        after = after[~ends_text[after]]
        new[after - 1] = True
        new[after[raw[after - 1] == 32]] = False
        return np.flatnonzero(new[:-1])

    def _plain(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which texts are split here."""
        odd = _kinds(raw) == 4
        if odd.any():
            nxt = np.append(raw[1:], np.uint8(0))
            lead = (raw == 0xC3) & (nxt >= 0x80) & (nxt <= 0xBF) & (nxt != 0x97) & (nxt != 0xB7)
            at = np.flatnonzero(lead)
            odd[at] = odd[at + 1] = False
        at = np.flatnonzero(raw[:-1] == 39)
        odd[at[_SHORT[raw[at + 1]]]] = True
        for first in self.mark_first:
            at = np.flatnonzero(raw == first)
            after = np.where(at + 1 < len(raw), raw[np.minimum(at + 1, len(raw) - 1)], 0)
            odd[at[self.mark_next[after]]] = True
        bad = np.flatnonzero(odd)
        return np.searchsorted(bad, off[1:]) == np.searchsorted(bad, off[:-1])

    def _pieces(self, raw: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The number of each piece among those met; new ones are encoded. Pieces are told apart by their bytes."""
        ends = pa.py_buffer(np.append(start, len(raw)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, ends, pa.py_buffer(raw)]).dictionary_encode()
        _, ends, data = coded.dictionary.buffers()
        ends = np.frombuffer(ends, np.int32)[: len(coded.dictionary) + 1]
        data = np.concatenate([np.frombuffer(data, np.uint8)[: ends[-1]], np.zeros(16, np.uint8)])
        word = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        size = np.diff(ends)
        a = word[ends[:-1]] & _HEAD[np.minimum(size, 8)]
        b = word[ends[:-1] + 8 * (size > 8)] & _HEAD[np.clip(size - 8, 0, 8)]
        long = {int(i): data[ends[i] : ends[i + 1]].tobytes() for i in np.flatnonzero(size > 16)}
        at = np.array([*long], np.int64)
        a[at] = b[at] = 0
        spot = self.at.find(a, b)
        spot[at] = [self.at.long.get(piece, -1) for piece in long.values()]
        self.again[spot[spot >= 0]] = True
        if len(self.at) > PIECES or len(self.ids) > CACHE_IDS:
            self._keep(spot)
        new = np.flatnonzero(spot < 0)
        if len(new):
            known = len(self.first)
            text = self.letters.take(data).tobytes().decode("utf-32-le")  # a letter a byte
            of = self.model.tokenize
            ids, lens = [], []
            for x, y in zip(ends[new].tolist(), ends[new + 1].tolist(), strict=True):
                got = of(text[x:y])
                lens.append(len(got))
                ids += [t.id for t in got]
            spot[new] = np.arange(known, known + len(new))
            self.at.add(a[new], b[new], [(int(spot[i]) - known, piece) for i, piece in long.items() if spot[i] >= known])
            lens = np.array(lens, np.int64)
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(lens) - lens])
            self.size = np.concatenate([self.size, lens])
            self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        return spot[coded.indices.to_numpy()]

    def _keep(self, spot: np.ndarray) -> None:
        """Forgets pieces that weren't met again since the last time; if too many were, all but those of `spot`, which gets new numbers."""
        met = np.flatnonzero(spot >= 0)
        stay = self.again
        if np.count_nonzero(stay) > PIECES // 2 or self.size[stay].sum() > CACHE_IDS // 2:
            stay = np.zeros(len(self.at), bool)
            stay[spot[met]] = True
        size = self.size[stay]
        begin = np.cumsum(size) - size
        self.ids = self.ids[np.repeat(self.first[stay] - begin, size) + np.arange(size.sum())]
        spot[met] = (np.cumsum(stay) - 1)[spot[met]]
        self.first, self.size, self.again = begin, size, np.zeros(len(size), bool)
        self.at.keep(stay)

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with END, and how many each has."""
        n = len(off) - 1
        plain = self._plain(raw, off) if self.by_piece and len(raw) else np.zeros(n, bool) if len(raw) else np.ones(n, bool)
        size = np.diff(off)
        start = np.zeros(0, np.int64)
        if len(raw):
            body, at = (raw, off) if plain.all() else (raw[np.repeat(plain, size)], np.concatenate([[0], np.cumsum(np.where(plain, size, 0))]))
            if len(body):
                start = self._split(body, at)
        count = np.zeros(n, np.int64)
        if len(start):
            piece = self._pieces(body, start)
            lens = self.size[piece]
            upto = np.concatenate([[0], np.cumsum(lens)])
            row = np.searchsorted(start, at)  # a text's first piece
            row_first = upto[row]
            count = np.diff(row_first)
        whole = {}
        if not plain.all():
            text = raw.tobytes()
            rows = np.flatnonzero(~plain)
            for r, x in zip(rows, self.library.encode_batch_fast([text[off[r] : off[r + 1]].decode("utf-8", "replace") for r in rows], add_special_tokens=False), strict=True):
                whole[r] = x.ids
                count[r] = len(x.ids)
        total = count + 1
        begin = np.concatenate([[0], np.cumsum(total)])
        out = np.full(begin[-1], END, np.uint32)
        if len(start):
            source = np.repeat(self.first[piece] - upto[:-1], lens)
            source += np.arange(upto[-1])
            text_ids = self.ids[source]
            if whole or (n and count.min() == 0):
                to = np.repeat(begin[:-1] - row_first[:-1], np.diff(row_first))
                to += np.arange(upto[-1])
                out[to] = text_ids
            else:
                kept = np.ones(len(out), bool)
                kept[begin[1:] - 1] = False
                out[kept] = text_ids
        for r, ids in whole.items():
            out[begin[r] : begin[r] + len(ids)] = ids
        return out, total

    def cuts(self, raw: np.ndarray, size: int) -> list[int]:
        """Places about `size` bytes apart where a long text falls into parts that are encoded alike by themselves: before a space that follows
        something else and precedes a letter. Where there is no such place, or the tokenizer isn't split here, parts are longer."""
        out, at = [0], size
        if self.by_piece:
            while at < len(raw):
                w = raw[at - 1 : at + (1 << 16) + 1]
                letter = ((w[2:] | 32) >= 97) & ((w[2:] | 32) <= 122)
                ok = np.flatnonzero((w[:-2] > 32) & (w[:-2] < 127) & (w[1:-1] == 32) & letter)
                if len(ok):
                    out.append(at + int(ok[0]))
                    at = out[-1] + size
                else:
                    at += max(1, len(w) - 2)
        return [*out, len(raw)]


_WORKER: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    if path not in _WORKER:
        _WORKER[path] = Tokens(path)
    return _WORKER[path]


def encoded(of: Tokens, batches: Iterator[pa.RecordBatch], size: int = CHUNK_IN) -> Iterator[tuple[np.ndarray, list[int], list[str | None], bool]]:
    """ids, lengths and keys of (id, text), a bounded part at a time; the last: whether the last text has more to come."""
    for b in chunks(batches, "text", size):
        raw, off = flat(b.column("text"))
        keys = b.column("id").to_pylist()
        if len(raw) <= 2 * size:
            ids, total = of(raw, off)
            yield ids, total.tolist(), keys, False
            continue
        ends = of.cuts(raw, size)
        for x, y in zip(ends, ends[1:], strict=False):
            ids, total = of(raw[x:y], np.array([0, y - x]))
            more = y < len(raw)
            yield ids[:-1] if more else ids, [int(total[0]) - more], keys, more


def write(docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files under path; (file, part, seq, chain, n_ids) of those that count. Files of one chain share a text."""
    src = docs.select(named(key).alias("id"), named(text).cast("binary").alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART), min(4 * cores, -(-size // LEAST_PART)))
    order = ["id", "tie", "row"]
    src = src.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.col("id").cast("string").alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(path)
        fs.create_dir(at, recursive=True)
        ctx = TaskContext.get()
        held, lengths, keys, done, n, chain_ = [], [], [], [], 0, 0

        def flush(more: bool) -> None:
            nonlocal held, lengths, keys, n, chain_
            name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{len(done)}.ids"
            with fs.open_output_stream(f"{at}/{name}") as f:
                f.write(id_codec.pack(np.concatenate(held), lengths, keys, goes_on=more))
            done.append((f"{path}/{name}", ctx.partitionId(), len(done), chain_, n))
            held, lengths, keys, n, chain_ = [], [], [], 0, chain_ + (not more)

        open_ = False
        for ids, total, names, more in encoded(_tokens(tokenizer), batches):
            held.append(ids)
            if open_ and keys:
                lengths[-1] += total[0]
                total, names = total[1:], names[1:]
            lengths += total
            keys += names
            n += len(ids)
            open_ = more
            if n >= FILE_IDS:
                flush(more)
        if held:
            flush(False)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["file", "part", "seq", "chain", "n_ids"])
        tidy()

    return saved(src.mapInArrow(run, "file string, part int, seq int, chain int, n_ids long"), "id_files")


def texts_of(names: list[str]) -> Iterator[tuple[list[str | None], list[int], list[int], list[np.ndarray]]]:
    """keys, lengths, crc32 and parts of the ids of the texts in a chain of files, a file at a time; a text counts where it ends."""
    open_key, n, crc, held = None, 0, 0, []
    for name in names:
        fs, at = filesystem(name)
        with fs.open_input_stream(at) as f:
            ids, lengths, keys, more = id_codec.unpack(f.read())
        ends = np.cumsum(lengths)
        raw = ids.tobytes()
        crcs = [zlib.crc32(raw[4 * (e - k) : 4 * e], crc if i == 0 else 0) for i, (e, k) in enumerate(zip(ends.tolist(), lengths, strict=True))]
        rows = [ids[e - k : e] for e, k in zip(ends.tolist(), lengths, strict=True)]
        lengths = [lengths[0] + n, *lengths[1:]]
        rows[0] = np.concatenate([*held, rows[0]]) if held else rows[0]
        n, crc, held = (lengths.pop(), crcs.pop(), [rows.pop()]) if more else (0, 0, [])
        yield keys[: len(lengths)], lengths, crcs, rows


def read(files: DataFrame, key_type: str = "bigint", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every text, from the files."""
    per = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    ahead = per.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ahead"))
    chains = files.groupBy("part", "chain").agg(F.sort_array(F.collect_list(F.struct("seq", "file"))).alias("files"), F.sum("n_ids").alias("n"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("chain").rowsBetween(Window.unboundedPreceding, -1))
    placed = saved(chains.withColumn("inside", F.coalesce(inside, F.lit(0))).join(ahead, "part").select("files.file", (F.col("ahead") + F.col("inside")).alias("start")), "placed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, at in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                for keys, lengths, crcs, rows in texts_of(names):
                    ends = at + np.cumsum(lengths, dtype=np.int64)
                    cols = [pa.array(keys, pa.string()), pa.array(ends - np.array(lengths, np.int64), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int64) for x in rows], pa.list_(pa.int64())))
                    at += sum(lengths)
                    yield pa.RecordBatch.from_arrays(cols, ["id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])
        tidy()

    schema = "id string, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    n, cores = placed.count(), placed.sparkSession.sparkContext.defaultParallelism
    out = placed.repartition(max(1, -(-n // 64), min(n, 4 * cores))).mapInArrow(run, schema)
    return out.withColumn("id", F.col("id").cast(key_type)).withColumnRenamed("id", key)


def token_files(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Writes the ids of docs and reads them back."""
    import public_tokenizers

    spark = docs.sparkSession
    files = write(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "ids"), key, text)
    return read(files, docs.schema[key].dataType.simpleString(), key, with_ids)
