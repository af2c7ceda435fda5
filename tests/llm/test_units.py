"""The methods themselves, without Spark: round trips and brute force on small inputs."""

import io
import random

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import common, decontaminate, id_codec, jpeg, minhash, ppm, repeats, warc


def packed(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


texts = st.lists(st.binary(max_size=300), min_size=1, max_size=6)


@settings(max_examples=40, deadline=None)
@given(texts)
def test_words_are_split_as_by_a_pattern(ts):
    import re

    s, e, row = common.words(*packed(ts))
    body = b"".join(ts)
    got = [[] for _ in ts]
    for a, b, r in zip(s, e, row, strict=True):
        got[r].append(body[a:b])
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in ts]


@settings(max_examples=40, deadline=None)
@given(texts)
def test_jpeg_round_trip(ts):
    files = jpeg.encode(*packed(ts))
    for t, got in zip(ts, jpeg.decode(files), strict=True):
        body, n = jpeg.payload(*got)
        assert n == len(t) and body[:n] == t and len(body) % 64 == 0 and len(body) and not any(body[n:])


def test_jpeg_reader_on_a_colour_image_with_runs():
    """Two-by-two sampled luminance: coefficients with zero runs, written by hand, and their thumbnail."""
    dc, dc_body = jpeg.canonical({0: 2, 3: 2, 5: 2, 7: 3})
    ac, ac_body = jpeg.canonical({0: 1, 0x32: 3, 0xF0: 3, 0x01: 3})
    lengths = ({0: 2, 3: 2, 5: 2, 7: 3}, {0: 1, 0x32: 3, 0xF0: 3, 0x01: 3})
    bits = ""
    put = lambda v, n: format(v, f"0{n}b") if n else ""
    luma = []
    for mcu in range(2):
        for diff in (80, -24, 0, 5):
            size = abs(diff).bit_length()
            bits += put(dc[size], lengths[0][size]) + put(diff if diff > 0 else diff + (1 << size) - 1, size)
            bits += put(ac[0xF0], 3) + put(ac[0x32], 3) + put(3, 2) + put(ac[0x01], 3) + put(0, 1) + put(ac[0], 1)
            luma.append((luma[-1] if luma else 0) + diff)
        for _ in range(2):
            bits += put(dc[0], 2) + put(ac[0], 1)
    bits += "1" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    seg = jpeg._segment
    frame = b"\x08" + (16).to_bytes(2, "big") + (32).to_bytes(2, "big") + b"\3\1\x22\0\2\x11\0\3\x11\0"
    data = b"\xff\xd8" + seg(0xDB, b"\0" + b"\2" * 64) + seg(0xC4, b"\0" + dc_body + b"\x10" + ac_body) + seg(0xC0, frame) + seg(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0") + body + b"\xff\xd9"
    im, coef = jpeg.decode([data])[0]
    assert coef[0, 20] == 3 and coef[0, 21] == -1 and not coef[0, 1:20].any()
    grid = np.array([[luma[0], luma[1], luma[4], luma[5]], [luma[2], luma[3], luma[6], luma[7]]])
    assert (jpeg.thumbnail(im, coef) == np.clip((grid * 2 + 4) // 8 + 128, 0, 255)).all()


def test_bad_images_say_why():
    good = jpeg.encode(*packed([bytes(range(256)) * 40]))[0]
    got = jpeg.decode([b"", b"no", good[: len(good) // 2], good.replace(b"\xff\xc0", b"\xff\xc2", 1), good])
    assert [isinstance(x, str) for x in got] == [True, True, True, True, False]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 70000), st.just(2**32 - 1)), max_size=600), st.integers(1, 700))
def test_id_codec_round_trip(ids, steps):
    a = np.array(ids, np.int64)
    got, lengths, keys, more = id_codec.unpack(id_codec.pack(a, [len(ids)], ["x"], steps, goes_on=True))
    assert got.tolist() == ids and lengths == [len(ids)] and keys == ["x"] and more


def test_id_codec_with_groups_of_ranks_and_order_0_that_learns():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 30000, 40000), rng.zipf(1.3, 40000) % 50000, np.tile([7, 9, 11], 5000)])
    data = id_codec.pack(ids, [len(ids)], ["x"])
    assert (id_codec.unpack(data)[0] == ids).all()
    # two halves with ids of their own: blocks learn them, so they need fewer bits than the same ids in any order
    halves = np.concatenate([rng.integers(0, 16, 600000), rng.integers(100, 116, 600000)])
    mingled = rng.permutation(halves)
    assert len(id_codec.pack(halves, [len(halves)], ["x"])) < 0.95 * len(id_codec.pack(mingled, [len(halves)], ["x"]))


def test_id_codec_finds_damage_and_compresses():
    ids = np.tile(np.array([5, 9, 300, 7, 0]), 4000)
    data = id_codec.pack(ids, [len(ids)], ["x"])
    assert len(data) < len(ids) / 4
    for place in (8, 20, len(data) - 40):
        broken = bytearray(data)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            id_codec.unpack(bytes(broken))
    with pytest.raises(ValueError):
        id_codec.unpack(data[:-300])


def test_a_decoder_predicts_each_id_once(monkeypatch):
    """Lessons take what the steps saw; with nearly as many distinct ids as a file may have, the groups' ranks stay exact."""
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.permutation((1 << 18) - 1), rng.integers(0, 300, 100000)])
    data = id_codec.pack(ids, [len(ids)], ["x"])
    steps, predict = [], id_codec.Model.predict
    monkeypatch.setattr(id_codec.Model, "predict", lambda self, one, *more: (steps.append(one.ndim), predict(self, one, *more))[1])
    assert (id_codec.unpack(data)[0] == ids).all()
    assert set(steps) == {1} and len(steps) <= id_codec.STEPS


def test_ids_of_documents_take_fewer_bits_than_their_entropy():
    import public_tokenizers
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidewright.llm.token_files import Tokens

    text = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks().cast(pa.binary())
    ids, total = Tokens(public_tokenizers.path("byte_bpe_50k.json"))(*common.flat(text))
    data = id_codec.pack(ids, total.tolist(), ["x"] * len(total))
    p = np.bincount(ids)
    p = p[p > 0] / len(ids)
    assert (id_codec.unpack(data)[0] == ids).all()
    assert 8 * len(data) / len(ids) < -(p * np.log2(p)).sum()  # with header and checksums


def thue_morse(n, swap=False):
    """Letters on which polynomial hashes modulo 2**64 of a word and its complement agree, whatever the base."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_long_pieces_are_told_apart_by_their_bytes():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidewright.llm.token_files import Tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    of, lib = Tokens(path), Tokenizer.from_file(path)
    for t in (thue_morse(2048), thue_morse(2048, True)):
        assert of(*packed([t.encode()]))[0].tolist() == [*lib.encode(t, add_special_tokens=False).ids, 0]


def test_long_texts_are_encoded_in_parts():
    import public_tokenizers
    import pyarrow as pa

    from tidewright.llm.token_files import Tokens, encoded

    rng = random.Random(5)
    long = "  ".join(" ".join(rng.choice(["some", "Words", "12", "a,b", "x\n", "\t"]) for _ in range(2000)) for _ in range(10))
    of = Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    rows = ["a b", long, None, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(list("wxyz")), pa.array([None if r is None else r.encode() for r in rows], pa.binary())], ["id", "text"])
    got = list(encoded(of, iter([batch]), 3000))
    assert max(len(x[0]) for x in got) < 5000 and len(got) > 10
    assert [k for x in got if not x[3] for k in x[2]] == list("wxyz")
    want = [of(*packed([(r or "").encode()]))[0] for r in rows]
    assert np.concatenate([x[0] for x in got]).tolist() == np.concatenate(want).tolist()


def test_pieces_that_come_again_stay_in_a_full_cache(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidewright.llm import token_files

    monkeypatch.setattr(token_files, "PIECES", 300)
    path = public_tokenizers.path("byte_bpe_50k.json")
    of, lib, rng = token_files.Tokens(path), Tokenizer.from_file(path), random.Random(3)
    word = lambda: "".join(rng.choice("bcdfgh") for _ in range(9))
    often, encoded = [word() for _ in range(40)], []

    def chunk(words):
        text = " " + " ".join(words)
        assert of(*packed([text.encode()]))[0].tolist() == [*lib.encode(text, add_special_tokens=False).ids, 0]

    for _ in range(2):
        chunk(often)
    for _ in range(4):  # the cache overflows while none of them is in the text
        chunk([word() for _ in range(150)])
    assert len(of.at) < 600 and list(of.at.values()) == list(range(len(of.size)))

    class Counted:
        def tokenize(self, piece, model=of.model):
            encoded.append(piece)
            return model.tokenize(piece)

    of.model = Counted()
    chunk(often)
    assert not encoded


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=20).map(lambda b: b.replace(b"\0", b"a")), max_size=40), max_size=6), st.integers(0, 3))
def test_known_pieces_are_numbered_as_in_a_dict(rounds, left):
    """Pieces of less, as many and more bytes than two integers hold."""
    from tidewright.llm import token_files

    word = lambda b: [int.from_bytes(b[i : i + 8], "little") if len(b) <= 16 else 0 for i in (0, 8)]
    known, want = token_files.Known(), {}
    for i, pieces in enumerate(rounds):
        pieces = list(dict.fromkeys(pieces))
        a, b = np.array([word(p) for p in pieces], np.uint64).reshape(-1, 2).T
        got = [known.long.get(p, -1) if len(p) > 16 else n for p, n in zip(pieces, known.find(a, b).tolist(), strict=True)]
        assert got == [want.get(p, -1) for p in pieces]
        new = [k for k, n in enumerate(got) if n < 0]
        known.add(a[new], b[new], [(j, pieces[k]) for j, k in enumerate(new) if len(pieces[k]) > 16])
        want |= {pieces[k]: len(want) + j for j, k in enumerate(new)}
        if i % 2:
            stay = np.array([k % 4 != left for k in range(len(want))], bool)
            known.keep(stay)
            want = {p: k for k, p in enumerate(p for p, k in want.items() if stay[k])}
        assert len(known) == len(want) and known.values() == list(range(len(want)))


def test_a_worker_keeps_more_than_half_a_million_pieces():
    import public_tokenizers

    from tidewright.llm.token_files import Tokens

    of, n = Tokens(public_tokenizers.path("byte_bpe_50k.json")), 510_000
    letters = np.frombuffer(b"bcdfghjklmnpqrst", np.uint8)
    raw = np.full((n, 6), 32, np.uint8)
    for k in range(5):
        raw[:, k + 1] = letters[(np.arange(n) >> (4 * k)) & 15]
    first = of(raw.ravel(), np.array([0, raw.size]))[0]
    of(raw[:10].ravel(), np.array([0, 60]))

    class Never:
        def tokenize(self, piece):
            raise AssertionError(piece)

    of.model = Never()
    assert (of(raw.ravel(), np.array([0, raw.size]))[0] == first).all()


def test_blocks_that_learn_some_at_a_time_give_the_same_file(monkeypatch):
    rng = np.random.default_rng(5)
    for ids in (rng.zipf(1.2, 30000) % 60000, np.concatenate([rng.permutation(80000), rng.integers(0, 90, 20000)])):
        files = []
        for some in (3, 1 << 20):
            monkeypatch.setattr(id_codec, "SOME", some)
            files.append(id_codec.pack(ids, [len(ids)], ["x"]))
            assert (id_codec.unpack(files[-1])[0] == ids).all()
        assert files[0] == files[1]


def test_tokens_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidewright.llm.token_files import Tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    ts = ["", " ", "  a  b \n\n c", "don't it's 'tis I'll 's", "a\n", "\t\ta", "été Ça × ÷ ÿ 12ab34 ,.;!! ok", "日本語 text", "<|endoftext|> a <|b", ".'s a", "a b \x1f", "x" * 3000, "a 1b2  "]
    rng = random.Random(1)
    ts += ["".join(rng.choice(" \n\t'aébÉ1.,<|s") for _ in range(60)) for _ in range(300)]
    ids, total = Tokens(path)(*packed([t.encode() for t in ts]))
    ends = np.cumsum(total)
    lib = Tokenizer.from_file(path)
    for t, a, b in zip(ts, ends - total, ends, strict=True):
        assert ids[a:b].tolist() == [*lib.encode(t, add_special_tokens=False).ids, 0], t


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abc", max_size=40), min_size=1, max_size=5), st.integers(3, 9))
def test_repeats_of_a_bucket_by_brute_force(ts, least):
    """Suffixes at every place: the covered range of each equals that of all its pairs."""
    body = [t.encode() for t in ts]
    at = [(x, i) for x in range(len(body)) for i in range(len(body[x]))]
    right, left = [body[x][i:] for x, i in at], [body[x][:i][::-1] for x, i in at]
    want = {}
    for a in range(len(at)):
        for b in range(len(at)):
            r, l = repeats.common(right[a], right[b]), repeats.common(left[a], left[b])
            if a != b and r and r + l >= least:
                w = want.get(a, (0, 0))
                want[a] = (max(w[0], l), max(w[1], r))
    got = {}
    for depth, members in repeats.repeats(right, left, least):
        for x, l in members:
            if depth:
                w = got.get(x, (0, 0))
                got[x] = (max(w[0], l), max(w[1], depth))
    assert got == want


def test_shingles_and_minima():
    ts = [b"a b c d e", b"A B C D E", b"b a c d e", b"a b", b"", b"x y y x x y y x", b"a b c d e a b c d e"]
    h, at = minhash.shingles(*packed(ts), 4)
    sets = [set(h[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    words = [t.lower().split() for t in ts]
    want = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()) for w in words]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(ts)):
        for j in range(len(ts)):
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])


def test_ppm_is_a_distribution_and_learns():
    train = [b"the cat sat on the mat. " * 20, b"the dog sat on the log. " * 20]
    g, c = ppm.grams(*packed(train), 2)
    classes = np.full(ppm.SIZE, ppm.CLASSES - 1)
    classes[0] = 0
    common_ = [x + 1 for x in sorted(set(b"".join(train)))]
    classes[common_] = np.arange(1, len(common_) + 1)
    j, ctx, s, n = [], [], [], []
    for o in range(3):
        digits = [classes[(g // ppm.SIZE**i) % ppm.SIZE] for i in range(o + 1)]
        key = sum(d * ppm.CLASSES**i for i, d in enumerate(digits))
        u, inv = np.unique(key, return_inverse=True)
        j.append(np.full(len(u), o)), ctx.append(u // ppm.CLASSES), s.append(u % ppm.CLASSES), n.append(np.bincount(inv, c))
    child, log10 = ppm.build(*map(np.concatenate, (j, ctx, s, n)), 2)
    assert np.allclose((10.0 ** log10.astype(float)).sum(axis=1), 1, atol=1e-4)
    inside = np.where(classes == ppm.CLASSES - 1, -np.log10((classes == ppm.CLASSES - 1).sum()), 0.0)
    m = ppm.Model(child, log10, 2, classes, inside)
    known, odd, empty = ppm.score(m, *packed([b"the cat sat", b"tqz vxk jwq", b""]))
    assert known > odd and empty < 0
    apart = [ppm.score(m, *packed([t]))[0] for t in (b"the cat sat", b"tqz vxk jwq", b"")]
    assert apart == [known, odd, empty]


def edits(a, b):
    row = [0] * (len(b) + 1)  # free start and end in b
    for i, x in enumerate(a):
        new = [i + 1]
        for k, y in enumerate(b):
            new.append(min(row[k] + (x != y), row[k + 1] + 1, new[k] + 1))
        row = new
    return min(row)


def test_decontamination_by_brute_force():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(n)) for n in (3, 12, 25, 40, 2)]
    docs = []
    for i in range(120):
        body = [word() for _ in range(60)]
        t = list(items[i % 5])
        for _ in range(i % 9):
            p = rng.randrange(len(t))
            t[p : p + 1] = rng.choice([[], ["z"], [t[p], "z"]])
        t = "".join(t)
        t = t.upper().replace(" ", "\n ") if i % 7 == 0 else t
        docs.append(" ".join(body[:30]) + " " + (t if i % 3 else "") + ". " + " ".join(body[30:]))
    ix = decontaminate.Index([(k, t.encode()) for k, t in enumerate(items)])
    got = {(r, i): d for r, i, d, _ in ix.match(*packed([d.encode() for d in docs]))}
    for r, d in enumerate(docs):
        plain = decontaminate.plain(*packed([d.encode()]))[0].tobytes()
        for i, t in enumerate(ix.text):
            want = edits(t, plain)
            whole = len(t) >= ix.q or want > 0 or b" " + t + b" " in plain + b" "
            assert ((r, i) in got) == (want <= ix.budget[i] and whole), (r, i, want, ix.budget[i])
            if (r, i) in got:
                assert got[r, i] == want


def test_repetitive_items_and_texts(monkeypatch):
    """Aligning each of the 16,915 bands by itself took 444 million cells for the whole items."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = " ".join(word() for _ in range(20))
    items = [(i, (shared + " " + " ".join(word() for _ in range(20)) + " " + shared).encode()) for i in range(200)]
    items += [(200, (shared + " ").encode() * 8), (201, b"ab " * 120)]
    ix = decontaminate.Index(items)
    text = (shared + " ").encode() * 20 + items[7][1] + b" " + items[9][1].replace(b"a", b"x", 3) + b" " + b"ab " * 150
    real, cells = decontaminate.align, []
    monkeypatch.setattr(decontaminate, "align", lambda items, *a: cells.append(sum(map(len, items)) * a[-1]) or real(items, *a))
    got = {i: d for _, i, d, _ in ix.match(*packed([text]))}
    assert sum(cells) < 16_915 * 360 * 73 / 6
    assert got == {7: 0, 9: 3, 200: 0, 201: 0}


def test_long_texts_in_windows(monkeypatch):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(n))
    items = [(i, words(rng.randint(6, 60)).encode()) for i in range(12)]
    text = b" !  ".join(words(rng.randint(0, 200)).encode() + b"\n" * rng.randint(0, 40) + items[i % 12][1].replace(b"a", b"q", i // 12) for i in range(36))
    rows = [b"", text, b"short", text[: len(text) // 2] + items[3][1]]
    ix = decontaminate.Index(items)
    want = ix.match(*packed(rows))
    monkeypatch.setattr(decontaminate, "CHUNK_IN", 700)
    assert [x[:3] for x in ix.match(*packed(rows))] == [x[:3] for x in want] and len(want) > 12
    assert ix.match(*packed(rows)) == want
    assert decontaminate.long_plain(np.frombuffer(text, np.uint8)).tobytes().strip() == decontaminate.plain(*packed([text]))[0].tobytes().strip()


def test_warc_file_format():
    trained = warc.dictionary.__defaults__ and b"WARC/1.1 WARC-Type: response" * 20
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    rows = [(1, "http://a/\r\nX: y", b"<p>hi</p>\r\n\r\n", None), (2, None, b"", None), (3, "http://c", b"", 1)]
    f = warc.MAGIC + len(trained).to_bytes(4, "little") + trained
    f += b"".join(packer.compress(warc.record(k, u, b, len(b), "00", r)) for k, u, b, r in rows)
    got = list(warc.read_records(io.BytesIO(f)))
    assert [h["WARC-Type"] for h, _ in got] == ["response", "response", "revisit"]
    assert got[0][1].endswith(b"<p>hi</p>\r\n\r\n") and got[2][0]["WARC-Refers-To"] == got[0][0]["WARC-Record-ID"]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(f[8:])))
    assert len(list(warc.read_records(io.BytesIO(f[:-20])))) < 3  # read() compares the count with the one written


def test_ppm_places_of_short_texts():
    """The grams of each place against a plain reading, for empty texts and texts shorter than a context."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7):
        for most in (1, 3, 12):
            texts = [bytes(rng.integers(0, 256, rng.integers(0, most)).astype(np.uint8)) for _ in range(n)]
            raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            for order in range(7):
                wanted = []
                for t in texts:
                    s = [0] * order + [b + 1 for b in t.lower()] + [0]
                    wanted += [sum(x * ppm.SIZE ** (order - i) for i, x in enumerate(s[a : a + order + 1])) for a in range(len(t) + 1)]
                got, start = ppm.places(raw, off, order)
                assert got.tolist() == wanted
                assert start.tolist() == (off[:-1] + np.arange(n)).tolist()
