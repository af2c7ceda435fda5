"""Spelling variants, phrases and url rules on small tables, against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewright.llm import phrases, spellings, url_rules

TEXT = "doc_id long, text string, lang string, word string, n long, shard string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# spellings


def words_of(rows, damage=0, shortest=6, least=5):
    n = Counter()
    for k, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if damage and h % damage == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(n, ratio=5):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def got_variants(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_words_are_counted_and_damaged(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeÉßÿ×z") for _ in range(rng.randint(4, 12))) for _ in range(60)] + ["q" * 90 + "é" * 3]
    texts = [(i if i % 9 else None, " 12 ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 300)))) for i in range(60)]
    texts += [(7, None), (8, ""), texts[3], texts[3], (9, "ÀB–éclairs_éclairsĀéclairs" * 5)]
    df = spark.createDataFrame([(*r, None, "x", 1, "y") for r in texts], TEXT).repartition(3)
    for damage in (0, 7, 199):
        assert {r["word"]: r["n"] for r in spellings.word_counts(df, damage=damage).collect()} == words_of(texts, damage)
    assert spellings.variants(spellings.word_counts(df.limit(0), damage=199)).collect() == []


def test_variants_against_all_pairs(spark):
    rng = random.Random(5)
    n = {}
    for alphabet, most in (("ab", 7), ("abcdefgh", 5), ("aé日😀", 5)):
        for _ in range(250):
            n["".join(rng.choice(alphabet) for _ in range(rng.randint(1, most)))] = int(5 ** rng.uniform(1, 9))
    for base in ("consideration", "aaaaaaaa", "abababab"):
        n[base] = 10**9
        for _ in range(30):
            w = list(rng.choice([x for x in n if one_edit(x, base) or x == base]))
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], ["x"], [w[i], "y"], [w[i], w[i]]])
            n.setdefault("".join(w), int(5 ** rng.uniform(1, 8)))
    n["z" * 3000], n["z" * 2999], n["z" * 2999 + "y"] = 5, 25, 125
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = got_variants(spellings.variants(df))
    assert got == variants_of(n)
    assert got["z" * 3000][4] == "z" * 2999 + "y" and max(len(set(v[4] for v in got.values())), 1) < len(n)
    assert got_variants(spellings.variants(df, ratio=2)) == variants_of(n, 2)
    with pytest.raises(ValueError):
        spellings.variants(df, ratio=1)


def test_light_steps_are_few(spark):
    """A word leaves heavy paths at most log2(words) times, however many words share its start."""
    words = ["a" * i + b for i in range(40) for b in ("", "b", "c")] + [f"w{i:03b}" for i in range(8)]
    words = sorted(set(words) - {""})
    rows = spellings.light_steps(spark.createDataFrame([(w, 9) for w in words], "word string, n long")).collect()
    assert max(Counter(r["word"] for r in rows).values()) <= math.log2(len(words)) + 1


def test_roots_of_long_chains(spark):
    """27 links, each with five times the count: as long as a chain of 64-bit counts can be."""
    words = ["x" * i + "y" * (26 - i) for i in range(27)]
    df = spark.createDataFrame([(w, 5**i) for i, w in enumerate(words)], "word string, n long")
    got = spellings.variants(df).collect()
    assert {r["root"] for r in got} == {words[-1]} and {r["form"] for r in got if r["n"] == 5} == {words[2]}


# phrases


def phrases_of(rows, least, top, longest=4, share=80):
    f, n = defaultdict(Counter), Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(t or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        over = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    over[p[i : i + m]] = max(over[p[i : i + m]], a)
        kept = []
        for p, a in found.items():
            if 100 * over[p] < share * a or not over[p]:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out, key=repr)


def prose(rng, n, words):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n"]) for _ in range(n))


@pytest.mark.parametrize("size", [500, 6 << 20])
def test_phrases_against_counting(spark, monkeypatch, size):
    rng = random.Random(size)
    words = ["a", "b", "the", "THE", "é", "日本", "x-y", "$5", " ", "-" * 3000]
    texts = [prose(rng, rng.randint(0, 400), words[: rng.randint(1, 10)]) for _ in range(40)] + [None, "", " \t", ".,;", "a" * 5000, "a a a a a a a", "ab " * 2000, prose(rng, 3000, words)]
    rows = [(t, rng.choice(["en", "und", None])) for t in texts] * 2
    df = spark.createDataFrame([(i, *r, "w", 1, "s") for i, r in enumerate(rows)], TEXT).repartition(3)
    monkeypatch.setattr(phrases, "SHARD", size)
    for least, top, longest in ((5, 40, 4), (3, 10**6, 4), (30, 10**6, 3), (2, 50, 2)):
        got = phrases.collocations(df, least=least, top=top, longest=longest)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == phrases_of(rows, least, top, longest)
    assert phrases.collocations(df.limit(0)).collect() == []


def test_bitmaps_in_small_batches(monkeypatch):
    rng = np.random.default_rng(2)
    word = rng.integers(0, 12, 4000)
    at = np.cumsum(rng.choice([1, 1, 1, 2, 900], 4000))
    maps = phrases.Bitmaps.of_positions(word, at)
    assert maps.popcounts(14).tolist() == np.bincount(word, minlength=14).tolist()
    again = phrases.Bitmaps.unpacked(*maps.packed(14))
    assert all((a == b).all() for a, b in ((maps.of, again.of), (maps.place, again.place), (maps.bits, again.bits)))
    want = Counter((a, b) for a, b, p, q in zip(word.tolist(), word[1:].tolist(), at.tolist(), at[1:].tolist(), strict=False) if q == p + 1)
    for pairs in (1 << 22, 50):
        monkeypatch.setattr(phrases, "PAIRS", pairs)
        x, y, n, longer = phrases.grown(phrases.Words(again), again, 14)
        assert {(a, b): c for a, b, c in zip(x.tolist(), y.tolist(), n.tolist(), strict=True)} == want
        assert len(np.unique(longer.of)) == len(want)


def test_exact_scores_beyond_64_bits(spark):
    words = spark.createDataFrame([(1, "en", "x", 9 * 10**18), (2, "en", "y", 9 * 10**18 - 1)], "id long, lang string, word string, f long")
    found = spark.createDataFrame([([1, 2], 9 * 10**18 - 2)], "ids array<long>, f long")
    r = phrases.scored(words, found).first()
    assert (r["phrase"], r["score"]) == ("x y", 2000000 * (9 * 10**18 - 2) // (18 * 10**18 - 1))


# url rules


def judged_of(url, rules, default):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = lower(re.match("[^/?#]*", rest)[0])
    path = re.match("[^?#]*", rest[len(host) :])[0]
    fit = [(len(h + p), len(h.split(".")), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


def urls(rng, n):
    label = lambda: rng.choice(["a", "b", "c", "org", "com", "x1", "É", ""])
    for _ in range(n):
        host = ".".join(label() for _ in range(rng.randint(1, 4)))
        yield rng.choice(["http://", "HTTPS://", "://", "", "x:"]) + (host.upper() if rng.random() < 0.3 else host) + "".join(rng.choice(["/", "/a", "/b", "a", "?", "#", "://"]) for _ in range(rng.randint(0, 5)))


@pytest.mark.parametrize("parts", ["1", "7"])
def test_url_rules_against_every_rule(spark, monkeypatch, parts):
    rng = random.Random(4)
    rules = {}
    while len(rules) < 120:
        h, p = ".".join(rng.choice(["a", "b", "c", "org", "com", "x1"]) for _ in range(rng.randint(1, 3))), "".join(rng.choice(["/", "/a", "/b", "a"]) for _ in range(rng.randint(0, 3)))
        if p[:1] in ("", "/"):
            rules[h, p] = rng.choice(["allow", "block"])
    listed = [url_rules.Rule(v, h, p) for (h, p), v in rules.items()] + [url_rules.Rule(rng.choice(["allow", "block"]), "a.b", "/a/")] * 2
    real = {}
    for v, h, p in listed:
        real[h, p] = max(v, real.get((h, p), v))
    real = [(v, h, p) for (h, p), v in real.items()]
    seen = list(urls(rng, 900)) + [None, "", "http://", "http://a.b/" + "a/" * 5000, "http://" + "a." * 4000 + "org/a"] + ["http://a.b.org/a/b"] * 600
    df = spark.createDataFrame([(i if i % 11 else None, u, "h", "r", 1) for i, u in enumerate(seen)], "page_id long, url string, host string, rule string, row int").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((tuple(r) for r in url_rules.judged(df, listed, "unknown").collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(((i if i % 11 else None, *judged_of(u, real, "unknown")) for i, u in enumerate(seen)), key=repr)


def test_url_rules_without_rules_or_pages(spark):
    df = spark.createDataFrame([(1, "http://A.org/x?y")], "page_id long, url string")
    assert [tuple(r) for r in url_rules.judged(df, []).collect()] == [(1, "a.org", "/x", None, "allow")]
    assert url_rules.judged(df.limit(0), url_rules.RULES).collect() == []
    with pytest.raises(Exception, match="needs a host"):
        url_rules.judged(df, [url_rules.rule("block /x")]).collect()


def test_active_rules_are_a_stack():
    """Nested rules in one sorted range: popped when the key no longer starts with theirs."""
    key = lambda host, path: (".".join(reversed(host.split("."))) + "?" + path).encode()
    rules = [("org", "/"), ("org", "/a"), ("org", "/a/b"), ("org", "/c")]
    rows = [(0, key(h, p), -1, 1, {"host": h, "path": p, "verdict": "block"}) for h, p in rules] + [(0, key("org", p), i, 1, None) for i, p in enumerate(["/", "/a", "/a/b/c", "/a/c", "/b", "/c", "/d"])] + [(1, key("org", "/a"), 99, 1, None)]
    rows.sort(key=lambda r: (r[0], r[1], r[4] is None, r[2]))
    kind = pa.struct([("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())])
    columns = list(zip(*rows, strict=True))
    b = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], kind)], ["part", "key", "row", "level", "rule"])
    got = {r["row"]: r["rule"]["path"] for x in url_rules._sweep(iter([b.slice(0, 5), b.slice(5)])) for r in x.to_pylist()}
    assert got == {0: "/", 1: "/a", 2: "/a/b", 3: "/a", 4: "/", 5: "/c", 6: "/"}
