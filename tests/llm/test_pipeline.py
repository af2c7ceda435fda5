"""The pipeline on a small corpus against a plain version of all its stages."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("corpus"), random.Random(12)
    items = [(i, words(rng, 40)) for i in range(5)]
    rows = []
    for i in range(160):
        source = "big" if i % 3 == 0 else f"s{i % 5}"
        text = words(rng, rng.randint(20, 80))
        if i % 20 == 7 and rows:
            text = rows[i - 3][1]  # an exact copy
        if i % 20 == 9:
            w = rows[i - 4][1].split()
            w[len(w) // 2] = "edited"
            text = " ".join(w) if len(w) > 60 else rows[i - 4][1] + " end"
        if i % 31 == 3:
            text = text + " " + items[i % 5][1].upper() + " " + text[:30]
        rows.append((i, text, "en" if i % 4 else None, source, len(text)))
    rows += [(200, None, "en", "s1", 0), (201, "1 2 3", "en", "s1", 5), (202, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, items


def plain_run(rows, items):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    sets = {}
    for r in docs:
        w = r[1].lower().split()
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(label)
        for i, a in sets.items():
            for j, b in sets.items():
                if len(a & b) * 5 >= len(a | b) * 4:
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    docs = [r for r in docs if label[r[0]] == r[0]]
    docs = [r for r in docs if not any(" ".join(t.split()) in " ".join(r[1].lower().split()) for _, t in items)]
    size = defaultdict(int)
    for r in docs:
        size[r[3]] += len(r[1].split())
    total = sum(size.values())
    p = {s: n / total for s, n in size.items()}

    def shares(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    def most(a):
        w = shares(a)
        return max(w[s] / p[s] for s in p) / min(w[s] / p[s] for s in p)

    def entropy(a):
        return -sum(w * math.log(w) for w in shares(a).values())

    goal, a = 0.97 * math.log(len(p)), 1.0
    if entropy(1.0) < goal:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            m = (lo + hi) / 2
            lo, hi = (m, hi) if entropy(m) >= goal else (lo, m)
        a = lo
    if most(a) > 1.5:
        lo, hi = a, 1.0
        for _ in range(60):
            m = (lo + hi) / 2
            lo, hi = (m, hi) if most(m) > 1.5 else (lo, m)
        a = hi
    w = shares(a)
    budget = max(size[s] / w[s] for s in size)
    out = []
    for s in size:
        quota, own = math.floor(round(w[s] * math.ceil(round(budget, 3)), 3)), [r for r in docs if r[3] == s]
        block = 0
        while quota > 0:
            for r in sorted(own, key=lambda r: hashlib.md5(f"0:{block}:{r[0]}".encode()).hexdigest()):
                if len(r[1].split()) > quota:
                    quota = 0
                    break
                quota -= len(r[1].split())
                out.append(r)
            block += 1
    lib, start, got = Tokenizer.from_file(path("byte_bpe_50k.json")), 0, []
    for r in sorted(out, key=lambda r: r[0]):
        ids = [*lib.encode(r[1], add_special_tokens=False).ids, 0]
        got.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return got


def test_pipeline_equals_its_plain_version(spark, folder):
    at, rows, items = folder
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, at).collect()), key=lambda r: r[1])
    want = plain_run(rows, items)
    assert len({r[0] for r in want}) < len(want) and len({r[0] for r in want}) < len(rows) - 10
    assert got == want


def test_stages_keep_the_columns(spark, folder):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").selectExpr("*", "1 as score", "'x' as `a.b`", "2 as label")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "a.b", "label"]
    assert docs.count() > 100
