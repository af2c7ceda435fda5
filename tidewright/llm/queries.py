"""The queries of the text operators, one for each, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, new_path, table


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.pmod(id_crc(F.col("doc_id")), F.lit(5)) == 0).alias("held_out"))
    model = train(docs.filter(~F.col("held_out")))
    return predict(docs.drop("lang"), model, keep=["doc_id", "held_out"])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "source", "tokens", "block", "place")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest, update, versions

    seen = versions(table(spark, sf_dir, "documents"))
    return digest(seen, update(seen)).withColumnRenamed("path", "doc_id")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import train, word_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(7)) == 2
    return word_scores(docs, train(docs.filter(~held)), held)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)


def op4_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jpeg import features, store

    path = new_path(spark, "media")
    store(table(spark, sf_dir, "documents")).write.option("compression", "uncompressed").parquet(path)
    got = features(spark.read.parquet(path))
    shown = F.concat(F.col("width"), F.lit("x"), F.col("height"), F.lit(":"), F.col("thumbnail_sha256"))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", shown.alias("feature"), "width", "height")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, read

    return read(archive(table(spark, sf_dir, "pages")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spellings import variants, word_counts

    return variants(word_counts(table(spark, sf_dir, "documents"), damage=199))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import RULES, judged

    return judged(table(spark, sf_dir, "pages"), RULES)


_ALL = (op1_ppm, op2_repeats, op3_minhash, op4_jpeg, op5_token_files, op6_language_id, op7_warc, op8_mixing, op9_decontamination, op10_secrets, op11_spellings, op12_phrases, op13_url_rules)
QUERIES = {f.__name__: f for f in _ALL}

_WORDS = r"len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))"

ORACLES = {
    "op8_mixing": rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, coalesce(source, '') AS source, CAST({_WORDS} AS BIGINT) AS tokens FROM documents),
s AS MATERIALIZED (SELECT source, CAST(sum(tokens) AS BIGINT) AS n FROM d GROUP BY source HAVING sum(tokens) > 0),
p AS MATERIALIZED (SELECT list(n / CAST((SELECT sum(n) FROM s) AS DOUBLE) ORDER BY source) AS p, CAST(sum(n) AS BIGINT) AS t FROM s),
b0 AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi UNION ALL
  SELECT i + 1, CASE WHEN ok THEN m ELSE lo END, CASE WHEN ok THEN hi ELSE m END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS m,
      ln(list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2)))) - list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * ln(x) * (lo + hi) / 2)) / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2)))
      >= 0.97e0 * ln(len(p)) AS ok FROM b0, p WHERE i < 40)),
a0 AS MATERIALIZED (SELECT CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= 0.97e0 * ln(len(p)) THEN 1e0 ELSE (SELECT lo FROM b0 WHERE i = 40) END AS a FROM p),
b1 AS (SELECT 0 AS i, a AS lo, CAST(1 AS DOUBLE) AS hi FROM a0 UNION ALL
  SELECT i + 1, CASE WHEN ok THEN m ELSE lo END, CASE WHEN ok THEN hi ELSE m END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS m, list_max(list_transform(p, lambda x: pow(x, (lo + hi) / 2 - 1))) / list_min(list_transform(p, lambda x: pow(x, (lo + hi) / 2 - 1))) > 2 AS ok FROM b1, p WHERE i < 40)),
e AS MATERIALIZED (SELECT round(CASE WHEN list_max(list_transform(p, lambda x: pow(x, a - 1))) / list_min(list_transform(p, lambda x: pow(x, a - 1))) <= 2 THEN a ELSE (SELECT hi FROM b1 WHERE i = 40) END, 9) AS a, p, t FROM a0, p),
z AS MATERIALIZED (SELECT a, t, list_sum(list_transform(p, lambda x: pow(x, a))) AS z, ceil(round(list_max(list_transform(p, lambda x: t * pow(x, 1 - a))) * list_sum(list_transform(p, lambda x: pow(x, a))), 3)) AS budget FROM e),
q AS MATERIALIZED (SELECT source, n, CAST(floor(round(pow(n / CAST(t AS DOUBLE), a) / z * budget, 3)) AS BIGINT) AS quota FROM s, z),
w AS (SELECT d.*, coalesce(q.n, 0) AS n, q.quota, coalesce(q.quota // q.n, 1) AS whole FROM d LEFT JOIN q USING (source)),
f AS (SELECT doc_id, key, source, tokens, unnest(range(whole)) AS block FROM w),
l AS (SELECT doc_id, key, source, tokens, whole AS block, quota - whole * n AS rest, md5(concat_ws(':', '0', whole, key)) AS place FROM w WHERE quota > whole * n),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY place, key ROWS UNBOUNDED PRECEDING) AS upto FROM l)
SELECT doc_id, source, tokens, CAST(block AS BIGINT) AS block, md5(concat_ws(':', '0', block, key)) AS place FROM f
UNION ALL SELECT doc_id, source, tokens, CAST(block AS BIGINT), place FROM c WHERE upto <= rest""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (d)""",
    "op10_secrets": r"""
WITH r(k, name, pat, grp, least) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24),
  (3, 'forge', 'gh[opsu]_[A-Za-z0-9]{36,}', 0, 0),
  (4, 'jwt', 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 0),
  (5, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 0)),
d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT id, 0 AS k, 6 AS least, string_split_regex(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gap, regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m, regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g FROM d
  UNION ALL SELECT id, 1, 20, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') AS m, m FROM d
  UNION ALL SELECT id, 2, 24, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') AS m, m FROM d
  UNION ALL SELECT id, 3, 0, string_split_regex(text, 'gh[opsu]_[A-Za-z0-9]{36,}'), regexp_extract_all(text, 'gh[opsu]_[A-Za-z0-9]{36,}') AS m, m FROM d
  UNION ALL SELECT id, 4, 0, string_split_regex(text, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'), regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}') AS m, m FROM d
  UNION ALL SELECT id, 5, 0, string_split_regex(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') AS m, m FROM d),
x AS (SELECT id, k, least, unnest(range(len(m))) AS ord, unnest(list_transform(gap[1:len(m)], lambda y: length(y))) AS a, unnest(list_transform(m, lambda y: length(y))) AS b, unnest(list_transform(g, lambda y: length(y))) AS c FROM h WHERE len(m) > 0),
y AS (SELECT *, sum(a + b) OVER (PARTITION BY id, k ORDER BY ord) AS e FROM x),
f AS (SELECT id, k, CAST(e - b AS BIGINT) AS s, CAST(e AS BIGINT) AS e, name || ':' || CAST(e - b AS BIGINT) || ':' || CAST(e AS BIGINT) AS t FROM y JOIN r USING (k) WHERE c >= y.least),
o AS (SELECT id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, coalesce(string_agg(t, ',' ORDER BY s, k) FILTER (k < 3), '') AS base, string_agg(t, ',' ORDER BY s, k) AS spans FROM f GROUP BY id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (id)""",
    "op11_spellings": r"""
WITH RECURSIVE d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+') AS runs FROM documents),
r AS MATERIALIZED (SELECT k, w, count(*) AS c FROM (SELECT k, unnest(runs) AS w FROM d) WHERE length(w) >= 6 GROUP BY ALL),
x AS (SELECT w, c, hex(encode(k || ':' || w)) AS x FROM r),
b AS (SELECT w, c, list_transform(range(0, length(x)), lambda i: CAST(instr('0123456789ABCDEF', x[xor(i, 1) + 1]) - 1 AS BIGINT)) AS nibbles FROM x),
h AS (SELECT w, c, xor(list_reduce(nibbles, lambda s, v: xor(xor(s, v) >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108])[1 + (xor(s, v) & 15)]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b),
g AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM g WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
l AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
e AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS near FROM (SELECT word, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS t FROM l) a JOIN (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS t FROM l) b USING (t) WHERE a.word <> b.word),
s AS MATERIALIZED (SELECT DISTINCT l.word, w.word AS near FROM l JOIN w ON w.word = substr(l.word, 1, l.i - 1) || substr(l.word, l.i + 1)),
p AS (SELECT word, near FROM e UNION ALL SELECT word, near FROM s UNION ALL SELECT near, word FROM s),
o AS (SELECT p.word, count(*) AS n_near, arg_min(p.near, (-w.n, p.near)) AS best, max(w.n) AS best_n FROM p JOIN w ON w.word = p.near GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM w LEFT JOIN o USING (word)),
t AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.next)
SELECT f.word, n, n_near, f.form, form_n, t.at AS root FROM f JOIN t ON t.word = f.word AND t.next IS NULL""",
    "op12_phrases": r"""
WITH p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM p, (VALUES (1), (2), (3), (4)) v(m) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
c AS (SELECT lang, phrase, m, ws, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.*, x.f AS l, y.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')),
b AS (SELECT lang, phrase, any_value(a) AS a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM s GROUP BY lang, phrase),
i AS (SELECT lang, f, ws, m, unnest(list_filter([1, 2, 3], lambda q: q <= m - 1)) AS i FROM f WHERE m > 2),
o AS (SELECT lang, array_to_string(ws[i:i + q - 1], ' ') AS phrase, max(f) AS f FROM i, (VALUES (2), (3)) v(q) WHERE q < m AND i + q - 1 <= m GROUP BY ALL),
k AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN o USING (lang, phrase) WHERE o.f IS NULL OR 100 * CAST(o.f AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN t USING (lang) WHERE rank <= 2000""",
    "op13_url_rules": r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
a AS (SELECT row_number() OVER () AS id, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT id, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
f AS (SELECT id, arg_max(r.host || r.path, (length(r.host || r.path), length(r.host))) AS rule, arg_max(verdict, (length(r.host || r.path), length(r.host))) AS verdict
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (id)""",
}
