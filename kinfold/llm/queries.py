"""One query per operator, over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottom_k, decontaminate, filter_audit, host_quality, ngram_jaccard, packing, periodic_runs, ppm
from . import recompression, sharding, surrogates, tokens, toxicity, wavelet
from .common import let, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols
  FROM w),
lines AS (
  SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS win
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c >= 2),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM hit GROUP BY 1),
f AS (
  SELECT m.*, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats,
         100 * n_dup_lines > 3 * n_words AS dup_lines, 10 * n_symbols > 3 * n_words AS symbols FROM f),
h AS (
  SELECT source, rule, count(*) AS n, sum(fails::INT) AS k FROM (
    SELECT source, unnest(['short', 'repeats', 'dup_lines', 'symbols']) AS rule,
           unnest([short, repeats, dup_lines, symbols]) AS fails FROM r WHERE source IS NOT NULL)
  GROUP BY 1, 2),
p AS (SELECT rule, avg(n) AS mean_n, avg(k / n) AS p, var_pop(k / n) AS v FROM h GROUP BY 1),
s AS (SELECT *, CASE WHEN v > 1e-12 THEN greatest(p * (1 - p) / v - 1, 1) ELSE 100 * mean_n END AS s FROM p),
bad AS (
  SELECT DISTINCT source FROM h JOIN s USING (rule)
  WHERE (k + p * s) / (n + s) > CASE WHEN rule IN ('short', 'repeats') THEN 0.5 ELSE 0.6 END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       short OR repeats AS base_failed,
       NOT (short OR repeats) AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM r
"""


@query(OP9_SQL)
def op9_host_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    out, m, failed, kept = host_quality.judge(docs)
    return out.select("doc_id", *[f"{m}.{f}" for f in host_quality.FIELDS], failed, kept)


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS span
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS span
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
hit AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN iw USING (k, span)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query(OP4_SQL)
def op4_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    out = decontaminate.report(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op5_surrogates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    out, count = surrogates.replace_entities(docs)
    return out.select("doc_id", "text", F.col(count).alias("n_entities"))


@query()
def op6_best_fit(spark: SparkSession, d: str) -> DataFrame:
    path = tokens.tokenizer_path("word_bpe_49k.json")
    return packing.pack(table(spark, d, "documents"), path)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (gram)
      WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id
         WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
low AS (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


@query(OP1_SQL)
def op1_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    out = ngram_jaccard.jaccard_components(table(spark, d, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


@query()
def op10_label_propagation(spark: SparkSession, d: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, d, "documents"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op8_wavelet_matrix(spark: SparkSession, d: str) -> DataFrame:
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    return wavelet.encode(table(spark, d, "documents"), path)[0]


@query()
def op3_ppm(spark: SparkSession, d: str) -> DataFrame:
    return ppm.score(table(spark, d, "documents"))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
twice AS (SELECT doc_id, i FROM win WHERE md5(s) IN (SELECT md5(s) FROM win GROUP BY 1 HAVING count(*) > 1)),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM twice) GROUP BY 1),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM word LEFT JOIN (SELECT doc_id, unnest(ps) AS p, true AS gone FROM gone) g USING (doc_id, p)
  WHERE gone IS NULL GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query(OP7_SQL)
def op7_recompression(spark: SparkSession, d: str) -> DataFrame:
    out = recompression.remove_repeats(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query()
def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
f AS (
  SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > low, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM e p, e q, e r, e s, e t WHERE p.b + q.b + r.b + s.b + t.b = 31
    AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
st AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
       FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, st GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


@query(OP11_SQL)
def op11_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


def planted_runs(doc_id: Column, text: Column) -> Column:
    """The text with the periodic stretch that the query asks for in a tenth of the documents."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / F.lit(10))

    def replaced(ws: Column) -> Column:
        n = F.size(ws)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.when(
            n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, place(i))), " ")
        ).otherwise("")

    words = F.array_remove(F.split(text, filter_audit.SPACES, -1), "")
    return F.when((h % 10 == 0) & text.isNotNull(), let(words, replaced)).otherwise(text)


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
-- CRC-32 by bytes: a table of 256 entries from the polynomial, then a fold.
tab AS (
  SELECT list(v ORDER BY b) AS tab FROM (
    SELECT b, list_reduce([b::BIGINT] || [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[],
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS b))),
h AS (
  SELECT doc_id, xor(4294967295::BIGINT, list_reduce(
           [4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT),
           lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) AS h
  FROM documents, tab WHERE doc_id IS NOT NULL),
g AS (
  SELECT t.doc_id, ws, len(ws) AS n, coalesce(h % 10 = 0, false) AND len(ws) > 0 AS planted, h // 10 AS g
  FROM t LEFT JOIN h USING (doc_id)),
p AS (SELECT *, CASE WHEN planted THEN g % n ELSE 0 END AS a,
             CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) ELSE 0 END AS p FROM g),
word AS MATERIALIZED (
  SELECT doc_id, i, CASE WHEN planted AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w
         FROM (SELECT *, unnest(range(0, n)) AS i FROM p)),
grid AS MATERIALIZED (
  SELECT doc_id, q, unnest(range(0, n - 3 * q, q)) AS i
  FROM (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM p WHERE n >= 6)),
-- A run of period q holds three places i, i + q, i + 2 q of the grid, each with the word q further on.
g0 AS MATERIALIZED (SELECT grid.*, w FROM grid JOIN word USING (doc_id, i)),
g1 AS MATERIALIZED (SELECT g0.* FROM g0 JOIN word o ON o.doc_id = g0.doc_id AND o.i = g0.i + q AND o.w = g0.w),
g2 AS MATERIALIZED (SELECT g1.* FROM g1 JOIN word o ON o.doc_id = g1.doc_id AND o.i = g1.i + 2 * q AND o.w = g1.w),
cand AS MATERIALIZED (
  SELECT DISTINCT g2.doc_id, q FROM g2
  JOIN word o ON o.doc_id = g2.doc_id AND o.i = g2.i + 3 * q AND o.w = g2.w),
ahead AS MATERIALIZED (
  SELECT c.doc_id, c.q, x.i, x.w, x.i + c.q AS j FROM cand c JOIN word x ON x.doc_id = c.doc_id),
same AS (
  SELECT a.doc_id, a.q, a.i FROM ahead a JOIN word y ON y.doc_id = a.doc_id AND y.i = a.j AND y.w = a.w),
stretch AS (
  SELECT doc_id, q, min(i) AS s, max(i) + q - min(i) + 1 AS len FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM same)
  GROUP BY doc_id, q, isle HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, s, len, min(q) AS q FROM stretch GROUP BY 1, 2, 3),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
top AS (
  SELECT doc_id, count(*) AS n_runs, arg_min([s, len, q], [-len, s, q]) AS best,
         string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS all_runs
  FROM run GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[1]::BIGINT AS "start", best[2]::BIGINT AS "length",
       best[3]::BIGINT AS "period", (1000 * best[2] // best[3])::BIGINT AS exponent_milli,
       sha256(coalesce(all_runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query(OP12_SQL)
def op12_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    out, _, runs, collapsed = periodic_runs.runs(docs)
    ordered = F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"], r["period"]))
    out = out.withColumn("top", F.array_max(ordered))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return out.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(runs, line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col(collapsed).cast("binary"), 256).alias("collapsed_sha256"),
    )


OP13_SQL = OP1_SQL.replace("ws[i:i + 4]", "ws[i:i + 1]").replace("len(ws) - 4", "len(ws) - 1").replace(
    "AS component_id\n", "AS component_id,\n       w.doc_id <= coalesce(m, w.doc_id) AS kept\n"
)


@query(OP13_SQL)
def op13_bottom_k(spark: SparkSession, d: str) -> DataFrame:
    return bottom_k.near_copies(table(spark, d, "documents"))
