"""The queries of this subpackage, each an operator over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import leaks
from tidemark.llm.infill import fill_in_middle, restored
from tidemark.llm.language import fit_language, identify
from tidemark.llm.licenses import Template, scan_licenses, templates
from tidemark.llm.lines import line_index
from tidemark.llm.media import copies, render_vectors
from tidemark.llm.packing import pack, pieces
from tidemark.llm.pii import BASE, find_personal_data, joined
from tidemark.llm.repeats import remove_repeats
from tidemark.llm.runtime import table
from tidemark.llm.setjoin import near_duplicates
from tidemark.llm.sharding import shard
from tidemark.llm.toxicity import fit_toxicity, score_toxicity
from tidemark.llm.whitening import whiten

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _digest(text) -> object:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), whole=False).withColumnRenamed("kept", "kept_sha256")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus that comes in two batches; a part of the first is withdrawn and comes again with the second."""
    docs = table(spark, sf_dir, "documents")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    index = line_index(docs)
    index.insert(docs.where(part < 9))
    index.delete(docs.where(part == 8).select("doc_id"))
    index.insert(docs.where(part >= 8))
    out = index.strike(docs)
    return out.select("doc_id", "n_lines", "n_dropped", _digest(F.col("text")).alias("kept_sha256"))


ORACLE_SQL["op3_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line,
         translate(trim(parts[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
shared AS (
  SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT l.doc_id, l.i, l.line, (s.k IS NOT NULL AND l.doc_id <> s.keeper) AS gone
  FROM lines l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [_count("spans", k).alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"), F.size("spans").cast("long").alias("n_spans"), _count("spans", "key").alias("n_key"), _count("spans", "secret").alias("n_secret"))


def _fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels").where(_fold(5) != 0).select("doc_id", "toxic").distinct()
    language = fit_language(docs.where(_fold(5) != 0), per_language=300)
    model = fit_toxicity(docs, labels, language)
    return score_toxicity(docs, model).select("doc_id", (F.coalesce(_fold(5), F.lit(1)) == 0).alias("held_out"), "score", "predicted")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = fit_language(docs.where(_fold(3) != 1))
    return identify(docs, model).select("doc_id", (F.coalesce(_fold(3), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables have no images: vectors are rendered, and edited copies of every 20th besides."""
    out = copies(render_vectors(table(spark, sf_dir, "embeddings")))
    half = lambda c: F.shiftright(c, 1)
    return out.select(half("image_id").alias("vec_id"), (F.col("image_id") % 2 != 0).alias("edited"), "n_keypoints", half("component_id").alias("component_id"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), "score")


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    again = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _digest(F.col("output")).alias("output_sha256"), _digest(again).alias("restored_sha256"))


ORACLE_SQL["op13_fill_in_middle"] = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
    [CAST('0x' || substr(h, 1, 8) AS BIGINT), CAST('0x' || substr(h, 9, 8) AS BIGINT), CAST('0x' || substr(h, 17, 8) AS BIGINT), CAST('0x' || substr(h, 25, 8) AS BIGINT)] AS h FROM drawn),
placed AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b FROM cut),
parts AS (
  SELECT doc_id, text, n, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


ORACLE_SQL["op2_repeats"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
st AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
first AS (SELECT s, min(doc_id) AS least FROM st GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT st.doc_id, i FROM st JOIN first ON st.s = first.s WHERE first.least < st.doc_id),
fl AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS f FROM hit),
il AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM fl),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM il GROUP BY doc_id, run),
pieces AS (
  SELECT r.doc_id, r.a, r.b, substr(d.h, 2 * coalesce(lag(r.b) OVER w, 0) + 1, 2 * (r.a - coalesce(lag(r.b) OVER w, 0))) AS piece
  FROM runs r JOIN d ON r.doc_id = d.doc_id WINDOW w AS (PARTITION BY r.doc_id ORDER BY r.a)),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) AS head, max(b) AS last FROM pieces GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""

ORACLE_SQL["op9_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM reach r JOIN sides l ON r.b = l.x)
SELECT r.a AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _license_sql(known: list[Template]) -> str:
    """The same votes, diagonals and agreements over the templates' words."""
    tpl = _values((t, x.label, len(x.words), x.slack, x.base) for t, x in enumerate(known))
    grams = _values((t, i, " ".join(x.words[i : i + 3])) for t, x in enumerate(known) for i in range(len(x.words) - 2))
    telling = _values((t, p) for t, x in enumerate(known) for p in x.telling)
    return rf"""
WITH tpl AS (SELECT * FROM (VALUES {tpl}) t(template, label, size, slack, base)),
grams AS (SELECT * FROM (VALUES {grams}) t(template, pt, gram)),
telling AS (SELECT * FROM (VALUES {telling}) t(template, p)),
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
v AS (SELECT DISTINCT doc_id, template, pos - pt AS diagonal, pos, pt FROM g JOIN grams USING (gram)),
fl AS (SELECT v.*, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, v.template ORDER BY diagonal, pos) <= slack THEN 0 ELSE 1 END AS f FROM v JOIN tpl ON v.template = tpl.template),
il AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, template ORDER BY diagonal, pos ROWS UNBOUNDED PRECEDING) AS place FROM fl),
cov AS (SELECT doc_id, template, place, count(DISTINCT pt + j) AS covered FROM il, range(0, 3) r(j) GROUP BY 1, 2, 3),
told AS (
  SELECT i.doc_id, i.template, i.place, count(DISTINCT t.p) AS told FROM il i JOIN telling t ON i.template = t.template AND i.pt > t.p - 3 AND i.pt <= greatest(t.p - 1, 0) GROUP BY 1, 2, 3),
ext AS (SELECT doc_id, template, place, min(pos) AS s, max(pos) + 3 AS e FROM il GROUP BY 1, 2, 3),
pl AS (
  SELECT ext.*, label, base, covered::DOUBLE / greatest(size, e - s) AS agreement, coalesce(told, 0) AS told, (SELECT count(*) FROM telling t WHERE t.template = ext.template) AS needed
  FROM ext JOIN cov USING (doc_id, template, place) LEFT JOIN told USING (doc_id, template, place) JOIN tpl ON ext.template = tpl.template),
ok AS (SELECT * FROM pl WHERE agreement >= CASE WHEN base THEN 1.0 ELSE 0.8 END AND told = needed),
sc AS (SELECT doc_id, max(agreement) AS score FROM pl GROUP BY doc_id),
su AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM ok GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN su ON w.doc_id = su.doc_id LEFT JOIN sc ON w.doc_id = sc.doc_id
"""


ORACLE_SQL["op12_licenses"] = _license_sql(templates())
