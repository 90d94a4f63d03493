"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorcast.llm import (
    html_wrappers,
    mixing,
    near_texts,
    near_vectors,
    packing,
    quality,
    repeats,
    runs,
    secret_scan,
    settings,
    token_counts,
    topk,
    warc,
    whitening,
)
from sensorcast.llm.shipping import ship
from sensorcast.staging import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.main_text(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        _table(spark, sf_dir, "documents"),
        settings.BYTE_BPE,
        settings.BYTE_BPE_RANKS,
        settings.BYTE_BPE_PATTERN,
        settings.TOKENS_PER_SEQUENCE,
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col(found.columns[-1])
    shown = secret_scan.as_text(spans)
    counts = [secret_scan.count_of(spans, n).alias(f"n_{rule.kind}") for n, rule in enumerate(secret_scan.RULES)]
    return found.select("doc_id", *counts, F.sha2(shown, 256).alias("base_sha256"), shown.alias("spans"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select(
        "doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade")
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.score(documents, quality.train(documents, ratings(spark, sf_dir)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def mixed(documents: DataFrame) -> DataFrame:
    return mixing.mix(
        documents, settings.SOURCE_SHARES, settings.LANG_SHARES, settings.TOPIC_SHARES, settings.KEEP
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixed(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return made.select("doc_id", f"{made.columns[-1]}.*")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), settings.PIECE_BPE, settings.TOKEN_LIMIT)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Periodic runs for a tenth of the documents: from some word on, the words repeat."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    begin = g % n
    period = 1 + (n - begin) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < begin, at, begin + (at - begin) % period)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_table(spark, sf_dir, "documents"), planted)
    line = lambda r: F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")])
    shown = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(shown, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_packing": op2_packing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixing": op7_mixing,
    "op8_topk_search": op8_topk_search,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_warc": op12_warc,
    "op13_periodic_runs": op13_periodic_runs,
}

_SPACED = r"[^\x20\x09-\x0D]+"
# Smallest node that each node of ``nodes`` reaches over ``links`` (a, b; both directions).
_REACHED = """reach AS (
  SELECT id AS a, id AS b FROM nodes
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1)"""


def _spans_sql(kind: int, pattern: str, flags: str, test: str) -> str:
    """Spans of one rule: every match between two control characters that the texts lack, so that the lengths of the
    pieces give the places."""
    return f"""
  SELECT k, {kind} AS kind, start, start + length(piece) AS stop FROM (
    SELECT k, piece, sum(length(piece) + length(rest)) OVER (PARTITION BY k ORDER BY n) - length(piece) - length(rest) AS start, n
    FROM (
      SELECT k, n, CASE WHEN n = 1 THEN '' ELSE string_split(part, chr(2))[1] END AS piece,
        CASE WHEN n = 1 THEN part ELSE string_split(part, chr(2))[2] END AS rest
      FROM (
        SELECT k, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM (
          SELECT k, string_split(regexp_replace(text, '({pattern})', chr(1) || '\\1' || chr(2), '{flags}'), chr(1)) AS parts FROM d))))
  WHERE n > 1 AND {test}"""


_ASSIGN = (
    r"""(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?""",
    r"""[A-Za-z0-9+/_.=-]+""",
)

# SQL whose rows equal a query's.
ORACLES = {
    "op3_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{_SPACED}') AS w
  FROM documents),
sets AS (
  SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS shingles
  FROM d),
each AS (SELECT id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT x.id AS a, y.id AS b FROM each x JOIN each y ON x.shingle = y.shingle AND x.id <> y.id
  GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
nodes AS (SELECT id FROM sets),
{_REACHED}
SELECT s.id AS doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, l.component AS component_id, l.component = s.id AS kept
FROM sets s JOIN least l ON l.id = s.id""",
    "op4_secret_scan": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_spans_sql(0, _ASSIGN[0] + _ASSIGN[1], "gi", f"length(regexp_extract(piece, '^{_ASSIGN[0]}({_ASSIGN[1]})$', 1, 'i')) >= 8")}
  UNION ALL {_spans_sql(1, "AKIA[A-Z0-9]+", "g", "length(piece) >= 16")}
  UNION ALL {_spans_sql(2, "[0-9a-f]+", "g", "length(piece) >= 32")}),
joined AS (
  SELECT k, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) AS spans
  FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (k)""",
    "op6_substring_dedup": rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
places AS (SELECT k, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
named AS (
  SELECT k, word, i, CASE WHEN i + 34 <= len(w) THEN sha256(array_to_string(w[i : i + 34], ' ')) END AS seq FROM places),
counted AS (SELECT k, word, i, seq IS NOT NULL AND count(*) OVER (PARTITION BY seq) > 1 AS again FROM named),
covered AS (
  SELECT k, word, i, coalesce(bool_or(again) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
  FROM counted),
made AS (
  SELECT k, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM covered GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN made USING (k)""",
    "op9_embedding_near_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.label = y.label AND x.id <> y.id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings),
counts AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY 1),
{_REACHED}
SELECT n.id AS vec_id, coalesce(c.n_links, 0) AS n_links, l.component AS component_id, l.component = n.id AS kept
FROM nodes n JOIN least l ON l.id = n.id LEFT JOIN counts c ON c.id = n.id""",
    "op8_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op12_warc": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
named AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS origin
  FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN origin = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN origin <> page_id THEN origin END AS refers_to
FROM named""",
}
