"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ 1: mixing
from prefengine.llm import mixing  # noqa: E402

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS ord
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS idx FROM src),
weighed AS (
  SELECT *, ((idx - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM numbered),
filled AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, idx) AS step,
         coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(w) OVER (ORDER BY cap::DOUBLE / w, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM weighed),
level AS (
  SELECT step AS l_step, spent AS l_spent, open_w AS l_open FROM filled
  WHERE cap > (total - spent)::DOUBLE * w / open_w ORDER BY step LIMIT 1),
targets AS (
  SELECT f.*, CASE WHEN l_step IS NOT NULL AND step >= l_step THEN (total - l_spent)::DOUBLE * w::DOUBLE / l_open::DOUBLE ELSE cap::DOUBLE END AS target,
         greatest(1, least(2048, source_size // 1024))::BIGINT AS block
  FROM filled f LEFT JOIN level ON true),
spend AS (
  SELECT *, floor(target / source_size) AS rounds,
         least(round((target - floor(target / source_size) * source_size) / block) * block, source_size) AS rest
  FROM targets WHERE source_size > 0),
placed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT p.doc_id, p.source, p.size, p.source_size, p.target,
       coalesce(s.rounds * p.size + greatest(0, least(p.start + p.size, s.rest) - p.start), 0)::BIGINT AS taken
FROM placed p LEFT JOIN spend s ON p.source IS NOT DISTINCT FROM s.source
"""


@query("op1_mix_sources", MIX_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 1, 2, 3, repeating, each source at most three times over."""
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 7: quality
from prefengine.llm import quality  # noqa: E402


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document, learned outside the held-out fold."""
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


# ------------------------------------------------------------------ 2: HTML
from prefengine.llm import html  # noqa: E402


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


# ------------------------------------------------------------------ 4: WARC
from prefengine.llm import warc  # noqa: E402


#: base32 of the SHA-1 by groups of 5 hex digits, each 4 letters.
WARC_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, url, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(x, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to
FROM r
"""


@query("op4_warc", WARC_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to web-archive packages and read back by range."""
    read = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return read.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ------------------------------------------------------------------ 9: nearest neighbours
from prefengine.llm import ann  # noqa: E402


@query("op9_nearest")
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


# ------------------------------------------------------------------ 5: SimHash
from prefengine.llm import simhash  # noqa: E402


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, at most 4 differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


# ------------------------------------------------------------------ 6: toxicity
from prefengine.llm import toxicity  # noqa: E402


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every whole document, learned outside the held-out fold."""
    scored = toxicity.severity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "severity", "grade", "is_toxic")


# ------------------------------------------------------------------ 10: repeated substrings
from prefengine.llm import substrings  # noqa: E402


@query("op10_substrings")
def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every document if strings of 200 bytes that repeat are removed."""
    return substrings.repeats_digest(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 3: chat formatting
from prefengine.llm import chat  # noqa: E402

CHAT_SQL = r"""
WITH ordered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations),
hashed AS (
  SELECT conv_id, pos, md5(string_agg(md5(coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '')), ',') OVER
    (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS h FROM ordered),
ends AS (SELECT conv_id, max(pos) AS last FROM hashed GROUP BY conv_id),
whole AS (
  SELECT min(h.conv_id) AS conv_id, h.pos, h.h FROM hashed h JOIN ends e ON h.conv_id = e.conv_id AND h.pos = e.last GROUP BY h.pos, h.h),
continued AS (
  SELECT DISTINCT h.pos, h.h FROM hashed h JOIN ends e ON h.conv_id = e.conv_id AND h.pos < e.last),
kept AS (
  SELECT w.conv_id, w.pos + 1 AS n_turns FROM whole w WHERE NOT EXISTS (SELECT 1 FROM continued c WHERE c.pos = w.pos AND c.h = w.h))
SELECT o.conv_id, (o.pos // 256)::INTEGER AS part, k.n_turns::BIGINT AS n_turns,
       string_agg('<|im_start|>' || coalesce(o.role, 'unknown') || chr(10) || replace(coalesce(o.text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY o.pos) AS text
FROM ordered o JOIN kept k ON o.conv_id = k.conv_id
GROUP BY o.conv_id, o.pos // 256, k.n_turns
"""


@query("op3_chat_format", CHAT_SQL)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


# ------------------------------------------------------------------ 8: decontamination
from prefengine.llm import decontam  # noqa: E402


@query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they leak."""
    leaks = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "matched", "windows", "coverage", "exchanged")


# ------------------------------------------------------------------ 12: licences
from prefengine.llm import licenses  # noqa: E402


@query("op12_licenses", licenses.license_sql())
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every whole document."""
    return licenses.license_digest(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ 13: whitening
from prefengine.llm import whitening  # noqa: E402


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 16 whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


# ------------------------------------------------------------------ 11: hard negatives
from prefengine.llm import negatives  # noqa: E402

NEGATIVES_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM r a JOIN r b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS k FROM scored WHERE same) WHERE k <= 5),
fit AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM positive p JOIN scored n ON p.anchor = n.anchor AND NOT n.same
  WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM fit WHERE rank <= 10
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector, for each of its five positives."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))
