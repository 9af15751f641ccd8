"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import decontaminate, edit_counts, fertility, langid, segmentation, shards, simhash, toxicity, urlfilter, warc
from quillmill.llm.common import held_out, table


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.planned_responses(table(spark, sf_dir, "pages")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = urlfilter.filter_captures(urlfilter.planned_captures(pages), urlfilter.planned_events(pages))
    return found.withColumn("fetched", F.unix_seconds("fetched"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "fingerprint", "component_id")


def op8_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.segment(table(spark, sf_dir, "documents"))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return edit_counts.edit_counts(docs, edit_counts.planned_edits(F.col("text")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = shards.ingest(table(spark, sf_dir, "documents")).read_with_shards()
    shard, version = stored.columns[-2:]
    return stored.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col(shard).alias("shard"), F.col(version).alias("version"))


# Parts of operators that SQL can express, for operators that it can't express whole.


def fertility_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's base counts and rule."""
    judged = op5_fertility(spark, sf_dir)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_SQL = r"""
WITH w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2])) AS s FROM w WHERE len(w) > 2
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM s) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's trees, stars and components over given fingerprints: 64 bits of documents' MD5, of which all but some are set alike."""
    docs = table(spark, sf_dir, "documents")
    number = lambda at, n: F.conv(F.substring(F.md5("text"), at, n), 16, 10).cast("long")
    fp = F.shiftleft(number(1, 2), 54).bitwiseOR(F.shiftleft(number(3, 2), 30)).bitwiseOR(number(5, 2))
    given = docs.select("doc_id", fp.alias("fp"))
    named = simhash.group_fingerprints(given)
    return named.select("doc_id", "fp", "component_id")


SIMHASH_SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, (('0x' || substr(md5(text), 1, 2))::BIGINT << 54) | (('0x' || substr(md5(text), 3, 2))::BIGINT << 30) | ('0x' || substr(md5(text), 5, 2))::BIGINT AS fp FROM documents
), d AS (SELECT fp, min(doc_id) AS doc_id FROM f GROUP BY fp),
links AS (SELECT a.fp AS a, b.fp AS b FROM d a JOIN d b ON bit_count(xor(a.fp, b.fp)) <= 3),
reach AS (
  SELECT fp AS a, doc_id FROM d
  UNION
  SELECT links.b, reach.doc_id FROM reach JOIN links ON links.a = reach.a
)
SELECT f.doc_id, f.fp, r.component_id FROM f JOIN (SELECT a, min(doc_id) AS component_id FROM reach GROUP BY a) r ON r.a = f.fp
"""


def shard_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10's last version holds."""
    stored = shards.ingest(table(spark, sf_dir, "documents")).read()
    return stored.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


SHARD_SQL = "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents"


def held_out_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents no label may be learned from, as op2 and op6 report it."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"))


def _crc32_sql() -> str:
    """CRC-32 of the id's digits, bit by bit."""
    step = "list_reduce(list_prepend(xor({x}, ascii(c)), [1, 1, 1, 1, 1, 1, 1, 1]), lambda r, b: xor(r >> 1, (r & 1) * 3988292384))"
    fold = step.replace("{x}", "r.v").replace("xor(r.v, ascii(c))", "xor(v, ascii(t[i + 1])::BIGINT)")
    return f"""
WITH RECURSIVE s AS (SELECT doc_id, doc_id::VARCHAR AS t, 0 AS i, 4294967295::BIGINT AS v FROM documents
  UNION ALL SELECT doc_id, t, i + 1, {fold} FROM s WHERE i < length(t))
SELECT doc_id, xor(v, 4294967295) % 5 = 0 AS held_out FROM s WHERE i = length(t)
"""


OP1_SQL = r"""
WITH c AS (
  SELECT page_id, url, to_timestamp(1704067200 + 60 * (('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT % 527040)) AS fetched,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda p: p <> '') AS parts
  FROM pages
), h AS (
  SELECT DISTINCT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM c WHERE host IS NOT NULL
), x AS (
  SELECT host, domain, ('0x' || substr(md5(host), 1, 3))::BIGINT % 200 AS a, ('0x' || substr(md5(host), 4, 3))::BIGINT % 120 + 1 AS n,
    ('0x' || substr(md5(host), 7, 3))::BIGINT % 3 AS b, ('0x' || substr(md5(host), 10, 3))::BIGINT % 4 AS p,
    ('0x' || substr(md5(domain), 13, 3))::BIGINT % 2 AS t, ('0x' || substr(md5(domain), 1, 3))::BIGINT % 200 AS s
  FROM h
), v AS (
  SELECT 'adult' AS l, 'block' AS v, 'd:' || host AS k, a AS d1, a + n AS d2 FROM x WHERE b = 0
  UNION ALL SELECT 'adult', 'block', 'd:' || host, a + n + 60, NULL FROM x WHERE b = 0
  UNION ALL SELECT 'spam', 'block', 'p:' || host || '/en', a + 30, NULL FROM x WHERE p = 0
  UNION ALL SELECT DISTINCT 'trusted', 'allow', 'd:' || domain, s, NULL FROM x WHERE t = 0
), k AS (
  SELECT page_id, fetched, 'd:' || array_to_string(string_split(host, '.')[-i:], '.') AS k, i AS rank
  FROM (SELECT page_id, fetched, host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host IS NOT NULL)
  UNION ALL
  SELECT page_id, fetched, 'p:' || host || '/' || array_to_string(parts[1:i], '/'), i + 100000
  FROM (SELECT page_id, fetched, host, parts, unnest(range(1, len(parts) + 1)) AS i FROM c WHERE host IS NOT NULL)
), hit AS (
  SELECT page_id, v.l, v.v, v.k, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, v.v, v.l, v.k) AS rn, count(*) OVER (PARTITION BY page_id) AS n
  FROM k JOIN v ON k.k = v.k AND fetched >= to_timestamp(1704067200 + 86400 * d1) AND (d2 IS NULL OR fetched < to_timestamp(1704067200 + 86400 * d2))
)
SELECT c.page_id, c.url, epoch(c.fetched)::BIGINT AS fetched, coalesce(hit.v, 'pass') AS decision, hit.l AS list_name, hit.k AS matched_key, coalesce(n, 0) AS n_matches
FROM c LEFT JOIN hit ON c.page_id = hit.page_id AND rn = 1
"""

OP4_SQL = r"""
WITH words AS (
  SELECT doc_id AS id, 'd' AS side, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT item_id, 'b', list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark
), shingles AS (
  SELECT DISTINCT id, side, array_to_string(w[i + 1 : i + 5], ' ') AS s
  FROM (SELECT id, side, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT id, count(*) AS n FROM shingles WHERE side = 'b' GROUP BY id),
pairs AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared
  FROM shingles d JOIN shingles b ON d.s = b.s AND d.side = 'd' AND b.side = 'b' GROUP BY 1, 2
)
SELECT doc_id, item_id, n AS item_shingles, shared AS shared_shingles, shared / n AS containment
FROM pairs JOIN sizes ON id = item_id WHERE shared >= 0.8 * n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_urlfilter": op1_urlfilter,
        "op2_toxicity": op2_toxicity,
        "op3_warc": op3_warc,
        "op4_decontaminate": op4_decontaminate,
        "op5_fertility": op5_fertility,
        "op6_langid": op6_langid,
        "op7_simhash": op7_simhash,
        "op8_segmentation": op8_segmentation,
        "op9_edit_counts": op9_edit_counts,
        "op10_sharding": op10_sharding,
        "fertility_base": fertility_base,
        "simhash_components": simhash_components,
        "shard_content": shard_content,
        "held_out_rows": held_out_rows,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_urlfilter": OP1_SQL,
        "op3_warc": warc.sql(),
        "op4_decontaminate": OP4_SQL,
        "fertility_base": BASE_SQL,
        "simhash_components": SIMHASH_SQL,
        "shard_content": SHARD_SQL,
        "held_out_rows": _crc32_sql(),
    }
