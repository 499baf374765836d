"""The thin contract queries: each gets its rows from its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, html_extract, katz, line_dedup, mixing, packing, quality, simhash, toxicity, warc
from docloom.llm.common import in_fold, read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.resolve(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.cluster(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest_pieces(packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(read_table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_table(read_table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(read_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    rows = toxicity.score_table(docs, toxicity.fit(docs, labels))
    return rows.select("doc_id", in_fold(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.judge(docs, quality.train_on(docs, labels))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.clean_pages(read_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "n_lines", "n_dropped", F.concat_ws("\n", "kept_lines").alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_exact_dedup, op2_simhash, op3_packing, op4_katz, op5_html_extract, op6_warc, op7_toxicity, op8_quality, op9_mixing, op10_line_dedup]
    return {f.__name__: f for f in own}


_SPACE = r"[\x20\x09-\x0D]"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_points,
                  sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS text_sha256,
                  row_number() OVER () AS pos
           FROM documents),
     r AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                  first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
           FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST, pos))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""

OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex,
                  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response
           FROM pages),
     bits AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789ABCDEF', substr(hex, CAST(i AS BIGINT), 1)) - 1), 4, '0')), 'string_agg', '') AS b FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda k: CASE WHEN substr(b, CAST(1 + 5 * i + k AS BIGINT), 1) = '1' THEN 1 << CAST(4 - k AS INT) ELSE 0 END)) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM response THEN NULL ELSE response END AS refers_to
FROM bits
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, 3.0::DOUBLE * source_size AS most,
                  [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS weight FROM s),
filled AS (
  SELECT *, most / weight AS fill,
         (sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ranked WINDOW w AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (SELECT level FROM filled WHERE fill > level ORDER BY fill, source IS NULL, source LIMIT 1),
goals AS (SELECT source, source_size, CASE WHEN fill <= filled.level OR (SELECT count(*) FROM first) = 0 THEN most
                 ELSE weight * (SELECT level FROM first) END AS target FROM filled),
queued AS (
  SELECT d.*, g.source_size, g.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent
  FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT q.*, r.round, CAST(source_size * r.round + sent AS DOUBLE) / target AS finish
  FROM queued q, (SELECT unnest([0, 1, 2]) AS round) r WHERE size > 0),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, coalesce(source, ''), key, coalesce(CAST(doc_id AS VARCHAR), ''), size, round
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM copies),
cut AS (SELECT doc_id, source, key, size, sent, count(*) AS n FROM served
        WHERE total <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(c.n, 0) * q.size AS BIGINT) AS taken
FROM queued q LEFT JOIN cut c ON q.doc_id IS NOT DISTINCT FROM c.doc_id AND q.source IS NOT DISTINCT FROM c.source AND q.sent = c.sent AND q.size = c.size
"""

_BLOCKS = "|".join(line_dedup.BLOCK_TAGS)
OP10_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS pos, page_id,
         lower(regexp_extract(coalesce(url, ''), '{line_dedup.HOST}', 1)) AS host,
         list_filter(list_transform(regexp_split_to_array(
           regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{line_dedup.HIDDEN}', '', 'g'), '{line_dedup.BLOCK}', chr(10), 'g'), '{line_dedup.TAG}', '', 'g'),
           '[\r\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
counts AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
common AS (SELECT host, list(line) AS lines FROM counts JOIN totals USING (host) WHERE n > 1 AND n / pages > 0.05 GROUP BY host),
kept AS (SELECT p.*, list_filter(p.lines, lambda x: NOT list_contains(coalesce(c.lines, []), x)) AS rest FROM p LEFT JOIN common c USING (host))
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(rest) AS n_dropped, coalesce(array_to_string(rest, chr(10)), '') AS text FROM kept
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force."""
    return {"op1_exact_dedup": OP1_SQL, "op6_warc": OP6_SQL, "op9_mixing": OP9_SQL, "op10_line_dedup": OP10_SQL}
