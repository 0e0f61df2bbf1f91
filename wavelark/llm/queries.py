"""The queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, langid, linededup, mixing, ngramjoin, packing, pii, quality, search, sharding, toxicity

SHARDS = 16
#: Weights of the sources of the mix, in turn.
SOURCE_WEIGHTS = [3, 1, 2]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.decode_documents(bpe.encode_documents(documents(spark, sf_dir), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans_of(documents(spark, sf_dir), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda x: x["rank"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    names = F.array(*map(F.lit, pii.KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(documents(spark, sf_dir), labels, ["doc_id"])


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join_similar(documents(spark, sf_dir))


def op5_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), [1.0] * SHARDS)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(documents(spark, sf_dir), SOURCE_WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = alignment.align_documents(documents(spark, sf_dir), a, b, digests=True)
    return rows.withColumnRenamed("groups", "groups_sha256")


OP7_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM doc
), wins AS (
  SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twins AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM wins) WHERE c > 1
), repeats AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twins) GROUP BY r
), line AS (
  SELECT r, doc_id, host, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS line, count(*) AS times
  FROM (SELECT r, doc_id, host, unnest(string_split(text, chr(10))) AS x FROM doc) GROUP BY ALL
), sizes AS (
  SELECT host, count(DISTINCT doc_id) AS docs FROM doc GROUP BY host
), often AS (
  SELECT host, line, min(doc_id) AS first FROM line JOIN sizes USING (host) WHERE line <> ''
  GROUP BY host, line, docs HAVING count(DISTINCT doc_id) >= 20 AND count(DISTINCT doc_id) >= least(0.01 * docs, 1000)
), lost AS (
  SELECT r, sum(length(line) * times) AS lost FROM line JOIN often USING (host, line) WHERE doc_id IS DISTINCT FROM first GROUP BY r
), counted AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM doc) d
  JOIN words USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r)
), ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND NOT lost_chars > 0.7 * (word_chars + n_words) AS kept FROM ruled
"""

OP10_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM cut
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), frequent AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.holder AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP11_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), corpus AS (
  SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS docs, sum(len(terms))::BIGINT AS words FROM doc
), asked AS (
  SELECT DISTINCT item, item_id, term FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), posting AS (
  SELECT r, doc_id, term, n, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM doc) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posting, corpus GROUP BY term, docs
), scored AS (
  SELECT item, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN posting USING (term), corpus GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= 50
"""

OP12_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), keyed AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || size), 1, 15))::BIGINT AS key FROM sized
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sized GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS ratio FROM sums
), filled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM levels
), goals AS (
  SELECT source, source_size, CASE WHEN level >= ratio THEN most ELSE weight * max(CASE WHEN level < ratio THEN level END) OVER () END AS target FROM filled
), cut AS (
  SELECT k.*, source_size, target, coalesce(floor(target)::BIGINT // nullif(source_size, 0), 0) AS epochs,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(floor(target)::BIGINT - epochs * source_size - before, 0), size))::BIGINT AS taken FROM cut
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_pii": op2_pii, "op3_toxicity": op3_toxicity, "op4_ngram_join": op4_ngram_join, "op5_curves": op5_curves, "op6_language": op6_language, "op7_line_frequency": op7_line_frequency, "op8_packing": op8_packing, "op9_rendezvous": op9_rendezvous, "op10_line_dedup": op10_line_dedup, "op11_tput": op11_tput, "op12_mixing": op12_mixing, "op13_alignment": op13_alignment}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_frequency": OP7_SQL, "op10_line_dedup": OP10_SQL, "op11_tput": OP11_SQL, "op12_mixing": OP12_SQL}
