"""Registered queries of the numbered operators: each maps a given table to an operator's records and back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import (
    bpe_codec, language_model, line_rules, name_variants, near_copies, page_text, quality_model, scenario_leaks, secrets, token_counts, token_store,
    vector_copies, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as events: the text is the raw record, its source the sensor."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("event_id"), F.col("text").alias("raw"), F.col("source").alias("sensor"), "lang"
    )


@query
def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_codec.encode_records(records(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return bpe_codec.record_digests(encoded).withColumnRenamed("event_id", "doc_id")


@query
def op3_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_budget(records(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
    return counted.withColumnRenamed("event_id", "doc_id")


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("findings")
    return secrets.scan_records(records(spark, sf_dir)).select(
        F.col("event_id").alias("doc_id"),
        *[secrets.count_of(found, kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.listed(secrets.base_only(found)).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(found).alias("spans"),
    )


@query
def op7_wavelet_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_token_shards(records(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    stored = token_store.read_token_shards(spark, folder)
    return stored.select(F.col("event_id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


OP10_WORDS = """base AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host, row_number() OVER () AS r FROM {docs}),
cut AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM base),
win AS (
  SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM cut WHERE len(ws) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(8) AS x(k) GROUP BY r),
line AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS l FROM base),
full_line AS (
  SELECT *, lower(trim(translate(l, chr(9) || chr(11) || chr(12) || chr(13) || '123456789', '    000000000'))) AS norm
  FROM line WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
hosts AS (SELECT host, count(DISTINCT t) AS of FROM base GROUP BY host),
common AS (
  SELECT host, norm FROM full_line JOIN hosts USING (host)
  GROUP BY host, norm, of HAVING count(DISTINCT t) > {limit} AND 100 * count(DISTINCT t) > of),
per AS (
  SELECT r, count(*) - count(DISTINCT l) AS dup, sum(length(l)) AS total,
    coalesce(sum(length(l)) FILTER ((host, norm) IN (SELECT (host, norm) FROM common)), 0) AS removed,
    list_sort(list_distinct(list(norm) FILTER ((host, norm) IN (SELECT (host, norm) FROM common)))) AS lines
  FROM full_line GROUP BY r),
ruled AS (
  SELECT c.*, len(ws) AS n_words, coalesce(cov.n, 0) AS n_repeat_words, coalesce(per.dup, 0) AS n_dup_lines,
    len(ws) < 20 OR 100 * coalesce(cov.n, 0) > 30 * len(ws) AS base_failed,
    coalesce(per.removed, 0) AS removed, coalesce(per.total, 0) AS total, per.lines
  FROM cut c LEFT JOIN cov USING (r) LEFT JOIN per USING (r)),
holder AS (SELECT host, lines, min(doc_id) AS first FROM ruled WHERE NOT base_failed AND removed > 0 GROUP BY host, lines),
judged AS (
  SELECT ruled.*, coalesce(doc_id = first, false) AS holds FROM ruled LEFT JOIN holder ON holder.host = ruled.host AND holder.lines = ruled.lines)"""


def line_quality_sql(limit: int) -> str:
    return (
        "WITH "
        + OP10_WORDS.format(docs="documents", limit=limit)
        + """
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS bigint) AS word_chars,
  cast(length(t) - length(translate(t, '#*$%&|<>', '')) AS bigint) AS n_symbols, cast(n_dup_lines AS bigint) AS n_dup_lines,
  cast(n_repeat_words AS bigint) AS n_repeat_words, cast(removed AS bigint) AS removed_chars, base_failed,
  NOT base_failed AND (holds OR 100 * removed <= 50 * total) AS kept
FROM judged"""
    )


ORACLES["op10_line_quality"] = line_quality_sql(100)
# The same rule with a limit that lines of the small tables pass.
ORACLES["low_line_limit"] = line_quality_sql(3)


@query
def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_quality(records(spark, sf_dir)).withColumnRenamed("event_id", "doc_id")


@query
def low_line_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_quality(records(spark, sf_dir), max_documents=3).withColumnRenamed("event_id", "doc_id")


def part_of(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


@query
def op4_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = records(spark, sf_dir)
    model = language_model.train_language(events.filter(part_of("event_id", 4) != 2))
    found = language_model.identify_language(events, model)
    return found.select(F.col("event_id").alias("doc_id"), (part_of("event_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = records(spark, sf_dir)
    reviews = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("event_id"), F.col("quality").alias("label"))
    model = quality_model.train_quality(events, reviews.filter(part_of("event_id", 5) != 0))
    scored = quality_model.score_quality(events, model, threshold=0.3)
    return scored.select(F.col("event_id").alias("doc_id"), (part_of("event_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    keyed = pages.select(F.struct("page_id", "url").alias("page_id"), "html")
    found = page_text.extract_text(keyed, page_text.train_pages(pages))
    return found.select("page_id.page_id", "page_id.url", "text", F.length("text").cast("long").alias("n_chars"))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("scenario_id"), F.col("text").alias("raw"))


@query
def op5_scenario_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scenario_leaks.find_leaks(records(spark, sf_dir), scenarios(spark, sf_dir))
    return found.withColumnsRenamed({"event_id": "doc_id", "scenario_id": "item_id"})


@query
def op1_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(records(spark, sf_dir), width=4, percent=85).withColumnRenamed("event_id", "doc_id")


def flow_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as feature vectors of flows."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("flow_id"), F.col("embedding").alias("features"), "label")


@query
def op11_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten_flows(flow_vectors(spark, sf_dir))
    each = made.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part"))
    return each.select(
        F.col("flow_id").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        "n",
        F.col("deviation").try_cast("long").alias("deviation"),
        "part.whitened",
        "part.explained",
        "identity_error",
    )


@query
def op12_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_copies.near_flows(flow_vectors(spark, sf_dir), least=0.98).withColumnRenamed("flow_id", "vec_id")


def written_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least seven letters, A-Z lowered; where 31 divides the checksum of document and run, one letter is left out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\u00C0-\u00FF]{7,}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(h, F.length("run").cast("long")).cast("int")
    left = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(h % 31 == 0, left).otherwise(F.col("run")).alias("label"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = name_variants.label_variants(written_words(spark, sf_dir), least_length=7, least_seen=2, ratio=10)
    return found.withColumnRenamed("label", "word")


_CRC_TABLE = """SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) AS x(i))"""

ORACLES["op13_spelling_variants"] = (
    "WITH RECURSIVE crc AS MATERIALIZED ("
    + _CRC_TABLE
    + """),
run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
seen AS (SELECT doc_id, run, count(*) AS n FROM run WHERE length(run) >= 7 GROUP BY doc_id, run),
bytes AS (
  SELECT *, list_transform(range(1, octet_length(encode(coalesce(cast(doc_id AS varchar), '') || ':' || run)) + 1),
    lambda i: cast('0x' || substr(hex(encode(coalesce(cast(doc_id AS varchar), '') || ':' || run)), cast(2 * i - 1 AS int), 2) AS bigint)) AS b FROM seen),
hashed AS (
  SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
word AS MATERIALIZED (
  SELECT w AS word, cast(sum(n) AS bigint) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w FROM hashed)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN word w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN word w ON c.rest = w.word),
best AS (
  SELECT near.word, w.word AS form, w.n AS form_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, w.word) AS k
  FROM near JOIN word w ON w.word = near.other),
formed AS MATERIALIZED (
  SELECT word.word, word.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
  FROM word LEFT JOIN best ON best.word = word.word AND k = 1),
chain AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT chain.word, f.form, steps + 1 FROM chain JOIN formed f ON f.word = chain.root AND f.form IS NOT NULL)
SELECT f.word, form, root, n, cast(n_near AS bigint) AS n_near, form_n
FROM formed f JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) r ON r.word = f.word"""
)
