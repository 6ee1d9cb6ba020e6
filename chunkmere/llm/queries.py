"""The registered queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .language_id import fit, predict
from .media import media_round_trip
from .ngram_join import near_duplicates
from .packing import pack_documents
from .pieces import encode_pieces
from .sharding import shard_documents
from .token_binary import token_file_round_trip
from .url_filters import filter_captures, keys_of
from .warc import archive_round_trip

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; of equal texts the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max").drop("ties")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    page = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)$", 1).try_cast("long")
    return archive_round_trip(table(spark, sf_dir, "pages")).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded in pieces and decoded again."""
    return encode_pieces(table(spark, sf_dir, "documents"), _tokenizer(PIECES), keep_ids=False).drop("ids")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by the Jaccard similarity of their 5-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as WAV payloads and read back, with their fingerprints."""
    return media_round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint"
    )


def held_out() -> Column:
    """Documents that no language model learns from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()).select("text", "lang"))
    found = docs.select("doc_id", held_out().alias("held_out"), predict(model).alias("r"))
    return found.select("doc_id", "held_out", "r.lang_pred", "r.score", "r.margin", "r.rejected")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer(BYTE_BPE), end_id=1)


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written in Simple-8b files and read back."""
    return token_file_round_trip(table(spark, sf_dir, "documents"), _tokenizer(BYTE_BPE), end_id=0)


def dated_entries(pages: DataFrame) -> DataFrame:
    """A filter list's history made from the keys of the pages' URLs: some are added, removed and added again."""
    keys = pages.select(F.explode(keys_of(F.col("url"))).alias("k")).select("k.kind", "k.pattern").distinct()
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "pattern")), 1, 6), 16, 10).cast("long")
    rows = keys.withColumn("h", h).filter("h % 3 = 0").withColumn("list", F.when(F.col("h") % 11 == 0, "allow").otherwise(F.concat(F.lit("list"), (F.col("h") % 4).cast("string"))))
    day = 19723 + F.col("h") % 300
    add = rows.select("list", "kind", "pattern", F.lit("add").alias("action"), day.alias("day"))
    gone = rows.filter("h % 2 = 0").select("list", "kind", "pattern", F.lit("remove").alias("action"), (day + 30 + F.col("h") % 60).alias("day"))
    again = rows.filter("h % 5 = 0").select("list", "kind", "pattern", F.lit("add").alias("action"), (day + 120).alias("day"))
    return add.unionByName(gone).unionByName(again)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the list entries of their day of fetch."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", 19723 + F.pmod("page_id", F.lit(366)))
    return filter_captures(captures, dated_entries(pages)).drop("url")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes along a Hilbert curve."""
    return shard_documents(table(spark, sf_dir, "documents"), shards=8).drop("curve")


QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op2_warc": op2_warc, "op3_pieces": op3_pieces, "op4_ngram_join": op4_ngram_join, "op5_media": op5_media, "op6_packing": op6_packing, "op7_token_binary": op7_token_binary, "op8_language_id": op8_language_id, "op9_url_filters": op9_url_filters, "op10_sharding": op10_sharding}

SQL = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_url_filters": r"""
WITH p AS (
  SELECT page_id, url, 19723 + page_id % 366 AS day,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
k AS (
  SELECT page_id, day, 'host' AS kind, host AS pattern FROM p WHERE host IS NOT NULL
  UNION
  SELECT page_id, day, 'domain', list_aggregate(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), 'string_agg', '.')
  FROM p, unnest(range(1, greatest(2, len(string_split(host, '.'))))) AS t(i) WHERE host IS NOT NULL
  UNION
  SELECT page_id, day, 'prefix', host || '/' || list_aggregate(list_slice(parts, 1, i), 'string_agg', '/')
  FROM p, unnest(range(1, len(parts) + 1)) AS t(i) WHERE host IS NOT NULL),
e AS (
  SELECT kind, pattern, ('0x' || substr(md5(kind || ':' || pattern), 1, 6))::BIGINT AS h FROM (SELECT DISTINCT kind, pattern FROM k)),
r AS (
  SELECT CASE WHEN h % 11 = 0 THEN 'allow' ELSE 'list' || (h % 4) END AS list, kind, pattern, h, 19723 + h % 300 AS day FROM e WHERE h % 3 = 0),
d AS (
  SELECT list, kind, pattern, day, max(action) AS action FROM (
    SELECT list, kind, pattern, 'add' AS action, day FROM r
    UNION ALL SELECT list, kind, pattern, 'remove', day + 30 + h % 60 FROM r WHERE h % 2 = 0
    UNION ALL SELECT list, kind, pattern, 'add', day + 120 FROM r WHERE h % 5 = 0) GROUP BY ALL),
v AS (
  SELECT list, kind, pattern, action, day AS valid_from, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS valid_to FROM d),
m AS (
  SELECT k.page_id, list_sort(list_distinct(list(v.list))) AS names, min(v.pattern) AS first_pattern
  FROM k JOIN v ON k.kind = v.kind AND k.pattern = v.pattern AND v.action = 'add' AND v.valid_from <= k.day AND (v.valid_to IS NULL OR k.day < v.valid_to)
  GROUP BY k.page_id)
SELECT p.page_id, p.day, p.host, count(*) AS n_copies, coalesce(len(any_value(m.names)) > 0 AND NOT list_contains(any_value(m.names), 'allow'), false) AS blocked,
       coalesce(list_aggregate(any_value(m.names), 'string_agg', ','), '') AS lists, any_value(m.first_pattern) AS first_pattern
FROM p LEFT JOIN m USING (page_id) GROUP BY p.page_id, p.url, p.day, p.host""",
}
