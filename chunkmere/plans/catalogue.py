"""The query catalogue: each operator over the test tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, formats, hashing, paths
from ..model import chunks, files, local_files, refs, remote_files, snapshots, table
from ..operators import chunking, filters, joins, prune, stats
from ..operators.ordering import in_order
from ..sources import listings
from ..streaming import windows

Query = Callable[[SparkSession, str], DataFrame]

#: The time that retention and collections are reckoned from: 2002-01-01.
NOW = 1_009_843_200
POLICIES = [(1500, 0), (700, 90), (200, 60)]
COLLECTED_AT = 883_612_800
RULES = ["+src1/*", "-*/de/*", "e:/(es)/[0-9]*7\\.txt$", "+*/fr/*1?.txt", "i:^src[2-4]/"]
STREAM_CHUNK, BUCKET, PIECE = 4096, 1 << 16, 256

SNAP = """
o AS (SELECT o_orderkey, 'repo' || (o_custkey % 10) || '@host' || (o_custkey % 4) AS id,
        CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS revision, CAST(epoch(o_orderdate) AS BIGINT) AS t0, o_orderpriority AS tag FROM orders),
snap AS (SELECT id, revision, min(t0) AS start_time, max(t0) + 3600 AS end_time, min(tag) AS tag FROM o GROUP BY ALL)"""
REFS = SNAP + """,
refs AS (SELECT id, revision, l_orderkey * 10 + l_linenumber AS seq, l_partkey * 10 + CAST(l_quantity AS INTEGER) % 10 AS chunk_id FROM lineitem JOIN o ON o_orderkey = l_orderkey),
seen AS (SELECT DISTINCT id, revision, chunk_id FROM refs),
chunks AS (SELECT c AS chunk_id, 1024 + c % 4096 AS size, CASE WHEN c % 17 = 0 THEN 'fossil' ELSE 'chunk' END AS state
           FROM (SELECT p_partkey * 10 + d AS c FROM part, range(10) AS t(d)) WHERE c % 53 <> 0)"""
FILES = """
f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS hash FROM documents),
remote AS (SELECT path, size, 1700000000 + doc_id AS time, hash FROM f WHERE doc_id % 10 <> 0),
local AS (SELECT path, CAST(octet_length(encode(t)) AS BIGINT) AS size, 1700000000 + doc_id + CASE WHEN doc_id % 17 = 0 THEN 2 WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS time, sha256(t) AS hash
          FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN content || ' changed' ELSE content END AS t FROM f WHERE doc_id % 7 <> 0))"""
PIECES = FILES + """,
p AS (SELECT path, CAST(k AS INTEGER) AS seq, k * 256 AS "offset", substr(h, 2 * k * 256 + 1, 512) AS h
      FROM (SELECT path, hex(encode(content)) AS h, size FROM f WHERE size > 0), range((size + 255) // 256) AS t(k)),
pieces AS (SELECT path, seq, "offset", length(h) // 2 AS size, sha256(unhex(h)) AS hash FROM p)"""
STREAM = """
fs AS (SELECT lang, doc_id, sum(octet_length(encode(text))) OVER w - octet_length(encode(text)) AS begin, sum(octet_length(encode(text))) OVER w AS "end"
       FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
cs AS (SELECT lang, CAST(k AS BIGINT) AS seq, k * 4096 AS begin, least((k + 1) * 4096, total) AS "end"
       FROM (SELECT lang, CAST(max("end") AS BIGINT) AS total FROM fs GROUP BY lang), range((total + 4095) // 4096) AS t(k)),
placed AS (SELECT fs.lang, fs.doc_id, cs.seq, CAST(greatest(fs.begin, cs.begin) - cs.begin AS BIGINT) AS start, CAST(least(fs."end", cs."end") - cs.begin AS BIGINT) AS stop
           FROM fs JOIN cs ON fs.lang = cs.lang AND fs.begin < cs."end" AND fs."end" > cs.begin),
ranges AS (SELECT lang, doc_id, min(seq) AS start_chunk, arg_min(start, seq) AS start_offset, max(seq) AS end_chunk, arg_max(stop, seq) AS end_offset, CAST(sum(stop - start) AS BIGINT) AS size FROM placed GROUP BY ALL)"""

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- statistics


@query(f"""WITH {REFS},
ic AS (SELECT id, chunk_id, min(revision) AS revision, count(*) AS n FROM seen GROUP BY ALL),
pc AS (SELECT chunk_id, sum(n) AS n_all FROM ic GROUP BY ALL),
fresh AS (SELECT ic.id, ic.revision, count(*) FILTER (n_all = 1) AS unique_chunks, coalesce(sum(size) FILTER (n_all = 1), 0) AS unique_bytes, count(*) AS new_chunks, coalesce(sum(size), 0) AS new_bytes
          FROM ic JOIN pc USING (chunk_id) LEFT JOIN chunks USING (chunk_id) GROUP BY ALL),
total AS (SELECT id, revision, count(*) AS total_chunks, coalesce(sum(size), 0) AS total_bytes FROM seen LEFT JOIN chunks USING (chunk_id) GROUP BY ALL)
SELECT id, revision, total_chunks, CAST(total_bytes AS BIGINT) AS total_bytes, coalesce(unique_chunks, 0) AS unique_chunks, CAST(coalesce(unique_bytes, 0) AS BIGINT) AS unique_bytes,
       coalesce(new_chunks, 0) AS new_chunks, CAST(coalesce(new_bytes, 0) AS BIGINT) AS new_bytes FROM total LEFT JOIN fresh USING (id, revision)""")
def check_stats_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, unique and new chunks of each revision."""
    return stats.revision_stats(refs(spark, sf_dir), chunks(spark, sf_dir))


_BY_REVISION, _BY_ID = SQL["check_stats_revision"], """ic AS (SELECT DISTINCT id, chunk_id FROM seen), pc AS (SELECT chunk_id, count(*) AS ids FROM ic GROUP BY ALL),
a AS (SELECT id, count(*) AS total_chunks, sum(coalesce(size, 0))::BIGINT AS total_bytes, count(*) FILTER (ids = 1) AS unique_chunks, coalesce(sum(size) FILTER (ids = 1), 0)::BIGINT AS unique_bytes
FROM ic JOIN pc USING (chunk_id) LEFT JOIN chunks USING (chunk_id) GROUP BY id)"""


@query(f"""WITH v AS ({_BY_REVISION}), {REFS}, {_BY_ID} SELECT id, CAST(revision AS INTEGER) AS revision, total_chunks, total_bytes, unique_chunks, unique_bytes, new_chunks, new_bytes FROM v
UNION ALL SELECT id, NULL, total_chunks, total_bytes, unique_chunks, unique_bytes, NULL, NULL FROM a""")
def check_stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of revisions, and one over all of an id."""
    return stats.tabular_stats(refs(spark, sf_dir), chunks(spark, sf_dir))


@query(f"""WITH {REFS}, ic AS (SELECT DISTINCT id, chunk_id FROM seen), pc AS (SELECT chunk_id, count(*) AS ids FROM ic GROUP BY ALL)
SELECT id, count(*) AS total_chunks, CAST(sum(coalesce(size, 0)) AS BIGINT) AS total_bytes, count(*) FILTER (ids = 1) AS unique_chunks, CAST(coalesce(sum(size) FILTER (ids = 1), 0) AS BIGINT) AS unique_bytes
FROM ic JOIN pc USING (chunk_id) LEFT JOIN chunks USING (chunk_id) GROUP BY id""")
def check_stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each id over all its revisions."""
    return stats.id_stats(refs(spark, sf_dir), chunks(spark, sf_dir))


@query(f"""WITH {REFS} SELECT id, revision, count(*) FILTER (state = 'chunk') AS n_ok, count(*) FILTER (state = 'fossil') AS n_fossil, count(*) FILTER (state IS NULL) AS n_missing
FROM seen LEFT JOIN chunks USING (chunk_id) GROUP BY ALL""")
def check_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, A7."""
    return joins.check_chunks(refs(spark, sf_dir), chunks(spark, sf_dir))


@query(f"WITH {REFS} SELECT chunk_id, count(*) AS n_revisions FROM seen WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks) GROUP BY ALL")
def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed backup or a check finds gone."""
    return joins.missing_chunks(refs(spark, sf_dir), chunks(spark, sf_dir))


@query(f"WITH {REFS} SELECT state, count(*) AS n_chunks, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (size = 0) AS n_empty FROM chunks GROUP BY ALL")
def storage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, S5, P18."""
    return stats.storage_totals(chunks(spark, sf_dir))


@query(f"WITH {REFS} SELECT count(*) AS n_refs, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT id) AS n_ids FROM refs")
def sequence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of all kinds as a bag, and their distinct chunks."""
    return stats.bag_totals(refs(spark, sf_dir))


# ---------------------------------------------------------------- listings


@query(f"WITH {SNAP} SELECT id, revision, start_time, end_time, tag FROM snap QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision DESC) = 1")
def list_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6-S9, W8."""
    return joins.latest(snapshots(spark, sf_dir))


@query(f"WITH {SNAP} SELECT * FROM snap WHERE tag = '1-URGENT' AND revision BETWEEN 10 AND 40")
def list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag and a range of revisions."""
    wanted = formats.parse_revisions(["10-40"])
    return snapshots(spark, sf_dir).filter((F.col("tag") == "1-URGENT") & F.col("revision").between(wanted[0], wanted[-1])).select("id", "revision", "start_time", "end_time", "tag")


@query(f"""WITH {REFS}, v AS (SELECT id, revision, CASE WHEN count(*) % 5 <> 0 THEN count(*) % 3 END AS hash FROM seen GROUP BY ALL),
b AS (SELECT *, last_value(hash IGNORE NULLS) OVER (PARTITION BY id ORDER BY revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v)
SELECT id, revision, hash, CASE WHEN hash IS NULL THEN false ELSE hash IS DISTINCT FROM prev END AS changed FROM b""")
def history_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions in which a value (here of the chunk count; missing every fifth) changes."""
    n = refs(spark, sf_dir).select("id", "revision", "chunk_id").distinct().groupBy("id", "revision").agg(F.count("*").alias("n"))
    versions = n.select("id", "revision", F.when(F.col("n") % 5 != 0, F.col("n") % 3).alias("hash"))
    return joins.history(versions, ["id"])


@query(f"""WITH {FILES} SELECT l.path, l.size, CASE WHEN r.path IS NULL THEN 'new' WHEN l.size = r.size AND abs(l.time - r.time) <= 1 THEN 'preserved' ELSE 'modified' END AS action
FROM local l LEFT JOIN remote r USING (path)""")
def backup_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, P10."""
    return joins.backup_compare(local_files(spark, sf_dir), remote_files(spark, sf_dir))


@query(f"""WITH {FILES} SELECT coalesce(r.path, l.path) AS path, CASE WHEN r.path IS NULL THEN 'extra' WHEN l.size = r.size AND abs(l.time - r.time) <= 1 THEN 'skip' ELSE 'restore' END AS action, coalesce(r.size, l.size) AS size
FROM remote r FULL JOIN local l ON r.path = l.path""")
def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, J22, K7."""
    return joins.restore_plan(remote_files(spark, sf_dir), local_files(spark, sf_dir))


@query(f"""WITH {FILES}, d AS (SELECT coalesce(r.path, l.path) AS path, CASE WHEN l.path IS NULL THEN '-' WHEN r.path IS NULL THEN '+' WHEN r.hash IS DISTINCT FROM l.hash AND NOT (r.size = 0 AND l.size = 0) THEN '*' END AS change,
r.size AS left_size, l.size AS right_size FROM remote r FULL JOIN local l ON r.path = l.path) SELECT * FROM d WHERE change IS NOT NULL""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    return joins.snapshot_diff(remote_files(spark, sf_dir), local_files(spark, sf_dir))


@query(f"""WITH {FILES} SELECT path, CASE WHEN path LIKE 'src1/%' THEN true WHEN path LIKE '%/de/%' THEN false WHEN regexp_matches(path, '/(es)/[0-9]*7\\.txt$') THEN false
WHEN path LIKE '%/fr/%1_.txt' THEN true WHEN regexp_matches(path, '^src[2-4]/') THEN true ELSE true END AS included FROM f""")
def filter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1-P5."""
    return files(spark, sf_dir).select("path", filters.rule_column(F.col("path"), filters.parse_rules(RULES)).alias("included"))


@query("""WITH f AS (SELECT doc_id, source, lang, encode(doc_id || '.txt') AS name FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY encode(lang), name) AS place FROM f""")
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, O2: each file's place in its top directory, by the directory order."""
    f = files(spark, sf_dir).select("doc_id", paths.collation_key(F.col("path")).alias("key"), F.split("path", "/")[0].alias("top"))
    return in_order(f, ["key"], F.lit(1), ["top"]).select("doc_id", (F.col("before") + 1).cast("int").alias("place"))


# ---------------------------------------------------------------- chunking


@query(f'WITH {PIECES} SELECT path, seq, "offset", size, hash FROM pieces')
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2."""
    return chunking.fixed_chunks(files(spark, sf_dir), PIECE)


@query(f"WITH {PIECES} SELECT count(*) AS n_chunks, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT hash) AS distinct_chunks, (SELECT CAST(sum(s) AS BIGINT) FROM (SELECT max(size) AS s FROM pieces GROUP BY hash)) AS distinct_bytes FROM pieces")
def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A9, A12."""
    return stats.dedup_ratio(chunking.fixed_chunks(files(spark, sf_dir), PIECE))


@query(f"""WITH {PIECES}, known AS (SELECT hash FROM pieces SEMI JOIN (SELECT path FROM f WHERE doc_id % 3 = 0) USING (path))
SELECT hash, max(size) AS size FROM pieces WHERE hash NOT IN (SELECT hash FROM known) GROUP BY hash""")
def dedup_new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files add to a storage that holds every third."""
    f = files(spark, sf_dir)
    known = chunking.fixed_chunks(f.filter("doc_id % 3 = 0"), PIECE)
    return joins.new_chunks(chunking.fixed_chunks(f, PIECE).select("hash", "size"), known, "hash").select("hash", "size")


@query(f"WITH {FILES} SELECT path, size, hash FROM f WHERE size > 0")
def read_back_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files from their chunks, with the hash of what was put together."""
    return chunking.read_back(chunking.fixed_chunks(files(spark, sf_dir), PIECE, keep=True))


@query(f"""WITH {FILES}, lp AS (SELECT path, k * 256 AS "offset", substr(h, 2 * k * 256 + 1, 512) AS h FROM (SELECT path, hex(encode(t)) AS h, octet_length(encode(t)) AS size
  FROM (SELECT path, CASE WHEN doc_id % 11 = 0 THEN content || ' changed' ELSE content END AS t FROM f) WHERE t <> ''), range((size + 255) // 256) AS t(k)),
rp AS (SELECT path, k * 256 AS "offset", substr(h, 2 * k * 256 + 1, 512) AS h FROM (SELECT path, hex(encode(content)) AS h, size FROM f WHERE size > 0), range((size + 255) // 256) AS t(k))
SELECT l.path, CAST(sum(CASE WHEN l.h IS NOT DISTINCT FROM r.h THEN 0 ELSE length(l.h) // 2 END) AS BIGINT) AS modified_bytes, CAST(sum(length(l.h) // 2) AS BIGINT) AS bytes
FROM lp l LEFT JOIN rp r ON l.path = r.path AND l."offset" = r."offset" GROUP BY l.path""")
def chunk_align_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each file that changed, by chunks at the same offset."""
    f = files(spark, sf_dir)
    now = f.withColumn("content", F.when(F.col("doc_id") % 11 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content")))
    return joins.aligned_diff(chunking.fixed_chunks(f, PIECE), chunking.fixed_chunks(now, PIECE))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's documents one after another, cut into a stream's chunks."""
    docs = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("size"))
    f = chunking.running_offsets(docs, ["lang"], ["path"])
    total = docs.groupBy("lang").agg(F.sum("size").alias("total")).filter("total > 0")
    c = total.select("lang", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / STREAM_CHUNK))).alias("seq"))
    c = c.select("lang", "seq", (F.col("seq") * STREAM_CHUNK).alias("begin"), F.least((F.col("seq") + 1) * STREAM_CHUNK, "total").alias("end"))
    return chunking.file_chunk_map(f, c, ["lang"], BUCKET)


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.file_ranges(_placed(spark, sf_dir), ["lang"]).withColumnRenamed("path", "doc_id")


@query(f"WITH {STREAM} SELECT * FROM ranges")
def file_chunk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, J13, W5, T11."""
    return _ranges(spark, sf_dir)


@query(f"WITH {STREAM} SELECT lang, doc_id, start_chunk - coalesce(lag(end_chunk) OVER (PARTITION BY lang ORDER BY doc_id), 0) AS d_start, end_chunk - start_chunk AS d_end FROM ranges")
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4."""
    return chunking.delta_encode(_ranges(spark, sf_dir), ["lang"], "doc_id").select("lang", "doc_id", "d_start", "d_end")


@query(f"WITH {STREAM} SELECT lang, doc_id, start_chunk, end_chunk FROM ranges")
def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way back."""
    return chunking.delta_decode(delta_encode(spark, sf_dir), ["lang"], "doc_id").select("lang", "doc_id", "start_chunk", "end_chunk")


@query(f"WITH {REFS} SELECT id, revision, seq, chunk_id, min(seq) OVER (PARTITION BY id, revision, chunk_id) AS first_seq FROM refs")
def chunk_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, W7."""
    return joins.first_occurrence(refs(spark, sf_dir), ["id", "revision"]).select("id", "revision", "seq", "chunk_id", "first_seq")


@query(f"""WITH {REFS}, m AS (SELECT id, revision, seq, chunk_id // 100 AS k FROM refs),
g AS (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM m WINDOW w AS (PARTITION BY id, revision ORDER BY seq, k))
SELECT id, revision, seq, CAST(sum(fresh) OVER (PARTITION BY id, revision ORDER BY seq, k ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS number FROM g""")
def dense_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, J15."""
    r = refs(spark, sf_dir).select("id", "revision", "seq", F.expr("chunk_id div 100").alias("k"))
    return chunking.dense_numbers(r, ["id", "revision"], ["seq", "k"], "k").select("id", "revision", "seq", "number")


@query(f"""WITH {REFS}, b AS (SELECT id, revision, seq // 4096 AS bucket, sha256(string_agg(CAST(chunk_id AS VARCHAR), '' ORDER BY seq, CAST(chunk_id AS VARCHAR))) AS v FROM refs GROUP BY ALL)
SELECT id, revision, sha256(string_agg(v, '' ORDER BY bucket)) AS checksum FROM b GROUP BY ALL""")
def snapshot_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return chunking.ordered_checksum(refs(spark, sf_dir), ["id", "revision"], "seq", "chunk_id")


@query("""WITH l AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, lines[i + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), range(len(lines)) AS t(i)),
w AS (SELECT doc_id, line_no, max(CASE WHEN line LIKE '%the%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l)
SELECT doc_id, line_no FROM w WHERE near = 1""")
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within two of one that matches."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("hit", F.col("line").contains("the"))
    return chunking.context_lines(lines, ["doc_id"], "line_no", "hit", 2, 2).select("doc_id", "line_no")


@query("SELECT doc_id, true AS exact FROM documents")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text compressed, padded, encrypted under its own key, and back."""
    key = codec.derived_key(F.sha2("text", 256), b"storage secret")
    made = files(spark, sf_dir).withColumn("text", F.col("content")).select("doc_id", F.col("text").cast("binary").alias("raw"), key.alias("key"))
    stored = made.withColumn("stored", codec.encode_chunk(F.col("raw"), codec.LZ4_LEVEL, F.col("key")))
    return stored.select("doc_id", (codec.decode_chunk(F.col("stored"), F.col("key")) == F.col("raw")).alias("exact"))


@query("SELECT doc_id, sha256(text) AS hash, true AS refused FROM documents")
def sealed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text under its own key, drawn from a storage key that a password opens; another password's key opens none."""
    secret, wrong = (hashing.master_key(p, b"chunkmere salt", 1000) for p in ("the password", "another"))
    made = files(spark, sf_dir).select("doc_id", "hash", F.col("content").cast("binary").alias("raw"))
    key = lambda s: codec.derived_key(F.col("hash"), s)
    stored = made.withColumn("stored", codec.encode_chunk(F.col("raw"), 201, key(secret)))
    opened = codec.decode_chunk(F.col("stored"), key(secret))
    return stored.select("doc_id", F.sha2(opened, 256).alias("hash"), codec.decode_chunk(F.col("stored"), key(wrong), strict=False).isNull().alias("refused"))


@query("SELECT doc_id, true AS exact FROM documents")
def erasure_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: every text in five shards and two for parity, with bytes of the first shard damaged, and back."""
    made = files(spark, sf_dir).select("doc_id", F.col("content").cast("binary").alias("raw"))
    stored = made.withColumn("stored", codec.encode_chunk(F.col("raw"), 201, shards=(5, 2)))
    # Past the mark, the header and the seven hashes begins the first shard.
    at = 8 + 14 + 7 * 32
    hurt = F.concat(F.expr(f"substring(stored, 1, {at})"), F.expr("X'00FF'"), F.expr(f"substring(stored, {at + 3})"))
    return stored.select("doc_id", (codec.decode_chunk(hurt, erasure=True) == F.col("raw")).alias("exact"))


@query()
def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks of every document."""
    return chunking.content_chunks(files(spark, sf_dir), 512, 2048, 128)


@query(f"WITH {FILES} SELECT path, size, hash, true AS in_bounds FROM f WHERE size > 0")
def cdc_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks put together again; all but a file's last are within the bounds, and none leaves a gap."""
    parts = chunking.content_chunks(files(spark, sf_dir), 512, 2048, 128, keep=True)
    end = F.max(F.col("offset") + F.col("size"))
    small = F.sum((F.col("size") < 128).cast("int"))
    last = F.max_by("size", "seq")
    bounds = parts.groupBy("path").agg((end == F.sum("size")).alias("whole"), (F.max("size") <= 2048).alias("under"), (small == (last < 128).cast("int")).alias("over"))
    return chunking.read_back(parts).join(bounds, "path").select("path", "size", "hash", (F.col("whole") & F.col("under") & F.col("over")).alias("in_bounds"))


@query(f"""WITH {FILES}, l AS (SELECT split_part(path, '/', 1) AS id, path, size || ' ' || time || ' ' || hash || ' ' || path || chr(10) AS line FROM remote)
SELECT id, CAST(sum(octet_length(encode(line))) AS BIGINT) AS size, sha256(string_agg(line, '' ORDER BY path)) AS hash FROM l GROUP BY id""")
def metadata_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings cut into metadata chunks, each stored once, and read back in order."""
    f = remote_files(spark, sf_dir)
    lines = f.select(F.substring_index("path", "/", 1).alias("id"), "path", F.concat_ws(" ", "size", "time", "hash", "path").alias("line"))
    parts = chunking.metadata_chunks(lines, 4096, 64, keep=True)
    stored = parts.select("hash", "content").dropDuplicates(["hash"])
    laid = parts.select("id", "run", "seq", "hash").join(stored, "hash")
    return chunking.read_back(laid.select(F.col("id").alias("path"), F.struct("run", "seq").alias("seq"), "content")).withColumnRenamed("path", "id")


@query()
def blake2_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, id and file hash of every document."""
    h = files(spark, sf_dir).select("doc_id", hashing.chunk_hash(F.col("content"), b"chunkmere").alias("hash"), hashing.content_hash(F.col("content")).alias("file_hash"))
    return h.withColumn("chunk_id", hashing.chunk_id(F.col("hash"), b"chunkmere")).withColumn("object", paths.chunk_path(F.col("chunk_id")))


# ---------------------------------------------------------------- collection


@query(f"WITH {REFS} SELECT DISTINCT chunk_id FROM seen WHERE revision <= 2 AND chunk_id NOT IN (SELECT chunk_id FROM seen WHERE revision > 2)")
def prune_nonexhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, A15."""
    r = refs(spark, sf_dir)
    return prune.unreferenced_chunks(r.filter("revision <= 2"), r.filter("revision > 2"))


@query(f"""WITH {REFS}, obj AS (SELECT 'chunks/' || chunk_id AS name, chunk_id, state FROM chunks
UNION ALL SELECT 'chunks/' || chunk_id || '.tmp', chunk_id, 'tmp' FROM chunks WHERE chunk_id % 101 = 0
UNION ALL SELECT 'other/' || chunk_id, chunk_id, state FROM chunks WHERE chunk_id % 97 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, state ORDER BY name) AS copy, chunk_id IN (SELECT chunk_id FROM seen) AS used FROM obj)
SELECT name, chunk_id, state, CASE WHEN state = 'tmp' THEN 'collect_tmp' WHEN state = 'fossil' AND used THEN 'resurrect' WHEN state = 'fossil' THEN 'collect_fossil'
WHEN NOT used THEN 'fossilize' WHEN copy > 1 THEN 'delete_redundant' ELSE 'keep' END AS action FROM n""")
def prune_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, U5."""
    c = chunks(spark, sf_dir)
    name = lambda pre, post="": F.concat(F.lit(pre), F.col("chunk_id").cast("string"), F.lit(post)).alias("name")
    objects = c.select(name("chunks/"), "chunk_id", "state").unionByName(c.filter("chunk_id % 101 = 0").select(name("chunks/", ".tmp"), "chunk_id", F.lit("tmp").alias("state")))
    return prune.classify_objects(objects.unionByName(c.filter("chunk_id % 97 = 0").select(name("other/"), "chunk_id", "state")), refs(spark, sf_dir))


@query(f"""WITH {REFS}, new AS (SELECT DISTINCT chunk_id FROM seen WHERE revision >= 75)
SELECT chunk_id, CASE WHEN chunk_id IN (SELECT chunk_id FROM new) THEN 'resurrect' ELSE 'delete' END AS action FROM chunks WHERE state = 'fossil'""")
def fossils_resurrect_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, K8, K9."""
    return prune.settle_fossils(chunks(spark, sf_dir).filter("state = 'fossil'"), refs(spark, sf_dir).filter("revision >= 75"))


@query(f"WITH {SNAP} SELECT id, revision FROM snap WHERE revision IN (3, 5, 999) ")
def ghost_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10."""
    s = snapshots(spark, sf_dir)
    listed = s.select("id").distinct().select("id", F.array(F.lit(3), F.lit(5), F.lit(999)).alias("revisions"))
    return prune.ghost_snapshots(listed, s)


@query(f"""WITH {REFS}, src AS (SELECT DISTINCT chunk_id FROM seen WHERE CAST(regexp_extract(id, 'repo([0-9]+)', 1) AS INTEGER) % 2 = 0), dst AS (SELECT DISTINCT chunk_id FROM seen WHERE CAST(regexp_extract(id, 'repo([0-9]+)', 1) AS INTEGER) % 2 = 1)
SELECT chunk_id, CASE WHEN chunk_id IN (SELECT chunk_id FROM dst) THEN 'skip' ELSE 'copy' END AS action FROM src""")
def copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, A12, K14."""
    r = refs(spark, sf_dir).withColumn("n", F.regexp_extract("id", "repo([0-9]+)", 1).cast("int"))
    return joins.copy_plan(r.filter("n % 2 = 0"), r.filter("n % 2 = 1"))


@query(f"""WITH {REFS}, src AS (SELECT DISTINCT chunk_id FROM seen WHERE CAST(regexp_extract(id, 'repo([0-9]+)', 1) AS INTEGER) % 2 = 0), dst AS (SELECT DISTINCT chunk_id FROM seen WHERE CAST(regexp_extract(id, 'repo([0-9]+)', 1) AS INTEGER) % 2 = 1)
SELECT CASE WHEN chunk_id IN (SELECT chunk_id FROM dst) THEN 'skip' ELSE 'copy' END AS action, count(*) AS n_chunks, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes FROM src LEFT JOIN chunks USING (chunk_id) GROUP BY ALL""")
def copy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and bytes that a copy sends, and those that the other storage has."""
    sized = copy_plan(spark, sf_dir).join(joins.shuffled(chunks(spark, sf_dir).select("chunk_id", "size")), "chunk_id", "left")
    return sized.groupBy("action").agg(F.count("*").alias("n_chunks"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


@query(f"""WITH {FILES}, a AS (SELECT CASE WHEN r.path IS NULL THEN 'extra' WHEN l.size = r.size AND abs(l.time - r.time) <= 1 THEN 'skip' ELSE 'restore' END AS action, coalesce(r.size, l.size) AS size
FROM remote r FULL JOIN local l ON r.path = l.path) SELECT action, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM a GROUP BY action""")
def restore_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes by what a restore does with them."""
    return restore_plan(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


@query(f"""WITH {FILES}, kept AS (SELECT path, size, time FROM remote), lost AS (SELECT path FROM f WHERE doc_id % 13 = 0)
SELECT l.path, CASE WHEN k.path IS NULL THEN 'read' WHEN l.size <> k.size OR abs(l.time - k.time) > 1 THEN 'read' WHEN l.path IN (SELECT path FROM lost) THEN 'read' ELSE 'resume' END AS action
FROM local l LEFT JOIN kept k USING (path)""")
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a stopped backup, files that go on as they are; one that changed, or whose chunks are gone, is read again."""
    lost = files(spark, sf_dir).filter("doc_id % 13 = 0").select("path")
    begun = remote_files(spark, sf_dir).join(lost, "path", "left_anti")
    plan = joins.backup_compare(local_files(spark, sf_dir), begun)
    return plan.select("path", F.when(F.col("action") == "preserved", "resume").otherwise("read").alias("action"))


@query(f"WITH {REFS} SELECT chunk_id, size FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM seen WHERE revision = 80)")
def cache_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached chunks that the headers in the cache don't need."""
    return chunks(spark, sf_dir).join(refs(spark, sf_dir).filter("revision = 80").select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", "size")


@query(f"WITH {REFS} SELECT chunk_id, size FROM chunks WHERE state = 'chunk' AND chunk_id % 4 <> 0")
def verify_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks that weren't verified yet (every fourth was)."""
    c = chunks(spark, sf_dir)
    return c.filter("state = 'chunk'").join(c.filter("chunk_id % 4 = 0").select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "size")


@query(f"WITH {SNAP} SELECT id, max(revision) AS last_revision FROM snap GROUP BY id")
def fossil_last_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, K10."""
    return prune.last_revisions(snapshots(spark, sf_dir))


@query(f"""WITH {SNAP}, late AS (SELECT *, end_time > {COLLECTED_AT} + 43200 AS e FROM snap WHERE revision > 30),
w AS (SELECT *, coalesce(max(CAST(e AS INTEGER)) OVER (PARTITION BY id ORDER BY revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM late),
new AS (SELECT id, bool_or(e) AS progress, count(*) AS n FROM w WHERE b = 0 GROUP BY id),
last AS (SELECT id, arg_max(end_time, revision) AS last_end FROM snap GROUP BY id)
SELECT split_part(id, '@', 2) AS host, bool_or(coalesce(progress, false)) AS progressed, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_new, max(last_end) AS last_end,
       bool_or(coalesce(progress, false)) OR (max(last_end) > 0 AND max(last_end) < {NOW} - 7 * 86400) AS safe
FROM last LEFT JOIN new USING (id) GROUP BY ALL""")
def gc_deletable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, W10, T6, P14."""
    s = snapshots(spark, sf_dir)
    recorded = s.select("id").distinct().withColumn("last_revision", F.lit(30))
    return prune.deletable_by_host(s, recorded, COLLECTED_AT, NOW, consistent=False)


@query(f"""WITH {SNAP}, late AS (SELECT *, end_time > {COLLECTED_AT} AS e FROM snap WHERE revision > 30 AND id NOT LIKE 'repo1@%' AND id NOT LIKE 'repo2@%'),
w AS (SELECT *, coalesce(max(CAST(e AS INTEGER)) OVER (PARTITION BY id ORDER BY revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM late)
SELECT id, revision, e AS ends_after FROM w WHERE b = 0""")
def gc_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new snapshots that a collection waits for, but for those of ignored ids."""
    s = snapshots(spark, sf_dir)
    ignored = [f"repo{n}@host{h}" for n in (1, 2) for h in range(4)]
    recorded = s.select("id").distinct().withColumn("last_revision", F.lit(30))
    return prune.new_snapshots(s, recorded, COLLECTED_AT, ignored=ignored).select("id", "revision", "ends_after")


_RETENTION = f"""WITH RECURSIVE {SNAP},
d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision) AS k, count(*) OVER (PARTITION BY id) AS n, CAST(epoch(to_timestamp(start_time)::DATE::TIMESTAMP) AS BIGINT) // 86400 AS day FROM snap),
e AS (SELECT *, ({NOW} // 86400) - day AS age FROM d), q AS (SELECT *, CASE WHEN age >= 1500 THEN 0 WHEN age >= 700 THEN 1 WHEN age >= 200 THEN 2 ELSE 3 END AS own, k < n AND (OPEN) AS open FROM e),
r AS (SELECT id, 0::BIGINT AS k, 0 AS rule, NULL::BIGINT AS kept, false AS deleted, 0 AS revision FROM (SELECT DISTINCT id FROM q)
  UNION ALL
  SELECT x.id, x.k, x.rule, CASE WHEN NOT x.open THEN x.kept WHEN x.rule = 3 OR x.gone THEN x.last ELSE x.day END, x.open AND x.gone, x.revision FROM (
    SELECT y.*, y.rule < 3 AND (y.rule = 0 OR (y.last IS NOT NULL AND y.day - y.last < CASE y.rule WHEN 1 THEN 90 ELSE 60 END)) AS gone FROM (
      SELECT q.id, q.k, q.day, q.revision, q.open, r.kept, CASE WHEN q.open THEN greatest(r.rule, q.own) ELSE r.rule END AS rule, CASE WHEN NOT q.open OR greatest(r.rule, q.own) = r.rule THEN r.kept END AS last
      FROM r JOIN q ON q.id = r.id AND q.k = r.k + 1) y) x)
SELECT q.id, q.revision, r.deleted AND q.n > 1 AS deleted FROM r JOIN q ON q.id = r.id AND q.k = r.k"""


@query(_RETENTION.replace("OPEN", "true"))
def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, F10, F21."""
    return prune.retention(snapshots(spark, sf_dir), POLICIES, NOW).select("id", "revision", "deleted")


@query(_RETENTION.replace("OPEN", "tag = '1-URGENT'"))
def retention_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 with a tag."""
    return prune.retention(snapshots(spark, sf_dir), POLICIES, NOW, ["1-URGENT"]).select("id", "revision", "deleted")


@query(f"WITH {SNAP} SELECT id, revision FROM snap WHERE tag IN ('2-HIGH', '5-LOW')")
def tag_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: snapshots with one of the tags."""
    return snapshots(spark, sf_dir).filter(F.col("tag").isin("2-HIGH", "5-LOW")).select("id", "revision")


# ---------------------------------------------------------------- rows and reports


@query(f"""WITH {STREAM} SELECT lang, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, max(end_chunk) + 1 AS n_chunks, max(length(CAST(size AS VARCHAR))) AS size_width FROM ranges GROUP BY lang""")
def file_list_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes, chunks and the width of the size column of each listing."""
    listed = _ranges(spark, sf_dir).withColumnRenamed("lang", "id").withColumn("revision", F.lit(1))
    return stats.file_list_stats(listed).select(F.col("id").alias("lang"), "n_files", "bytes", "n_chunks", "size_width")


@query(f"""WITH {FILES}, c AS (SELECT l.size, CASE WHEN r.path IS NULL THEN 'new' WHEN l.size = r.size AND abs(l.time - r.time) <= 1 THEN 'preserved' ELSE 'modified' END AS action FROM local l LEFT JOIN remote r USING (path))
SELECT action, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM c GROUP BY action""")
def backup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes by what a backup does with them."""
    return joins.backup_compare(local_files(spark, sf_dir), remote_files(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


@query(f"""WITH {PIECES}, need AS (SELECT * FROM pieces), have AS (SELECT hash, "offset", size FROM pieces SEMI JOIN (SELECT path FROM f WHERE doc_id % 3 = 0) USING (path))
SELECT path, seq, hash IN (SELECT hash FROM have) AS anywhere, (hash, "offset", size) IN (SELECT (hash, "offset", size) FROM have) AS same_place FROM need WHERE hash IN (SELECT hash FROM have)""")
def reusable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a restore that local files hold, anywhere or at the same offset."""
    f = files(spark, sf_dir)
    need, have = chunking.fixed_chunks(f, PIECE), chunking.fixed_chunks(f.filter("doc_id % 3 = 0"), PIECE)
    exact = joins.reusable_chunks(need, have, same_offset=True).select("path", "seq", F.lit(True).alias("same"))
    found = joins.reusable_chunks(need, have).select("path", "seq")
    return found.join(exact, ["path", "seq"], "left").select("path", "seq", F.lit(True).alias("anywhere"), F.coalesce("same", F.lit(False)).alias("same_place"))


@query(f"""WITH {REFS} SELECT r.id, r.revision, tag, start_time, end_time, count(*) AS n_refs, count(DISTINCT chunk_id) AS n_chunks
FROM refs r JOIN snap USING (id, revision) GROUP BY ALL""")
def header_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers written as JSON with their chunk lists, parsed strictly, and read."""
    lists = refs(spark, sf_dir).groupBy("id", "revision").agg(F.array_sort(F.collect_list(F.hex("chunk_id"))).alias("chunks"))
    head = snapshots(spark, sf_dir).join(lists, ["id", "revision"])
    text = head.select(F.to_json(F.struct("id", "revision", "tag", "start_time", "end_time", "chunks")).alias("j"))
    parsed = text.select(F.from_json("j", "id string, revision int, tag string, start_time long, end_time long, chunks array<string>", {"mode": "FAILFAST"}).alias("h")).select("h.*")
    return parsed.select("id", "revision", "tag", "start_time", "end_time", F.size("chunks").cast("long").alias("n_refs"), F.size(F.array_distinct("chunks")).cast("long").alias("n_chunks"))


@query(f"""WITH {FILES} SELECT path, lpad(CAST(size AS VARCHAR), 9, ' ') || ' ' || strftime(make_timestamp(time * 1000000), '%Y-%m-%d %H:%M:%S') || ' ' || hash || ' ' || path AS line FROM remote""")
def entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a listing's lines."""
    f = remote_files(spark, sf_dir)
    at = F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd HH:mm:ss")
    return f.select("path", F.format_string("%9d %s %s %s", "size", at, "hash", "path").alias("line"))


_LISTED = f"WITH {STREAM} SELECT lang AS id, CAST(doc_id AS VARCHAR) AS path, size, 1700000000 + doc_id AS time, start_chunk, start_offset, end_chunk, end_offset FROM ranges"


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the documents' streams with every field of a listing."""
    r = _ranges(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string")).withColumn("time", F.lit(1_700_000_000) + F.col("doc_id"))
    return r.select("lang", "doc_id", "path", "size", "time", F.lit(0o644).alias("mode"), F.lit("").alias("link"), F.sha2("path", 256).alias("hash"), *listings.RANGE, F.lit(-1).alias("uid"), F.lit(-1).alias("gid"), F.lit(None).cast("map<string,binary>").alias("attributes"))


_READ = ["id", "path", "size", "time", *listings.RANGE]


@query(_LISTED)
def listing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings written as records with delta-coded chunks, in parts that end within records, and read back."""
    coded = chunking.delta_encode(_listing(spark, sf_dir), ["lang"], "doc_id").withColumn("start_chunk", F.col("d_start")).withColumn("end_chunk", F.col("d_end"))
    parts = coded.select("lang", "doc_id", listings.entry_record(F.struct(*listings.RECORD, "attributes")).alias("r"))
    halves = F.array(F.expr("substring(r, 1, 9)"), F.expr("substring(r, 10)"))
    laid = parts.select(F.col("lang").alias("id"), "doc_id", F.posexplode(halves).alias("half", "content")).select("id", F.struct("doc_id", "half").alias("seq"), "content")
    return listings.read_records(laid).select(*_READ)


@query(_LISTED)
def listing_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as the JSON objects of older lists, parsed strictly, and read."""
    text = _listing(spark, sf_dir).select(F.col("lang").alias("id"), listings.entry_json().alias("j"))
    return listings.listed(text.select("id", F.from_json("j", listings.JSON_ENTRY, {"mode": "FAILFAST"}).alias("e")).select("id", "e.*"), "id").select(*_READ)


@query(f"""WITH {REFS}, n AS (SELECT chunk_id, sha256(CAST(chunk_id AS VARCHAR)) AS h, state FROM chunks)
SELECT chunk_id, CASE WHEN chunk_id % 101 = 0 THEN 'tmp' WHEN chunk_id % 103 = 0 THEN 'unknown' ELSE state END AS state, h AS id FROM n""")
def object_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects by name: what they are, and which chunk."""
    c = chunks(spark, sf_dir).withColumn("h", F.sha2(F.col("chunk_id").cast("string"), 256))
    name = F.concat(paths.chunk_path(F.col("h")), F.when(F.col("chunk_id") % 101 == 0, ".tmp").when(F.col("chunk_id") % 103 == 0, ".odd").when(F.col("state") == "fossil", ".fsl").otherwise(""))
    named = c.withColumn("name", name)
    return named.select("chunk_id", paths.object_state(F.col("name")).alias("state"), F.regexp_replace(paths.chunk_of_path(F.col("name")), r"\.odd$", "").alias("id"))


@query(f"""WITH {STREAM} SELECT r.lang, r.doc_id, r.size = octet_length(encode(d.text)) AND start_chunk <= end_chunk AND start_offset < 4096 AND end_offset <= 4096 AS good FROM ranges r JOIN documents d USING (doc_id)""")
def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, V2: every entry's range is in order, within its chunks, and as long as the file."""
    size = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("wanted"))
    good = (F.col("size") == F.col("wanted")) & (F.col("start_chunk") <= F.col("end_chunk")) & (F.col("start_offset") < STREAM_CHUNK) & (F.col("end_offset") <= STREAM_CHUNK)
    return _ranges(spark, sf_dir).join(size, "doc_id").select("lang", "doc_id", good.alias("good"))


@query(f"""WITH {STREAM}, o AS (SELECT lang, seq, min(doc_id) AS first_doc, count(*) AS n_files, CAST(sum(stop - start) AS BIGINT) AS used FROM placed GROUP BY ALL)
SELECT lang, seq, first_doc, n_files, used, row_number() OVER (PARTITION BY lang ORDER BY seq) AS place FROM o""")
def read_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream's chunks in the order in which a restore reads them, once each, with the files that need them."""
    by_chunk = _placed(spark, sf_dir).groupBy("lang", "seq").agg(F.min("path").alias("first_doc"), F.count("*").alias("n_files"), F.sum(F.col("stop") - F.col("start")).alias("used"))
    return in_order(by_chunk, ["seq"], F.lit(1), ["lang"]).withColumn("place", (F.col("before") + 1).cast("int")).drop("before")


@query(f"""WITH {SNAP}, n AS (SELECT id, revision, end_time - start_time AS s FROM snap)
SELECT id, revision, CASE WHEN s > 172800 THEN (s // 86400) || ' days ' WHEN s > 86400 THEN '1 day ' ELSE '' END || lpad(CAST(s % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS took,
CASE WHEN s > 1048576 THEN printf('%.2fM', s / 1048576.0) WHEN s > 1024 THEN printf('%.0fK', s / 1024.0) ELSE CAST(s AS VARCHAR) END AS as_size FROM n""")
def pretty_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """durations and sizes as text."""
    took = F.col("end_time") - F.col("start_time")
    return snapshots(spark, sf_dir).select("id", "revision", formats.pretty_time(took).alias("took"), formats.pretty_size(took).alias("as_size"))


@query(f"WITH {SNAP} SELECT split_part(id, '@', 2) AS host, count(DISTINCT id) AS n_ids, max(end_time) AS last_end FROM snap GROUP BY ALL")
def host_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and last end time of each host."""
    s = snapshots(spark, sf_dir).groupBy("id").agg(F.max("end_time").alias("end_time"))
    return s.groupBy(paths.host_of(F.col("id")).alias("host")).agg(F.count("*").alias("n_ids"), F.max("end_time").alias("last_end"))


@query("""SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS k FROM (SELECT * FROM events UNION ALL SELECT * FROM events)) WHERE k = 1""")
def events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows of a listing or stream, each once."""
    e = table(spark, sf_dir, "events")
    return windows.without_repeats(e.unionByName(e)).select("user_id", "ts", "event_id")


@query("SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS hash, CAST(sum(octet_length(encode(text))) AS BIGINT) AS size FROM conversations GROUP BY conv_id")
def sequence_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a sequence joined in order, and their hash."""
    c = table(spark, sf_dir, "conversations")
    whole = chunking.read_back(c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("seq"), F.col("text").cast("binary").alias("content")))
    return whole.select(F.col("path").cast("long").alias("conv_id"), "hash", "size")


# ---------------------------------------------------------------- scalars


@query(f"""WITH {REFS}, n AS (SELECT chunk_id, size * chunk_id * 977 AS n FROM chunks)
SELECT chunk_id, CASE WHEN n > 1073741824000 THEN (n // 1073741824) || 'G' WHEN n > 1073741824 THEN (n // 1048576000) || ',' || lpad(CAST((n // 1048576) % 1000 AS VARCHAR), 3, '0') || 'M'
WHEN n > 1048576 THEN (n // 1024000) || ',' || lpad(CAST((n // 1024) % 1000 AS VARCHAR), 3, '0') || 'K' WHEN n > 1024 THEN (n // 1024) || 'K' ELSE CAST(n AS VARCHAR) END AS pretty FROM n""")
def pretty_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12."""
    return chunks(spark, sf_dir).select("chunk_id", formats.pretty_number(F.col("size") * F.col("chunk_id") * 977).alias("pretty"))


@query(f"SELECT o_orderkey, CAST(date_diff('day', o_orderdate::DATE, to_timestamp({NOW})::DATE) AS INTEGER) AS days FROM orders")
def days_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10."""
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.days_between(F.unix_timestamp("o_orderdate"), F.lit(NOW)).alias("days"))


@query("SELECT doc_id, source || '/' || lang AS parent, base64(encode(doc_id || '.txt')) AS name FROM documents")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path's directory, and its name in base64."""
    return files(spark, sf_dir).select("doc_id", paths.parent(F.col("path")).alias("parent"), F.base64(F.regexp_extract("path", "[^/]+$", 0).cast("binary")).alias("name"))


# ---------------------------------------------------------------- streams


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL""")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour; the same function runs on a stream."""
    return windows.tumbling(table(spark, sf_dir, "events"), "1 hour")


@query("""SELECT event_type, w AS start, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM (
  SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS w FROM events, range(2) AS t(k)) GROUP BY ALL""")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour every half."""
    return windows.tumbling(table(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events with less than six hours between them."""
    return windows.sessions(table(spark, sf_dir, "events"), "6 hours")


@query()
def approx_unique_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunks of each id by HyperLogLog."""
    return refs(spark, sf_dir).groupBy("id").agg(F.approx_count_distinct("chunk_id").alias("n_chunks"))
