"""Operator 9: URL filters as a temporal list join.

A list's history is a table of dated entries ``(list, kind, pattern, action, day)``.  The entries of
one pattern become validity intervals: an ``add`` holds from its day until the next entry of the same
list, kind and pattern.  Every capture is evaluated against the intervals that hold on the day of its
fetch: its URL gives the keys that an entry may name (its host, the host's parent domains, the host
with each leading part of the path), keys meet intervals by equality, and the day picks the interval.  Keys are compared by
hashes, folded label by label and part by part, so that a long path costs a number a part and not a
string; what meets is then held against the entry's own text.

All of it is DataFrame code.  Intervals are broadcast while they are few and short; beyond that both
sides are shuffled by key, and keys that hold more than one capture in so many are spread over salts by
their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_SHARE, cut

ADD, REMOVE, ALLOW = "add", "remove", "allow"
#: Bytes of text that broadcast intervals may have.
BROADCAST_BYTES = 32 << 20
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and closing dots; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?([^/?#:@]+)", 1)), r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """An array of ``(kind, pattern)``: host, parent domains of two labels or more (the host's own included), and path prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("pattern")))
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", host, F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("pattern"))))
    none = F.array().cast("array<struct<kind:string,pattern:string>>")
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host.isNull(), none).otherwise(F.array_distinct(F.concat(own, domains, F.coalesce(prefixes, none))))


def _folded(first: Column, parts: Column) -> Column:
    """The hash of ``first``, then those after each of the parts."""
    start = F.struct(F.xxhash64(first).alias("h"), F.array(F.xxhash64(first)).alias("all"))

    def step(done: Column, part: Column) -> Column:
        h = F.xxhash64(done["h"], part)
        return F.struct(h.alias("h"), F.concat(done["all"], F.array(h)).alias("all"))

    return F.aggregate(parts, start, step)["all"]


def _last_folded(first: Column, parts: Column) -> Column:
    """The last of :func:`_folded`'s hashes."""
    return F.aggregate(parts, F.xxhash64(first), lambda h, part: F.xxhash64(h, part))


def _domain_hashes(host: Column) -> Column:
    """Of the host and its parent domains, from the last label: its own name, and those of two labels or more."""
    labels = F.reverse(F.split(host, r"\."))
    n = F.size(labels)
    return F.slice(_folded(F.lit("domain"), labels), F.least(n, F.lit(2)) + 1, n)


def _path_parts(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda x: x != "")


def key_hashes(url: Column) -> Column:
    """The hashes of :func:`keys_of`'s patterns, each with its kind."""
    host = host_of(url)
    prefixes = F.slice(_folded(F.concat(F.lit("prefix/"), host), _path_parts(url)), F.lit(2), F.lit(1 << 30))
    return F.when(host.isNull(), F.array().cast("array<bigint>")).otherwise(F.concat(F.array(F.xxhash64(F.concat(F.lit("host/"), host))), _domain_hashes(host), prefixes))


def pattern_hash(kind: Column, pattern: Column) -> Column:
    """The hash of an entry's pattern; null for an unknown kind."""
    parts = F.split(pattern, "/")
    labels = F.reverse(F.split(pattern, r"\."))
    prefix = _last_folded(F.concat(F.lit("prefix/"), parts[0]), F.slice(parts, F.lit(2), F.size(parts)))
    return F.when(kind == "host", F.xxhash64(F.concat(F.lit("host/"), pattern))).when(kind == "domain", _last_folded(F.lit("domain"), labels)).when(kind == "prefix", prefix)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``list, kind, pattern, valid_from, valid_to`` (exclusive; null: still valid) of each ``add``.

    Entries with a null field are passed over.  Repeated entries count once; of an ``add`` and a
    ``remove`` on one day the ``remove`` comes last.  An ``add`` after an ``add`` goes on from it.
    """
    clean = entries.select("list", "kind", "pattern", "action", "day").dropna().groupBy("list", "kind", "pattern", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "kind", "pattern").orderBy("day")
    return clean.withColumn("valid_to", F.lead("day").over(order)).filter(F.col("action") == ADD).select("list", "kind", "pattern", F.col("day").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """One row per distinct ``(id_col, url_col, day_col)``: these, ``host, n_copies, blocked, lists, first_pattern``.

    ``lists`` are the names of all lists with an entry for the capture on its day, in order and joined
    by commas; ``first_pattern`` is the first of their patterns.  A capture is blocked if there is one
    and the list ``allow`` isn't among them.  A null URL, one without a host, and a null day match
    nothing and aren't blocked.  Repeated captures are one row with their number; an empty list blocks
    nothing; an empty table gives no rows.  Other columns are ignored.
    """
    intervals = cut(validity_intervals(entries).withColumn("h", pattern_hash(F.col("kind"), F.col("pattern"))))
    rows_of, bytes_of = intervals.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pattern") + F.octet_length("list")), F.lit(0))).first()
    rows = captures.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(day_col).alias("__day"))
    hashed = rows.select("*", F.explode_outer(key_hashes(F.col("__url"))).alias("h"))
    if rows_of <= BROADCAST_ROWS and bytes_of <= BROADCAST_BYTES:
        held, keyed = F.broadcast(intervals.withColumn("salt", F.lit(0).cast("long"))), hashed.withColumn("salt", F.lit(0).cast("long"))
    else:
        counts = cut(hashed.filter("h is not null").groupBy("h").agg(F.count("*").alias("n")))
        most = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
        hot = F.broadcast(counts.filter(F.col("n") > most).select("h", F.ceil(F.col("n") / most).alias("salts")))  # fewer than HOT_SHARE rows
        salts = F.coalesce("salts", F.lit(1)).cast("long")
        keyed = hashed.join(hot, "h", "left").withColumn("salt", F.pmod(F.xxhash64("__id", "__url", "__day"), salts)).drop("salts")
        held = intervals.join(hot, "h", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    right = held.select("list", "kind", "pattern", "valid_from", "valid_to", F.col("h").alias("r_h"), F.col("salt").alias("r_salt"))
    match = (F.col("h") == F.col("r_h")) & (F.col("salt") == F.col("r_salt")) & (F.col("valid_from") <= F.col("__day")) & (F.col("valid_to").isNull() | (F.col("__day") < F.col("valid_to")))
    host = host_of(F.col("__url"))
    whole = F.concat_ws("/", host, F.array_join(_path_parts(F.col("__url")), "/"))
    exact = (
        F.when(F.col("kind") == "host", host == F.col("pattern")).when(F.col("kind") == "domain", (host == F.col("pattern")) | host.endswith(F.concat(F.lit("."), F.col("pattern"))))
        .otherwise((whole == F.col("pattern")) | whole.startswith(F.concat(F.col("pattern"), F.lit("/"))))
    )
    met = keyed.join(right, match, "left").withColumn("list", F.when(exact, F.col("list")))
    # Each row of a capture has one host key, so its number is the number of copies; a matched key may come from several lists.
    found = met.groupBy("__id", "__url", "__day").agg(
        F.array_sort(F.collect_set("list")).alias("names"), F.min(F.when(F.col("list").isNotNull(), F.col("pattern"))).alias("first_pattern"),
    )
    copies = rows.groupBy("__id", "__url", "__day").agg(F.count("*").alias("n_copies"))
    same = [found[c].eqNullSafe(copies[c]) for c in ("__id", "__url", "__day")]
    return found.join(copies, same[0] & same[1] & same[2]).select(
        found["__id"].alias(id_col), found["__url"].alias(url_col), found["__day"].alias(day_col), host_of(found["__url"]).alias("host"), "n_copies",
        ((F.size("names") > 0) & ~F.array_contains("names", ALLOW)).alias("blocked"), F.array_join("names", ",").alias("lists"), "first_pattern",
    )
