"""Operator 4: n-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

Two sets of x and y shingles with a Jaccard similarity of t or more share at least
``t * max(x, y)``.  In one order of all shingles, the first ``x - o + l`` of a set that must share
``o`` with another hold at least ``l`` of the shared ones: its l-prefix.  A longer prefix costs more
lookups but a pair needs more matches before it is verified; each document takes the ``l`` whose
estimated cost (shingles looked up, and pairs verified at the expected rate) is least, and a pair
must match as often as the smaller ``l`` of its two documents.

The order is by document frequency, rarest first.  Frequencies are counted over all documents: blocks
of documents send each bucket of the hash space their distinct shingles, packed; buckets count and
answer each block with the shingles that another document has too.  Shingles of one document alone
come first in its order and can't match, so a document that shares less than ``o`` with all others
together is done.  What remains is counted once more among itself, with one document for each set.

Pairs aren't emitted within a group.  Where large families share prefix shingles, every document that
matches is first verified against one centre (a document of another component that has one of its
prefix shingles and few of its own), and the links are joined to components.  Such star rounds go on
while they halve the number of pairs that are in different components yet match.  Those that are left
are met block by block: a task compares two blocks of documents whole, verifies the pairs that match
often enough, and gives out only the links that join components.  No pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, bound_batches, cut, forget, keep_only, release_once, release_worker, text_or_empty
from .components import connected_components
from .shingles import WORDS, batches_of, digests

THRESHOLD = (80, 100)
#: Text of a block; bits of a shingle's hash within its bucket (with a bucket's own, 54 or more in all).
BLOCK_BYTES, LOW_BITS = 4 << 20, 48
#: Prefixes match up to so often; verifying a pair costs as much as looking so many shingles up, and one more for each of its set's ``VERIFY_EACH``.
MOST_MATCHES, VERIFY, VERIFY_EACH = 6, 4.0, 32
#: Star rounds go on while more pairs than this are left for each place in a prefix and a round halves them; how far later rounds' centres are spread.
PAIRS_EACH, MOST_ROUNDS, SPREAD = 256, 8, 0.05
#: Documents and shared shingles of a block of the exact pairing; columns of a dense product.
BLOCK_DOCS, BLOCK_SHARED, DENSE = 1024, 2 << 20, 4096
MANY = 0xFFFF

MESSAGE = "kind int, key long, block long, a binary, b binary, c binary, d binary"
DOCS, SHINGLES, REPEATED = 0, 1, 2
BLOCKS = "id long, n long, d1 long, d2 long, shared array<bigint>"
VERTICES = "id long, n long, matches int, prefix array<bigint>, shared array<bigint>"


def needed(n, threshold=THRESHOLD):
    """The least number of shingles that a set of ``n`` shares with a similar one."""
    return -(-threshold[0] * n // threshold[1])


def _messages(block: int, ids: np.ndarray, n: np.ndarray, dig: tuple, sends: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A block's messages.  ``tokens`` are LOW_BITS + bits wide; only documents in ``sends`` send theirs."""
    rows: list[tuple] = [(DOCS, block, block, ids.tobytes(), n.astype("<i8").tobytes(), dig[0].tobytes() + dig[1].tobytes(), sends.tobytes())]
    doc = np.repeat(np.arange(len(ids), dtype=np.uint16), np.diff(bounds))
    if not sends.all():
        held = sends[doc]
        tokens, doc = tokens[held], doc[held]
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(starts, len(ordered)))
    many = np.repeat(counts > 1, counts)
    if many.any():
        rows.append((REPEATED, block, block, ordered[many].tobytes(), doc[order][many].tobytes(), b"", b""))
    place = order[starts]  # the first of equal shingles stands for all
    count = np.zeros(len(tokens), np.uint32)
    count[place] = counts
    place = np.sort(place)
    tokens, doc, count = tokens[place], np.where(count[place] > 1, MANY, doc[place]).astype(np.uint16), count[place]
    bucket = (tokens >> np.uint64(LOW_BITS)).astype(np.uint16)
    by = np.argsort(bucket, kind="stable")
    tokens, doc, count, bucket = tokens[by], doc[by], count[by], bucket[by]
    cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    low = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    for k, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if e > s:
            # Documents ascend but for MANY, and their low bytes apart from the high ones compress well.
            own = doc[s:e]
            rows.append((SHINGLES, k, block, low[s:e].tobytes(), (own & 0xFF).astype(np.uint8).tobytes() + (own >> 8).astype(np.uint8).tobytes(), count[s:e].tobytes(), b""))
        if len(rows) >= 64:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    types = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], [x.split()[0] for x in MESSAGE.split(", ")])


def _table(rows: list[tuple]) -> pa.Table:
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("block", pa.int64()), *((x, pa.binary()) for x in "abcd")])
    return pa.Table.from_batches([_batch(rows)] if rows else [], schema)


def _send_texts(bits: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        part = TaskContext.get().partitionId()
        for k, (ids, hashes, bounds) in enumerate(batches_of(batches, BLOCK_BYTES)):
            n, dig = np.diff(bounds), digests(hashes, bounds)
            # Of equal sets in the block, the one with the smallest id sends.
            names = np.array(ids, np.int64)
            by = np.lexsort((names, dig[1], dig[0]))
            sends = np.zeros(len(ids), bool)
            same = (dig[0][by][1:] == dig[0][by][:-1]) & (dig[1][by][1:] == dig[1][by][:-1])
            sends[by[np.concatenate([[True], ~same])]] = True
            yield from _messages(part << 20 | k, names, n, dig, sends & (n > 0), hashes >> np.uint64(64 - LOW_BITS - bits), bounds, bits)

    return run


def _send_sets(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        part = TaskContext.get().partitionId()
        k = 0
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                s = b.slice(at, 20_000)
                sets = s.column(2)
                bounds = sets.offsets.to_numpy().astype(np.int64)
                tokens = sets.flatten().to_numpy().view(np.uint64)
                none = np.zeros(s.num_rows, np.int64)
                yield from _messages(part << 20 | k, s.column(0).to_numpy(), s.column(1).to_numpy(), (none, none), np.ones(s.num_rows, bool), tokens, bounds - bounds[0], bits)
                k += 1

    return run


def _count(key: tuple, group: pa.Table) -> pa.Table:
    """A bucket's answers: to each block those of its shingles that another document has too, with their frequency."""
    release_once()
    kind, bucket = key[0].as_py(), key[1].as_py()
    if kind != SHINGLES:
        return group
    blocks = group["block"].to_numpy()
    raw = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in group["a"].to_pylist()]
    sizes = [len(x) for x in raw]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    np.concatenate(raw, out=wide[:, :6])
    tokens = wide.view("<u8").ravel()
    halves = [np.frombuffer(x, np.uint8) for x in group["b"].to_pylist()]
    doc = np.concatenate([x[: len(x) // 2] | x[len(x) // 2 :].astype(np.uint16) << 8 for x in halves])
    count = np.concatenate([np.frombuffer(x, np.uint32) for x in group["c"].to_pylist()])
    source = np.repeat(np.arange(len(blocks)), sizes)
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.add.reduceat(count[order].astype(np.int64), starts)
    frequency = np.repeat(total, np.diff(np.append(starts, len(ordered))))
    shared = frequency > 1
    at, frequency, ordered = order[shared], frequency[shared], ordered[shared]
    by = np.argsort(source[at], kind="stable")
    at, frequency, ordered = at[by], frequency[by], ordered[by] | np.uint64(bucket << LOW_BITS)
    cuts = np.searchsorted(source[at], np.arange(len(blocks) + 1))
    return _table([(SHINGLES, int(blocks[k]), int(blocks[k]), ordered[s:e].tobytes(), doc[at[s:e]].tobytes(), frequency[s:e].astype("<u4").tobytes(), b"") for k, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if e > s])


def _gather(group: pa.Table) -> tuple:
    """(ids, n, digests, sends, document, shingle, frequency): a block's documents and its shared shingles."""
    parts = {k: group.filter(pa.array(group["kind"].to_numpy() == k)) for k in (DOCS, SHINGLES, REPEATED)}
    docs = parts[DOCS]
    ids, n = np.frombuffer(docs["a"][0].as_py(), "<i8"), np.frombuffer(docs["b"][0].as_py(), "<i8")
    dig = np.frombuffer(docs["c"][0].as_py(), "<i8").reshape(2, -1)
    sends = np.frombuffer(docs["d"][0].as_py(), bool)
    join = lambda t, c, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in t[c].to_pylist())])
    token, doc, freq = (join(parts[SHINGLES], c, k) for c, k in (("a", "<u8"), ("b", "<u2"), ("c", "<u4")))
    many = doc == MANY
    if many.any():
        by = np.argsort(token[many])
        known, known_freq = token[many][by], freq[many][by]
        more, more_doc = join(parts[REPEATED], "a", "<u8"), join(parts[REPEATED], "b", "<u2")
        token = np.concatenate([token[~many], more])
        doc = np.concatenate([doc[~many], more_doc])
        freq = np.concatenate([freq[~many], known_freq[np.searchsorted(known, more)]])
    return ids, n, dig, sends, doc, token, freq


def _shared(threshold: tuple[int, int]):
    """A block's documents, with their shared shingles where there are enough of them to be similar to any."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        release_once()
        ids, n, dig, sends, doc, token, _ = _gather(group)
        counts = np.bincount(doc, minlength=len(ids))
        live = sends & (counts >= needed(n, threshold))
        held = live[doc]
        doc, token = doc[held], token[held]
        by = np.lexsort((token, doc))
        bounds = np.concatenate([[0], np.cumsum(np.where(live, counts, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(token[by].view(np.int64)), mask=pa.array(~live))
        return pa.table({"id": ids, "n": n, "d1": dig[0], "d2": dig[1], "shared": lists})

    return run


def choose_prefix(n: int, frequency: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> tuple[int, int]:
    """(matches, length of the prefix among the shared shingles) of least estimated cost, for shared shingles in order."""
    least = int(needed(n, threshold))
    alone = n - len(frequency)
    postings = np.cumsum(frequency.astype(np.int64) - 1)
    best = None
    for matches in range(1, min(MOST_MATCHES, least) + 1):
        length = min(len(frequency), n - least + matches - alone)
        looked_up = float(postings[length - 1]) + length
        cost = looked_up + (VERIFY + n / VERIFY_EACH) * float(postings[length - 1]) / matches
        if best is None or cost < best[0]:
            best = cost, matches, length
    return best[1], best[2]


def _prefixes(threshold: tuple[int, int]):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        release_once()
        ids, n, _, _, doc, token, freq = _gather(group)
        by = np.lexsort((token, freq, doc))
        doc, token, freq = doc[by], token[by], freq[by]
        cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
        out = []
        for i, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if e - s >= needed(int(n[i]), threshold):
                matches, length = choose_prefix(int(n[i]), freq[s:e], threshold)
                own = token[s:e].view(np.int64)
                out.append((int(ids[i]), int(n[i]), matches, own[:length], own))
        cols = list(zip(*out)) if out else [()] * 5
        types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "n", "matches", "prefix", "shared"])

    return run


def _exchange(messages: DataFrame, finish: Callable, schema: str) -> DataFrame:
    counted = messages.groupBy("kind", "key").applyInArrow(_count, MESSAGE)
    return counted.groupBy("block").applyInArrow(finish, schema)


def _bits(df: DataFrame) -> int:
    """Bits of a bucket's number: about eight buckets for each partition of the input."""
    return min(16, max(6, (8 * df.rdd.getNumPartitions() - 1).bit_length()))


def candidate_vertices(texts: DataFrame, threshold: tuple[int, int] = THRESHOLD, words: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows ``(id long, text)``: (all documents with n, those whose set another stands for, the vertices that may be similar to another)."""
    bits = _bits(texts)
    blocks = cut(_exchange(texts.mapInArrow(_send_texts(bits, words), MESSAGE), _shared(threshold), BLOCKS))
    docs = blocks.select("id", "n", "d1", "d2")
    full = docs.filter("n > 0")
    classes = full.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("class_size"))
    more = cut(classes.filter("class_size > 1").select(F.struct("d1", "d2").alias("set"), "rep", "class_size"))
    copies = cut(attach_groups(full.select("id", "d1", "d2", F.struct("d1", "d2").alias("set")), more, "set", "class_size").filter("id <> rep").select("id", "d1", "d2", "rep"))
    forget(more)
    live = keep_only(blocks.filter("shared is not null").select("id", "n", "d1", "d2", "shared"), ["id", "d1", "d2"], copies).select("id", "n", "shared")
    vertices = cut(_exchange(live.mapInArrow(_send_sets(bits), MESSAGE), _prefixes(threshold), VERTICES))
    return docs, copies, vertices


def _similar(pairs: DataFrame, vertices: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs ``(x, y)`` whose sets are similar: those whose prefixes match as often as both demand are verified."""
    num, den = threshold
    side = lambda k: vertices.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("matches").alias(f"m{k}"), F.col("prefix").alias(f"p{k}"), F.col("shared").alias(f"s{k}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").filter(F.size(F.array_intersect("px", "py")) >= F.least("mx", "my"))
    both = both.withColumn("o", F.size(F.array_intersect("sx", "sy")))
    return both.filter(F.lit(den) * F.col("o") >= F.lit(num) * (F.col("nx") + F.col("ny") - F.col("o"))).select("x", "y")


def _pair_block(threshold: tuple[int, int]):
    """Links between documents of a block pair that are in different components: as few as join them."""
    num, den = threshold

    def run(key: tuple, group: pa.Table) -> pa.Table:
        release_once()
        ids, n, comp, wanted, rest = (group[c].to_numpy() for c in ("id", "n", "comp", "matches", "rest"))
        lists = {c: group[c].combine_chunks() for c in ("prefix", "shared")}
        bounds = {c: x.offsets.to_numpy().astype(np.int64) for c, x in lists.items()}
        values = {c: x.values.to_numpy() for c, x in lists.items()}
        sizes = np.diff(bounds["shared"])
        row = len(ids)

        def met(column: str) -> np.ndarray:
            """How many of the column's shingles each two documents share."""
            size = np.diff(bounds[column])
            own = values[column][bounds[column][0] : bounds[column][-1]]
            token, code, often = np.unique(own, return_inverse=True, return_counts=True)
            doc = np.repeat(np.arange(row), size)
            out = np.zeros((row, row), np.float32)
            dense = np.flatnonzero(often > 16)
            place = np.full(len(token), -1)
            place[dense] = np.arange(len(dense))
            for at in range(0, len(dense), DENSE):
                k = place[code] - at
                held = (k >= 0) & (k < DENSE)
                m = np.zeros((row, min(DENSE, len(dense) - at)), np.float32)
                m[doc[held], k[held]] = 1.0
                out += m @ m.T
            held = (place[code] < 0) & (often[code] > 1)
            by = np.argsort(code[held], kind="stable")
            some, which = doc[held][by], code[held][by]
            for gap in range(1, 16):  # of a run of equal shingles, those so far apart
                same = which[gap:] == which[:-gap]
                if not same.any():
                    break
                flat = np.bincount(some[:-gap][same] * row + some[gap:][same], minlength=0)
                x = np.flatnonzero(flat)
                out[x // row, x % row] += flat[x]
                out[x % row, x // row] += flat[x]
            return out

        at = np.arange(row)
        ok = (at[:, None] < at) & (comp[:, None] != comp) & (rest[:, None] | rest)
        most = np.minimum(sizes[:, None], sizes)
        ok &= den * most >= num * (n[:, None] + n - most)
        ok &= met("prefix") >= np.minimum(wanted[:, None], wanted)
        out = []
        if ok.any():
            o = met("shared").astype(np.int64)
            root = {c: c for c in comp.tolist()}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for i, j in np.argwhere(ok & (den * o >= num * (n[:, None] + n - o))).tolist():
                u, v = find(int(comp[i])), find(int(comp[j]))
                if u != v:
                    root[max(u, v)] = min(u, v)
                    out.append((int(ids[i]), int(ids[j])))
        cols = list(zip(*out)) if out else [(), ()]
        return pa.table({"x": pa.array(cols[0], pa.int64()), "y": pa.array(cols[1], pa.int64())})

    return run


def _prefix_posts(vertices: DataFrame, component: DataFrame | None, turn: int) -> DataFrame:
    """``id, n, rank, comp, token`` for each shingle of each prefix.

    What has the fewest shingles of its own is the likeliest centre; later turns try others too.
    """
    alone = 1 - F.size("shared") / F.col("n")
    rank = alone + SPREAD * turn * F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
    own = vertices.select("id", "n", rank.alias("rank"), "prefix")
    if component is None:
        own = own.withColumn("comp", F.col("id"))
    else:
        own = cut(own.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"))
    return own.select("id", "n", "rank", "comp", F.explode("prefix").alias("token"))


def _open_tokens(posts: DataFrame, alone: bool) -> DataFrame:
    """Of each prefix shingle that documents of several components have: its ``first`` by rank, ``least`` id, ``members``, and ``squares`` of its components' members.

    ``alone``: every document is a component of its own still.
    """
    if alone:
        by_comp = posts.select("token", "comp", F.struct("rank", "id", "n").alias("c"), F.col("id").alias("least"), F.lit(1).cast("long").alias("m"))
    else:
        by_comp = posts.groupBy("token", "comp").agg(F.min(F.struct("rank", "id", "n")).alias("c"), F.min("id").alias("least"), F.count("*").alias("m"))
    by_token = by_comp.groupBy("token").agg(
        F.min(F.struct("c.rank", "comp", "c.id", "c.n")).alias("first"), F.min("least").alias("least"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.sum("m").alias("members"), F.sum(F.col("m") * F.col("m")).alias("squares"),
    )
    return by_token.filter("low <> high").drop("low", "high")


def _star_links(posts: DataFrame, tokens: DataFrame, vertices: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links of documents with one centre each: the first document of a shingle, that which most of its prefix's shingles name."""
    num, den = threshold
    met = attach_groups(posts, tokens.select("token", "first", "members"), "token", "members").filter("comp <> first.comp")
    met = met.filter(F.lit(den) * F.least("n", "first.n") >= F.lit(num) * F.greatest("n", "first.n"))
    hits = met.select("id", F.col("first.id").alias("centre")).repartition("id").groupBy("id", "centre").agg(F.count("*").alias("hits"))
    best = hits.groupBy("id").agg(F.max(F.struct("hits", "centre")).alias("best"))
    return _similar(best.select(F.col("id").alias("x"), F.col("best.centre").alias("y")), vertices, threshold)


def _pair_the_rest(posts: DataFrame, tokens: DataFrame, component: DataFrame | None, vertices: DataFrame, threshold: tuple[int, int], block: tuple[int, int]) -> DataFrame:
    """Links between documents of different components that share a prefix shingle, none left out.

    Documents that such shingles connect are a family.  It is cut into blocks of about ``block`` documents and
    shared shingles, and every two blocks meet in a task, but for those of the family's largest
    component among themselves.
    """
    edges = attach_groups(posts.select("id", "token"), tokens.select("token", "least", "members"), "token", "members").filter("id <> least")
    own = connected_components(edges.select("id", "least"), "id", "least").select(F.col("node").alias("id"), F.col("component").alias("family"))
    if component is None:
        own = own.withColumn("comp", F.col("id"))
    else:
        own = own.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    own = cut(own.join(vertices.select("id", F.size("shared").cast("long").alias("w")), "id"))
    by_comp = own.groupBy("family", "comp").agg(F.count("*").alias("k"), F.sum("w").alias("w"))
    sizes = by_comp.groupBy("family").agg(F.max(F.struct("k", "comp", "w")).alias("top"), F.sum("k").alias("all"), F.sum("w").alias("w"))
    blocks = lambda k, w: F.greatest(F.ceil(k / block[0]), F.ceil(w / block[1])).cast("long")
    sizes = cut(sizes.select("family", "all", F.col("top.comp").alias("main"), blocks(F.col("top.k"), F.col("top.w")).alias("blocks"), blocks(F.col("all") - F.col("top.k"), F.col("w") - F.col("top.w")).alias("rest_blocks")))
    placed = attach_groups(own.drop("w"), sizes, "family", "all").withColumn("rest", F.col("comp") != F.col("main"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("rest_blocks")).otherwise(F.col("blocks"))))
    with_rest = F.sequence(F.lit(0).cast("long"), F.col("rest_blocks") - 1)
    with_main = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    task = lambda a, b, kind: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(kind).alias("kind"))
    # Two blocks of the rest meet with each other; the main component's block 0 joins a meeting of one with itself.
    of_rest = F.concat(F.transform(with_rest, lambda k: task(F.least(k, F.col("block")), F.greatest(k, F.col("block")), "rest")), F.transform(F.filter(with_main, lambda k: k > 0), lambda k: task(k, F.col("block"), "main")))
    of_main = F.transform(with_rest, lambda k: F.when(F.col("block") == 0, task(k, k, "rest")).otherwise(task(F.col("block"), k, "main")))
    sent = placed.withColumn("task", F.explode(F.when(F.col("rest"), of_rest).otherwise(of_main))).select("id", "comp", "rest", "family", "task.*")
    sent = sent.join(vertices.select("id", "n", "matches", "prefix", "shared"), "id")
    return sent.groupBy("family", "a", "b", "kind").applyInArrow(_pair_block(threshold), "x long, y long")


def similar_components(vertices: DataFrame, threshold: tuple[int, int] = THRESHOLD, pairs_each: float = PAIRS_EACH, block: tuple[int, int] = (BLOCK_DOCS, BLOCK_SHARED)) -> DataFrame:
    """``(id, component)`` of the vertices that have a link, by the smallest id."""
    component = last = None
    for turn in range(MOST_ROUNDS + 1):
        posts = _prefix_posts(vertices, component, turn)
        tokens = cut(_open_tokens(posts, component is None))
        pairs = (F.col("members") * F.col("members").cast("double") - F.col("squares")) / 2
        left, members = tokens.agg(F.sum(pairs), F.sum("members")).first()
        if not left:
            break
        exact = left <= pairs_each * members or turn == MOST_ROUNDS or last is not None and left > 0.5 * last
        last = left
        links = _pair_the_rest(posts, tokens, component, vertices, threshold, block) if exact else _star_links(posts, tokens, vertices, threshold)
        if component is not None:
            links = links.unionByName(component.filter("node <> component").select(F.col("node").alias("x"), F.col("component").alias("y")))
        component = connected_components(links, "x", "y")
        forget(tokens)
        if exact:
            break
    if component is None:
        return vertices.select("id", F.col("id").alias("component")).limit(0)
    return component.select(F.col("node").alias("id"), "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id``.

    Two documents link when their sets' Jaccard similarity is at least ``threshold`` (a fraction);
    ``component_id`` is the smallest id that can be reached by links, the document's own included.
    Empty and null texts have no shingle and link with nothing; equal sets link.  Rows that share an id
    are one vertex; a null id has a null component and links with nothing; an empty table gives no
    rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    named = rows.filter("id is not null")
    all_docs, copies, vertices = candidate_vertices(named, threshold, words)
    found = similar_components(vertices, threshold)
    # An id that stands for several sets joins what they are linked with.
    several = all_docs.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id")
    several = cut(copies.join(several, "id", "left_semi").select("id", "rep"))
    if not several.isEmpty():
        edges = found.select(F.col("id").alias("x"), F.col("component").alias("y")).unionByName(several.select(F.col("id").alias("x"), F.col("rep").alias("y")))
        found = connected_components(edges, "x", "y").select(F.col("node").alias("id"), "component")
    # Copies of a set take the component of the one that stands for it.
    of_copy = copies.select("id", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    own = cut(found.unionByName(of_copy).groupBy("id").agg(F.min("component").alias("component")))
    out = all_docs.select("id", "n").join(own, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    missing = rows.filter("id is null")
    if not missing.isEmpty():
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, bounds in batches_of(batches, BLOCK_BYTES):
                yield pa.RecordBatch.from_pydict({"n_shingles": pa.array(np.diff(bounds), pa.int64())})

        lost = missing.mapInArrow(count, "n_shingles long")
        out = out.unionByName(lost.select(F.lit(None).cast("long").alias(id_col), "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs``, all columns as they were, with the document of each component that has the smallest id."""
    found = cut(near_duplicates(docs, id_col, text_col, threshold))
    return keep_only(docs, [id_col], found.filter(F.col(id_col) != F.col("component_id")).select(id_col))
