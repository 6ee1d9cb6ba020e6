"""Every registered query over odd and empty tables and, against plain versions written here, over whole small ones."""

import base64
import hashlib
import heapq
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from test_dedup import plain_components
from tokenizers import Tokenizer

from chunkmere.llm import language_id, queries, sharding

PAGES = [
    (1, "http://a.b/x y\n", "<p>one</p>"), (2, None, "<p>one</p>"), (9, "http://a.b/", "<p>one</p>"), (3, "u", None), (4, "http://h", ""), (None, "http://n.org/q", "zz"), (None, "http://n.org/r", "zz"),
    (5, "http://v.w", "é" * 50000), (5, "http://v.w", "é" * 50000), (6, "http://[bad", "<p>one</p>"), (6, "http://a.b/other", "only here"), (None, "http://a.b", "only here"), (7, "http://h/" + "p/" * 300, "long"),
]


@pytest.fixture(scope="module", params=["odd", "empty", "sf0.001"])
def sf(request, spark, odd, tmp_path_factory):
    """A folder of tables; the first two with columns that clash with the operators' own."""
    if request.param == "sf0.001":
        return "/root/testdata/sf0.001"
    path = str(tmp_path_factory.mktemp(request.param))
    pages = spark.createDataFrame([(*p, "x", 1, b"s") for p in PAGES], "page_id long, url string, html string, first string, payload int, sha binary").repartition(3)
    for name, df in (("documents", odd), ("pages", pages)):
        (df if request.param == "odd" else df.limit(0)).write.parquet(f"{path}/{name}.parquet")
    return path


def run(spark, sf, name):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return docs, queries.QUERIES[name](spark, sf).collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_exact_dedup(spark, sf):
    docs, rows = run(spark, sf, "op1_exact_dedup")
    best = {}
    for i, t in docs:
        known = best.setdefault(t, [None, 0])
        known[:] = max(-1 if known[0] is None else known[0], -1 if i is None else i), known[1] + 1
        known[0] = None if known[0] == -1 else known[0]
    want = Counter((i, best[t][0], best[t][1], i == best[t][0], hashlib.sha256(t.encode()).hexdigest()) for i, t in docs)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == want


def test_warc(spark, sf):
    pages = [(r.page_id, r.html or "") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    best = {}
    for i, h in pages:
        best[h] = max(best.get(h, -1), -1 if i is None else i)
    want = Counter()
    for i, h in pages:
        other = best[h] != (-1 if i is None else i)
        want[(i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if other else "response", best[h] if other else None)] += 1
    rows = queries.QUERIES["op2_warc"](spark, sf).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want


def test_pieces(spark, sf, pieces_model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces_model)
    docs, rows = run(spark, sf, "op3_pieces")
    want = Counter()
    for i, t in docs:
        ids = library.encode(t)
        want[(i, len(ids), crc(ids), len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), True)] += 1
    assert Counter((r.doc_id, r.n_pieces, r.ids_crc32, r.decoded_bytes, r.decoded_sha256, r.exact) for r in rows) == want


def test_ngram_join(spark, sf):
    docs, rows = run(spark, sf, "op4_ngram_join")
    want = plain_components([(i, t) for i, t in docs if i is not None])
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None) == Counter((i, *want[i]) for i, _ in docs if i is not None)
    assert sum(r.doc_id is None for r in rows) == sum(i is None for i, _ in docs)


def plain_fingerprint(payload):
    """Frame by frame: the three strongest local maxima, and their pairs with those of the next two frames."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    window = np.hanning(576).astype(np.float32)
    tops = []
    for k in range(1 + (len(x) - 576) // 288):
        m = np.abs(np.fft.rfft(x[288 * k : 288 * k + 576] * window)).astype(np.float32)
        found = [b for b in range(1, 288) if m[b] > m[b - 1] and m[b] >= m[b + 1] and m[b] > 1]
        tops.append(sorted(found, key=lambda b: (-m[b], b))[:3])
    codes = sorted(k << 32 | a << 16 | b << 4 | d for k, own in enumerate(tops) for d in (1, 2) if k + d < len(tops) for a in own for b in tops[k + d])
    return len(tops), sum(map(len, tops)), codes


def test_media(spark, sf):
    docs, rows = run(spark, sf, "op5_media")
    want, prints = Counter(), {}
    for i, t in docs:
        raw = t.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        head = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt " + bytes([16, 0, 0, 0, 1, 0, 1, 0]) + (8000).to_bytes(4, "little") * 2 + bytes([1, 0, 8, 0]) + b"data" + len(payload).to_bytes(4, "little")
        media = head + payload
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())] += 1
        prints[hashlib.sha256(payload).hexdigest()] = payload
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows) == want
    for r in rows[:60]:
        frames, peaks, codes = plain_fingerprint(prints[r.payload_sha256])
        assert r.fingerprint == codes and f"frames={frames};peaks={peaks};pairs={len(codes)};" in r.feature


def plain_ids(tokenizer, docs, end):
    library = Tokenizer.from_file(tokenizer)
    return [(i, t, [*library.encode(t, add_special_tokens=False).ids, end]) for i, t in docs]


def test_packing(spark, sf, tokenizer):
    docs, rows = run(spark, sf, "op6_packing")
    left, pieces = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        pieces[(r.doc_id, r.doc_tokens)].append(r)
    for i, _, ids in plain_ids(tokenizer, docs, 1):
        left[(i, len(ids))].append(ids)
    assert pieces.keys() == left.keys()
    for key, own in left.items():
        want = Counter((s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for ids in own for s in range(0, len(ids), 2048))
        assert Counter((r.start, r.length, r.ids_crc32) for r in pieces[key]) == want
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert all(n <= 2048 for n in ends.values())


def test_token_binary(spark, sf, tokenizer):
    docs, rows = run(spark, sf, "op7_token_binary")
    want, start = Counter(), 0
    for i, _, ids in sorted(plain_ids(tokenizer, docs, 0), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        want[(i, start, len(ids), crc(ids))] += 1
        start += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_language_id(spark, sf):
    docs, rows = run(spark, sf, "op8_language_id")
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 4 == 2
    learned = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    model = language_id.fit(spark.createDataFrame([(r.text, r.lang) for r in learned if not held(r.doc_id)], "text string, lang string"))
    longest = max(map(len, model.dictionaries.values()), default=0)
    coders = {}
    for lang, raw in model.dictionaries.items():
        raw = (raw * (longest // len(raw) + 1))[:longest]
        coders[lang] = zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
    want = Counter()
    for i, t in docs:
        if not coders or not any(c.isalpha() for c in t):
            want[(i, held(i), "und", 0.0, True)] += 1
            continue
        data = language_id.letters(t)
        blocks = [data[k : k + 2048] for k in range(0, len(data), 2048)]
        sizes = {lang: sum(len(c.compress(b)) for b in blocks) for lang, c in coders.items()}
        best, second, *_ = [*sorted(sizes.values()), math.inf]
        score = 1 / sum(2 ** (-(s - best) / (best * 0.02)) for s in sizes.values())
        want[(i, held(i), min(lang for lang, s in sizes.items() if s == best), round(score, 9), (second - best) / best < 0.002)] += 1
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9), r.rejected) for r in rows) == want


def test_sharding(spark, sf):
    """Given each text's place on the curve: which groups are set apart, where the others are cut, and every slot."""
    docs, rows = run(spark, sf, "op10_sharding")
    placed = sharding.shard_documents(spark.read.parquet(f"{sf}/documents.parquet")).select("text_crc32", "curve").distinct().collect()
    curve = {r.text_crc32: r.curve for r in placed}
    groups = Counter(t for _, t in docs)
    weight = {t: n * (len(t.encode()) + 1) for t, n in groups.items()}
    share = sum(weight.values()) / 8
    sha = {t: hashlib.sha256(t.encode()).digest() for t in groups}
    loads, where, split = [(0, k) for k in range(8)], {}, set()
    for t in sorted((t for t in groups if weight[t] > share / 512), key=lambda t: (-weight[t], sha[t])):
        load, k = loads[0]
        if load + weight[t] <= share or groups[t] == 1:
            heapq.heapreplace(loads, (load + weight[t], k))
            where[t] = k
        else:
            split.add(t)
    free = [max(0.0, share - load) for load, _ in sorted(loads, key=lambda x: x[1])]
    rest = sum(w for t, w in weight.items() if t not in where)
    ends = np.cumsum([x * rest / sum(free) if sum(free) else rest / 8 for x in free])[:-1]
    run_ = [(t, None, weight[t]) for t in groups if t not in where and t not in split] + [(t, i, len(t.encode()) + 1) for i, t in docs if t in split]
    before, shard = 0, defaultdict(list)
    for t, i, w in sorted(run_, key=lambda x: (curve[zlib.crc32(x[0].encode())], sha[x[0]], x[1] is not None, x[1] or 0)):
        shard[(t, i) if t in split else t].append(int((before + w / 2 >= ends).sum()))
        before += w
    want = Counter()
    for i, t in docs:
        k = where[t] if t in where else shard[(t, i)].pop() if t in split else shard[t][0]
        want[(i, len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", k, None)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == want
    of = {zlib.crc32(t.encode()): sha[t] for t in groups}
    for k in range(8):
        own = sorted((r for r in rows if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(curve[r.text_crc32], of[r.text_crc32], r.doc_id is not None, r.doc_id or 0) for r in own]
        assert keys == sorted(keys)


def test_url_filters(spark, sf):
    rows = queries.QUERIES["op9_url_filters"](spark, sf).collect()
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert Counter((r.page_id, r.n_copies) for r in rows) == Counter((r.page_id, r.n) for r in pages.groupBy("page_id", "url").agg(F.count("*").alias("n")).collect())
    assert not any(r.blocked for r in rows if r.host is None or r.day is None)
