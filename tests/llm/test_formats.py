"""Archives, token files, pieces, media: exact round trips, and damage that must be noticed."""

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from chunkmere.llm import media, token_binary, tokens, warc
from chunkmere.llm.pieces import decode_pieces, encode_pieces, piece_encoder, split_paths


def test_token_encoder_equals_the_library(tokenizer, docs):
    made = tokens.encoder(tokenizer)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab 1'.\n\t  é  　日本s!<|endoftext|>\r") for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    end = "<|endoftext|>"
    texts += ["".join(rng.choice([end, "<|", "|>", "end", " ", "a b", "\n"]) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    texts += [end, f"{end} at the start", f"in the {end} middle", f"at the end {end}", f"{end}{end}back to back {end} {end}"]
    texts += [r.text for r in docs.filter("doc_id < 50").collect()] + ["", " ", "  "]
    ids, bounds = made.encode(pa.array(texts))
    for i, x in enumerate(Tokenizer.from_file(tokenizer).encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == x.ids, repr(texts[i])


@pytest.mark.parametrize("top", [0, 1, 50257, (1 << 60) - 1, (1 << 64) - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 59, 60, 61, 5000):
        v = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        assert (token_binary.unpack(token_binary.pack(v)) == v).all()
    mixed = np.array([0] * 130 + [2**64 - 1, 2**60, 1, 2**60 - 1, 0], np.uint64)
    assert (token_binary.unpack(token_binary.pack(mixed)) == mixed).all()


def test_token_file_notices_damage():
    data = token_binary.make_file([3, None, -(2**62)], np.array([2, 1, 3]), np.array([5, 0, 0, 70000, 1, 0], np.uint32))
    docs, lengths, ids = token_binary.read_file(data)
    assert (docs, lengths.tolist(), ids.tolist()) == ([3, None, -(2**62)], [2, 1, 3], [5, 0, 0, 70000, 1, 0])
    for bad in (data[:-1], data[1:], data[:-20] + b"\xff" + data[-19:], b""):
        with pytest.raises((ValueError, struct.error)):
            token_binary.read_file(bad)


def test_token_files_in_order(docs, odd, tokenizer):
    library = Tokenizer.from_file(tokenizer)
    for df, size in ((docs, 3000), (odd, 1 << 20)):
        got = sorted((tuple(r) for r in token_binary.token_file_round_trip(df, tokenizer, 0, file_ids=size).collect()), key=lambda r: r[1])
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want, start = [], 0
        for i, t in rows:
            ids = [*library.encode(t, add_special_tokens=False).ids, 0]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want
    assert token_binary.token_file_round_trip(odd.limit(0), tokenizer, 0).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int, first string")


def test_archives_match_pages(spark):
    rows = [(1, "http://a/ b\n", "x"), (2, None, "x"), (9, "u", "x"), (3, "u", None), (4, "u", ""), (None, "n", "zz"), (5, "v", "é" * 100000), (5, "v", "é" * 100000)]
    got = warc.archive_round_trip(pages(spark, [(*r, 1, "c") for r in rows]).repartition(3)).collect()
    name = lambda i: f"urn:x-page:{'null' if i is None else i}"
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        other = i is not None and best[h or ""] != i
        want[(name(i), "revisit" if other else "response", name(best[h or ""]) if other else None, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())] += 1
    assert Counter((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got) == want
    assert warc.archive_round_trip(pages(spark, []).repartition(2)).count() == 0
    small = warc.archive_round_trip(pages(spark, [(*r, 1, "c") for r in rows]), least_bytes=5).filter("record_type = 'revisit'")
    assert small.count() == 0


def test_archive_files_on_disk(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").repartition(2)
    table, folder = f"file://{tmp_path}/table", str(tmp_path / "files")
    warc.write_archives(warc.crawl_records(df), table)
    warc.export_archives(spark, table, folder)
    got = {r.record_id: r.payload for r in warc.read_files(spark, f"file://{folder}/*.warc.zst").collect()}
    assert {int(k[11:]): bytes(v).decode() for k, v in got.items()} == {r.page_id: r.html for r in df.collect()}


def test_archive_has_a_dictionary_and_a_frame_for_each_record():
    records = [warc.make_record(f"urn:x-page:{i}", f"http://h/{i}", f"<html>page {i} {'text ' * 400}</html>".encode(), None) for i in range(200)]
    data = warc.make_archive(records)
    magic, n = struct.unpack_from("<II", data)
    assert magic == warc.SKIPPABLE and n > 0
    ends, at = [], 8 + n
    while at < len(data):
        at = warc.frame_end(memoryview(data), at)
        ends.append(at)
    assert len(ends) == len(records)
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompress(data[ends[0] : ends[1]])
    assert one == records[1]
    assert [r["record_id"] for r in warc.read_archive(data)] == [f"urn:x-page:{i}" for i in range(200)]
    for bad in (data[8 + n :], data[:-3], data[: 8 + n] + b"junk", b"", data[:200] + bytes([data[200] ^ 1]) + data[201:]):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.read_archive(bad))


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9"), (b"Content-Length: ", b"Content-Length: 1"), (b"payload", b"pAyload"), (b"WARC-Date", b"WARC Date"), (b"response\r\n", b"other\r\n")])
def test_damaged_records_are_refused(change):
    good = warc.make_record("urn:x-page:1", "http://h", b"the payload", None)
    assert warc.parse_record(good)["payload"] == b"the payload"
    with pytest.raises(warc.WarcError):
        warc.parse_record(good.replace(*change))
    with pytest.raises(warc.WarcError):
        warc.parse_record(good + b"x")


def test_pieces_equal_the_library(spark, pieces_model, docs, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces_model)
    made = piece_encoder(pieces_model)
    rng = random.Random(3)
    letters = list("abethnois  .,'1\n\té日本☃▁") + ["the ", "ing", "  ", "<s>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["", " ", "  ", " a", "a ", "a" * 100, "hello world"]
    ids, bounds = made.encode(pa.array(texts))
    want = library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert [d.decode() for d in made.decode(ids, bounds)] == library.decode(want)
    some = docs.filter("doc_id < 200").unionByName(odd.select(docs.columns))
    coded = encode_pieces(some, pieces_model)
    text = {(r.doc_id, r.text) for r in some.collect()}
    for r in coded.collect():
        assert r.exact and r.n_pieces == len(r.ids)
    assert {r.decoded_sha256 for r in coded.collect()} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in text}
    assert {(r.doc_id, r.text) for r in decode_pieces(coded, pieces_model).collect()} == {(i, t or "") for i, t in text}
    assert encode_pieces(odd.limit(0), pieces_model).count() == 0


def best_segmentation(made, word):
    """The plain Viterbi over characters: the largest summed score, the shorter last piece on ties."""
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end - 1, max(-1, end - 65), -1):
            part = word[start:end]
            piece = made.rank.get(part)
            if best[start] is None or piece is None and end - start > 1:
                continue
            score = best[start][0] + (-piece if piece is not None else made.lowest)
            if best[end] is None or score > best[end][0]:
                best[end] = score, best[start][1] + [part]
    out = []
    for part in best[-1][1]:
        out += [made.text.index(part)] if part in made.rank else [int(made.byte_ids[b]) for b in part.encode()]
    return out


def test_viterbi_takes_the_best_score(pieces_model, docs):
    from dataclasses import replace

    words = [" the", " nation", " interesting", " aaaa", " é日本☃x", "x" * 300, "naïve" * 50]
    words += [f" {w}" for r in docs.filter("doc_id < 3").collect() for w in r.text.split()[:30]]
    both = piece_encoder(pieces_model, True)
    ids, bounds, best, ends = split_paths(*both.encode(pa.array([w.strip() for w in words])))
    alone, alone_bounds = piece_encoder(pieces_model).encode(pa.array([w.strip() for w in words]))
    assert (ids == alone).all() and (bounds == alone_bounds).all()
    assert [best[a:z].tolist() for a, z in zip(ends, ends[1:])] == [best_segmentation(both, " " + w.strip()) for w in words]
    made = piece_encoder.__wrapped__(pieces_model)
    scores = -np.random.default_rng(4).random(len(made.text)) * 10
    made.vocabulary = replace(made.vocabulary, model=1, scores=scores)
    made.rank = {t: -float(scores[i]) for t, i in ((made.text[i], i) for i in made.key_ids)}
    ids, counts = made._encode_words(pa.array(words))
    ends = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:z].tolist() for a, z in zip(ends, ends[1:])] == [best_segmentation(made, w) for w in words]


def test_long_words_equal_the_library(pieces_model, monkeypatch):
    """Texts without spaces: by the scan, over several windows, and by the matrix."""
    import sentencepiece

    from chunkmere.llm import pieces

    rng = random.Random(8)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces_model)
    texts = ["".join(rng.choice(x) for _ in range(n)) for x in ("abcdefghij", "日本語の文章です", "aé☃x", "x") for n in (50, 230, 2000)]
    made = piece_encoder.__wrapped__(pieces_model, True)
    for most, window in ((192, 1 << 19), (10, 64), (1 << 20, 64)):
        monkeypatch.setattr(pieces, "LONG_BYTES", most)
        monkeypatch.setattr(pieces, "WINDOW_BYTES", window)
        made.forget()
        ids, bounds, best, ends = split_paths(*made.encode(pa.array(texts)))
        assert [ids[a:z].tolist() for a, z in zip(bounds, bounds[1:])] == library.encode(texts)
        got = [best[a:z].tolist() for a, z in zip(ends, ends[1:])]
        assert got == [best_segmentation(made, " " + t) for t in texts]


def test_media_payloads_and_fingerprints(docs, odd):
    for df in (docs, odd):
        rows = media.media_round_trip(df, keep_media=True).collect()
        texts = Counter((r.doc_id, r.text or "") for r in df.collect())
        assert len(rows) == sum(texts.values())
        by_bytes = {}
        for r in rows:
            payload = media.from_wav(bytes(r.media))
            raw = payload[: r.n_bytes]
            assert payload == raw + b"\xff" * (len(payload) - len(raw)) and len(payload) % 576 == 0 and 0 < len(payload) == r.payload_bytes < r.n_bytes + 577
            assert (r.doc_id, raw.decode()) in texts
            assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
            assert by_bytes.setdefault(raw, r.feature) == r.feature and r.fingerprint == sorted(r.fingerprint)
    assert media.media_round_trip(odd.limit(0)).count() == 0


def test_peaks_find_tones():
    t = np.arange(576 * 8)
    samples = np.round(128 + 60 * np.sin(2 * np.pi * 40 * t / 576) + 40 * np.sin(2 * np.pi * 90 * t / 576)).astype(np.uint8)
    bins, found = media.peaks(samples)
    assert found[:, :2].all() and (bins[:, 0] == 40).all() and (bins[:, 1] == 90).all()
    codes = media.fingerprint(bins[:, :2], found[:, :2])
    assert {(c >> 16 & 0xFFFF, c >> 4 & 0xFFF) for c in codes.tolist()} == {(40, 40), (40, 90), (90, 40), (90, 90)}


def test_pages_of_one_id_with_different_payloads(spark):
    rows = [(1, "<a>"), (1, "<only here>"), (9, "<a>"), (2, "<c>"), (2, "<d>"), (7, "<c>"), (10, "<d>")]
    out = warc.crawl_records(spark.createDataFrame([(i, "http://h", x) for i, x in rows], "page_id long, url string, html string")).collect()
    name = "urn:x-page:{}".format
    want = {(1, "<a>"): name(9), (1, "<only here>"): None, (9, "<a>"): None, (2, "<c>"): name(7), (2, "<d>"): name(10), (7, "<c>"): None, (10, "<d>"): None}
    assert sorted((r.record_id, bytes(r.payload).decode(), r.refers_to or "") for r in out) == sorted((name(i), x, to or "") for (i, x), to in want.items())
