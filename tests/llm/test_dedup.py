"""Exact dedup, shingles, the near-duplicate join, components."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from chunkmere.llm.components import connected_components
from chunkmere.llm.exact_dedup import drop_copies, exact_dedup, merge_runs
from chunkmere.llm.ngram_join import candidate_vertices, choose_prefix, drop_near_duplicates, near_duplicates, needed, similar_components
from chunkmere.llm.shingles import shingle_sets


def plain_groups(rows, keep):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    best = {}
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        best[t] = ((max if keep == "max" else min)(known) if known else None, len(ids))
    return best


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("nodes", [2, 32, 64])
def test_exact_dedup_matches_groups(docs, odd, keep, nodes):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = plain_groups(rows, keep)
        got = exact_dedup(df, keep=keep, nodes=nodes).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == Counter(
            (i, want[t or ""][0], want[t or ""][1], i == want[t or ""][0], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows
        )


def test_exact_dedup_of_one_text_and_of_nothing(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "'hot' AS text").repartition(7)
    assert {(r.keep_id, r.group_size) for r in exact_dedup(df).collect()} == {(0, 2000)}
    assert exact_dedup(df.limit(0)).count() == 0 and drop_copies(df.limit(0)).count() == 0


def test_drop_copies_keeps_columns_and_one_row_each(odd):
    out = drop_copies(odd, keep="max")
    assert out.columns == odd.columns
    got = Counter(r.text or "" for r in out.collect())
    assert set(got.values()) == {1} and len(got) == len({r.text or "" for r in odd.collect()})
    assert {r.doc_id for r in out.filter("text LIKE 'same%'").collect()} == {9}


def test_merge_refuses_a_digest_of_two_lengths():
    run = lambda n: [(b"d" * 32, 0, 1, 1, 1, n)]
    assert list(merge_runs([run(4), run(4)], 1)) == [(b"d" * 32, 0, 1, 2, 2, 4)]
    with pytest.raises(ValueError):
        list(merge_runs([run(4), run(5)], 1))


def plain_set(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lower)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_shingles_match_plain_sets():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aAbB \t\né") for _ in range(rng.randint(0, 50))) for _ in range(500)]
    hashes, bounds = shingle_sets(pa.array(["cut off", *texts, None]).slice(1))
    sets = [plain_set(t) for t in texts]
    for i, s in enumerate(sets):
        assert bounds[i + 1] - bounds[i] == len(s)
    for _ in range(2000):
        i, j = rng.randrange(500), rng.randrange(500)
        assert len(np.intersect1d(hashes[bounds[i] : bounds[i + 1]], hashes[bounds[j] : bounds[j + 1]])) == len(sets[i] & sets[j])


def plain_components(rows):
    """All pairs of distinct sets, without any filter."""
    sets = {i: plain_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_set = defaultdict(list)
    for i in sorted(sets):
        if sets[i]:
            by_set[sets[i]].append(i)
    groups = list(by_set.items())
    for a, (s, ids) in enumerate(groups):
        for i in ids:
            root[find(i)] = root[find(ids[0])]
        for t, other in groups[:a]:
            if min(len(s), len(t)) * 5 >= max(len(s), len(t)) * 4 and 100 * (k := len(s & t)) >= 80 * (len(s) + len(t) - k):
                x, y = find(ids[0]), find(other[0])
                root[max(x, y)] = min(x, y)
    least = {}
    for i in sorted(sets):
        least.setdefault(find(i), i)
    return {i: (len(sets[i]), least[find(i)]) for i in sets}


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == plain_components(rows)


def test_near_duplicates_match_all_pairs(docs):
    check(docs)


def test_near_duplicates_of_a_hot_family(spark):
    """Copies of one text with a few words changed, dissimilar texts with one passage, short texts, an edge case of exactly 0.8."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [" ".join(passage + [word() for _ in range(rng.randint(3, 60))]) for _ in range(150)]
    texts += ["One two", "one  TWO", "one two three", "", " ", "a b c d e f g h i", "a b c d e f g h z", "a b c d e f g h i j"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    check(df)
    # By star rounds first, and in small blocks, the links join the same documents.
    _, _, vertices = candidate_vertices(df.withColumnRenamed("doc_id", "id"))
    want = Counter(map(tuple, similar_components(vertices).collect()))
    assert len(want) > 50
    for pairs_each, block in ((0, (1024, 1 << 20)), (0, (11, 1 << 20)), (1e9, (13, 900))):
        assert Counter(map(tuple, similar_components(vertices, pairs_each=pairs_each, block=block).collect())) == want


def test_an_id_of_several_texts_joins_what_they_link_with(spark):
    a, b = " ".join(map(str, range(40))), " ".join(map(str, range(100, 140)))
    rows = [(3, a), (5, a), (5, b), (9, b + " 140"), (7, "one two three four five six"), (7, "six five four three two one"), (8, "one two three four five six")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 36, 3), (5, 36, 3), (9, 37, 3), (7, 2, 7), (8, 2, 7)}


def test_near_duplicates_of_odd_rows(odd):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(odd).collect())
    assert got[(9, 3, 3)] == got[(5, 3, 3)] == got[(3, 3, 3)] == 1
    assert got[(7, 0, 7)] == 1 and got[(4, 0, 4)] == 1 and got[(1, 1, 1)] == 1 and got[(6, 1, 6)] == 1 and got[(None, 1, None)] == 1
    assert near_duplicates(odd.limit(0)).count() == 0
    out = drop_near_duplicates(odd)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} == {None, 1, 2, 3, 4, 6, 7, 8, 10}


def test_needed_and_prefixes():
    for n in range(1, 300):
        assert needed(n) == min(k for k in range(1, n + 1) if 100 * k >= 80 * n)
    for n, shared in ((10, 8), (10, 10), (500, 450)):
        for f in (np.full(shared, 2), np.arange(2, shared + 2)):
            matches, length = choose_prefix(n, f)
            assert 1 <= matches <= needed(n) and length == min(shared, n - needed(n) + matches - (n - shared))


@pytest.mark.parametrize("task_edges", [1 << 19, 9])
def test_components_of_chains_and_stars(spark, task_edges):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201)]
    random.Random(2).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = connected_components(df, "a", "b", task_edges).collect()
    assert Counter(map(tuple, got)) == Counter({**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}.items())
    assert connected_components(df.limit(0), "a", "b", task_edges).count() == 0


def test_shingles_of_very_long_texts():
    """Runs of words hashed apart, one word longer than a run, give the sets of the whole."""
    words = [f"w{i % 70001}" for i in range(400_000)] + ["x" * 3_000_000] + ["tail"] * 5
    (hashes, bounds), (short, cut) = shingle_sets(pa.array([" ".join(words), "a b"])), shingle_sets(pa.array([" ".join(words[-7:]), "a b"]))
    grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    assert bounds[1] == len(grams) and np.isin(short, hashes).all() and (hashes[bounds[1] :] == short[cut[1] :]).all()
