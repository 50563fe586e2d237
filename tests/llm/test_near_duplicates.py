import random

import corpus_pipeline
import numpy as np
from brindle.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def stage(spark, rows):
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "").collect()), key=str)


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def groups(rows):
    """The smallest doc_id of each document's group, over all pairs."""
    least = {i: i for i, _ in rows}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def near_copies():
    rng = random.Random(5)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice((9, 40, 150, 400)))]
        for k in range(12):
            copy = list(words)
            for _ in range(k * len(words) // 220):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(900)}"
            rows.append((base * 100 + k, " ".join(copy[: len(copy) - k % 3])))
    rng.shuffle(rows)
    return rows


def test_near_copies_from_four_fifths_go(spark):
    rows = near_copies()
    least = groups(rows)
    assert 12 <= len(set(least.values())) < len(rows)
    assert {i for i, _ in stage(spark, rows)} == set(least.values())


def test_four_fifths_counts_and_less_does_not(spark):
    words = [f"w{i}" for i in range(49)]
    at = words[:22] + ["x"] + words[23:]  # 40 of 50 shingles
    below = words[:20] + ["y"] + words[21:] + ["z"]  # 40 of 51
    rows = [(1, " ".join(words)), (2, " ".join(at)), (3, " ".join(below))]
    assert groups(rows) == {1: 1, 2: 1, 3: 3}
    assert [i for i, _ in stage(spark, rows)] == [1, 3]


def test_a_large_slot_is_searched_across_its_groups(spark):
    # a chain: neighbours link, the ends do not
    words = [f"w{i}" for i in range(600)]
    rows = [(k, " ".join(words[k * 10 : k * 10 + 200])) for k in range(30)]
    assert set(groups(rows).values()) == {0}
    assert [i for i, _ in stage(spark, rows)] == [0]


def test_null_and_reused_ids_lose_only_near_copies(spark):
    far = " ".join(f"f{i}" for i in range(30))
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "found nowhere else"), (None, base + " end"), (1, base), (1, base), (1, far), (2, far), (3, base), (4, ""), (4, "another text of id four")]
    want = [(1, base), (1, far), (4, ""), (4, "another text of id four"), (None, "found nowhere else")]
    assert stage(spark, rows) == sorted(want, key=str)


def test_null_row_in_the_corpus(spark, corpus):
    rows = corpus_pipeline.drop_near_duplicates(spark, corpus, "").collect()
    # it is a copy of document 1 there, and stays where that is not
    assert sorted(r.doc_id for r in rows if r.text and r.text.startswith("w0 ")) == [1]
    alone = corpus_pipeline.drop_near_duplicates(spark, corpus.where("doc_id is null or doc_id > 7"), "").collect()
    assert [r.doc_id for r in alone if r.text and r.text.startswith("w0 ")] == [None]


def test_shingles_and_bands():
    assert len(jaccard.shingles("a b c d e f a b c d e")) == 6 and len(jaccard.shingles("")) == 0
    assert len(jaccard.shingles("A b")) == 1 and (jaccard.shingles("A b") == jaccard.shingles("a\n b")).all()
    found = jaccard.shingles(" ".join(f"w{i}" for i in range(5000)))
    assert len(found) == 4996 and len(set(jaccard.bands(found).tolist())) == jaccard.BANDS


def test_texts_that_cannot_link_are_left_out(spark):
    rng = random.Random(3)
    sets = [(k, sorted(rng.sample(range(60), rng.randrange(5, 40))) + [1000 * (k + 1) + i for i in range(rng.randrange(8))]) for k in range(40)]
    frame = spark.createDataFrame(sets, "node long, found array<long>")
    kept = {r.node: (r.m, r.p) for r in jaccard.weighed(frame).collect()}
    held = {k: set(x) for k, x in sets}
    for a, x in held.items():
        others = set().union(*(y for b, y in held.items() if b != a))
        assert (a in kept) == (5 * len(x & others) >= 4 * len(x))
        assert a not in kept or kept[a] == (len(x), len(x & others))


def test_odd_tables(spark, corpus):
    assert jaccard.deduplicated(corpus.limit(0)).count() == 0 and jaccard.similar(corpus.limit(0)).count() == 0
    clash = corpus.selectExpr("*", "1 as slot", "2 as block", "3 as stays", "4 as `a.b`", "5 as row_a")
    got = jaccard.deduplicated(clash)
    assert got.columns == clash.columns
    rows = got.collect()
    assert {(r.slot, r.block, r.stays, r["a.b"], r.row_a) for r in rows} == {(1, 2, 3, 4, 5)}
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in jaccard.deduplicated(corpus).collect())


def test_parity_bits_never_rule_out_a_link(spark):
    """They differ in no more places than the sets, and most pairs that are not alike enough go by them."""
    rng = np.random.default_rng(5)
    pairs = []
    for k in range(400):
        n, d = int(rng.integers(1, 400)), int(rng.integers(0, 120))
        h = rng.integers(0, 2**64, n + d, np.uint64)
        cut = int(rng.integers(0, d + 1))
        pairs.append((np.unique(h[: n + cut]), np.unique(np.concatenate([h[:n], h[n + cut :]]))))
    rows = [(k, len(a), len(b), jaccard.parity(a).view(np.int64).tolist(), jaccard.parity(b).view(np.int64).tolist()) for k, (a, b) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "k long, m long, l long, u array<long>, v array<long>")
    near = {r.k for r in frame.where(jaccard._near("u", "v")).collect()}
    alike = {k for k, (a, b) in enumerate(pairs) if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))}
    assert alike <= near and len(alike) > 50
    loose = {k for k, (a, b) in enumerate(pairs) if 10 * len(np.intersect1d(a, b)) < 7 * len(np.union1d(a, b))}
    assert len(loose) > 50 and len(loose & near) < len(loose) / 4
