import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from brindle.llm import simhash, toxicity
from test_near_duplicates import groups
from test_secret_parts import brute as secret_spans
from test_text_operators import WORD, removed
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_repeats(rows):
    """Texts without the words of repeated passages: a kept word keeps the white space before it."""
    first = {}
    words = {i: [m.span() for m in WORD.finditer(t)] for i, t in rows.items()}
    for i, w in words.items():
        for p in range(len(w) - 49):
            g = tuple(rows[i][a:b] for a, b in w[p : p + 50])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in words.items():
        t, gone = rows[i], [False] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(t[a:b] for a, b in w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        ends = [0, *(b for _, b in w)]
        if not w or not all(gone):
            out[i] = "".join(t[ends[k] : b] for k, (_, b) in enumerate(w) if not gone[k]) + t[ends[-1] :]
    return out


def redacted(t):
    """A mark for each stretch that spans cover; spans that touch are one stretch."""
    out, at, open_ = [], 0, False
    for a, _, b in secret_spans(t):
        if not open_ or a > at:
            out += [t[at:a], "[SECRET]"]
        at, open_ = max(at, b), True
    return "".join([*out, t[at:]])


def brute(spark):
    """The stages one after another over Python lists."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity.fit(*toxicity.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    match = toxicity.Matcher(model.weights)
    rows = {i: t for i, t in rows.items() if model.score(np.array([toxicity.features(t, match)]))[0] < 0.5}
    least = groups(list(rows.items()))
    rows = {i: t for i, t in rows.items() if least[i] == i}
    removed_ = [x for x in removed(list(rows.items()), 50) if x[2]]
    rows = without_repeats(rows)
    assert removed_ and all(" ".join(WORD.findall(rows[i])) == kept for i, n, gone, kept in removed_ if gone < n)
    out = Counter()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in rows.items():
        ids = np.array([*tok.encode(redacted(t), add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            out[i, a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    return out


def test_run_matches_brute_force(spark):
    want = brute(spark)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_stages_keep_the_columns_and_odd_rows(spark, corpus):
    docs = corpus.union(spark.createDataFrame([(None, "found nowhere else", "en", "s", 18), (None, "nor is this one", "en", "s", 15), (8, "another text of id eight", "en", "s", 24)], corpus.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == COLUMNS and docs.dtypes == corpus.dtypes
    found = docs.collect()
    # copies and near copies are gone, odd rows stay
    assert Counter(r.text for r in found if r.doc_id is None) == Counter(["found nowhere else", "nor is this one"])
    assert sorted(r.text or "" for r in found if r.doc_id == 8) == ["", "another text of id eight"]
    rows = {r.doc_id: r for r in found}
    assert 1 in rows and 5 not in rows and {8, 11, 13, 14} <= set(rows)
    assert all(r.n_chars == len(r.text or "") for r in found if r.text is not None)
    assert len(rows[1].text.split()) == 120
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("start = 0").count() == len(found)


def test_stages_of_an_empty_table(spark, corpus):
    docs = corpus.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_secrets_are_gone_after_the_stage(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefgh b", "en", "s", 18), (2, "clean text", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, docs, SF).collect()}
    assert rows == {1: "a [SECRET] b", 2: "clean text"} and not re.search("abcdefgh", rows[1])
    assert simhash.near_duplicates(docs).count() == 2 and WORD.findall(rows[1])
