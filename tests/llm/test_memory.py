import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
from brindle.llm import packing
from brindle.llm.common import GIVE_BACK_S, arrow_map


def test_workers_give_memory_back_between_batches_and_tasks(spark):
    """Small blocks freed below one that stays: the C library alone keeps them all."""

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nRss:\s+(\d+)", f.read())[1]) / 1024

    def f(batches):
        for _ in batches:
            before = held()
            blocks = [np.ones(50_000, np.uint8) for _ in range(6000)]
            most, last = held(), blocks[-1]
            del blocks
            time.sleep(2 * GIVE_BACK_S)
            yield pa.RecordBatch.from_arrays([pa.array([before]), pa.array([most])], names=["before", "most"])
            yield pa.RecordBatch.from_arrays([pa.array([held()]), pa.array([most])], names=["before", "most"])
            del last

    rows = arrow_map(spark.range(0, 1, 1, 1), f, "before double, most double").collect()
    assert rows[0].most - rows[0].before > 250
    assert rows[1].before - rows[0].before < 100


def test_kept_words_are_bounded_in_bytes():
    """Texts without spaces are few, long words; all of them are new."""
    w = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(24):
        words = [b"%d" % (k * 100 + j) + b"ab" * 20_000 for j in range(50)]
        ids, n = w.encode(words)
        assert len(n) == 50 and n.sum() == len(ids)
        assert sum(map(len, w.known)) + 4 * int(w.ends[w.count - 1]) <= packing.KEPT_BYTES + sum(map(len, words)) + 4 * len(ids)
    assert w.tok.encode(words[-1].decode(), add_special_tokens=False).ids == ids[len(ids) - n[-1] :].tolist()
