"""Quality by weak supervision: rules vote or abstain, expectation-maximisation rates them, a posterior decides."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, durable, pick, text_slices

CHUNK = 1 << 20
#: Words of a repetition window.
SPAN = 5
#: The characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: The counts of a text, in the order of the output.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_long", "n_stops")


def _repeated(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words lie in a SPAN-word window found twice or more in their text; exact.

    Windows are named by rounds of pairing, two names at a time, each round a lookup of the pair itself.
    """
    n = len(codes)
    out = np.zeros(n, bool)
    if n < SPAN:
        return out
    row = np.repeat(np.arange(len(doc) - 1), np.diff(doc))
    name = codes.astype(np.int64)

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    two = pair(name[:-1], name[1:])
    four = pair(two[:-2], two[2:])
    five = pair(four[: n - SPAN + 1], name[SPAN - 1 :])
    inside = row[: n - SPAN + 1] == row[SPAN - 1 :]
    key = pair(row[: n - SPAN + 1], five)
    times = np.bincount(key[inside], minlength=int(key.max()) + 1)
    hit = np.flatnonzero(inside & (times[key] > 1))
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + SPAN, -1)
    return np.cumsum(step[:-1]) > 0


def _dup_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines)), len(lines)


# The commonest short words of four languages, the marks of running prose.
STOPS = frozenset(
    b"the of and to in a is that it for on with as by an be at from or this "
    b"de la le et les des en un une du que pour dans est sur pas "
    b"der die und das von zu den mit ist des ein sich auf nicht "
    b"el los las y por con para una se del al su".split()
)


def measure(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id and COUNTS (long) of the whole text; one pass, no shuffle.

    A null or empty text has no words; repeated rows stay; other columns are ignored; an empty table gives none.
    """

    def run(batches):
        for b in text_slices(batches, limit=CHUNK):
            w = Words(b.column(1))
            codes, different = w.coded()
            n_words = np.diff(w.doc)

            def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
                before = np.append(0, np.cumsum(flags))
                return before[at[1:]] - before[at[:-1]]

            lead = (w.data & 0xC0) != 0x80
            upper = (w.data >= 65) & (w.data <= 90)
            letter = upper | (w.data >= 97) & (w.data <= 122) | (w.data >= 0xC3) & lead
            stop = np.fromiter((x.lower() in STOPS for x in different), bool, len(different))
            long_ = np.fromiter((len(x) > 25 for x in different), bool, len(different))
            lines = np.array([_dup_lines(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, 2)
            cols = {
                "n_words": n_words,
                "word_chars": per_text(lead & w.ink, w.text),
                "n_symbols": per_text(SYMBOLS[w.data], w.text),
                "n_dup_lines": lines[:, 0],
                "n_repeat_words": per_text(_repeated(codes, w.doc), w.doc),
                "n_lines": lines[:, 1],
                "n_upper": per_text(upper, w.text),
                "n_letters": per_text(letter, w.text),
                "n_long": per_text(long_[codes], w.doc),
                "n_stops": per_text(stop[codes], w.doc),
            }
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    return arrow_map(pick(docs), run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains. A rule speaks where its figure is telling, and only there: that a
    text is free of one fault says little, so most rules know only bad."""
    c = F.col
    words, letters = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_letters"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    mean, never = c("word_chars") / words, F.lit(False)
    return {
        "symbols": vote(c("n_symbols") / words > 0.12, never),
        "capitals": vote((c("n_upper") / letters > 0.5) & (c("n_letters") >= 40), never),
        "repeats": vote(c("n_repeat_words") / words > 0.12, never),
        "lines": vote((c("n_dup_lines") >= 3) & (c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)) > 0.3), never),
        "length": vote(c("n_words") < 10, never),
        "word_size": vote((mean < 2.5) | (mean > 14), (mean >= 3.5) & (mean <= 10)),
        "long_words": vote(c("n_long") / words > 0.05, never),
        "prose": vote((c("n_stops") / words < 0.02) & (c("n_words") >= 30), c("n_stops") / words > 0.15),
    }


@dataclass
class VoteModel:
    """Prior and per-rule rates P(vote | class), classes bad and good."""

    prior: float = 0.5
    rates: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3)))
    names: tuple[str, ...] = ()

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) of rows of votes."""
        z = np.log([1 - self.prior, self.prior]) + np.zeros((len(votes), 2))
        for k in range(votes.shape[1]):
            z += np.log(self.rates[k][:, votes[:, k] + 1]).T
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p[:, 1] / p.sum(axis=1)


def fit(votes: np.ndarray, counts: np.ndarray, names: tuple[str, ...] = (), rounds: int = 200) -> VoteModel:
    """Expectation-maximisation over the vote patterns of all texts (counts weigh them). Abstaining is a third answer.

    Starts from trust in each rule, and smoothed counts keep every rule better than chance on the whole, so that the
    classes cannot change places.
    """
    if not len(votes):
        return VoteModel(0.5, np.full((votes.shape[1], 2, 3), 1 / 3), names)
    weight = counts / counts.sum()
    bad, good = (votes == -1).sum(axis=1), (votes == 1).sum(axis=1)
    p = (good + 2.0) / (good + 4.0 * bad + 2.5)
    m = VoteModel(names=names)
    smooth = np.array([[4.0, 2.0, 1.0], [0.5, 2.0, 4.0]]) / max(20.0, counts.sum() / 50)
    for _ in range(rounds):
        m.prior = float(np.clip((weight * p).sum(), 0.02, 0.98))
        rates = np.zeros((votes.shape[1], 2, 3))
        for k in range(votes.shape[1]):
            for v in range(3):
                at = votes[:, k] == v - 1
                rates[k, 0, v] = (weight * (1 - p))[at].sum()
                rates[k, 1, v] = (weight * p)[at].sum()
        rates += smooth
        m.rates = rates / rates.sum(axis=2, keepdims=True)
        new = m.posterior(votes)
        done = np.abs(new - p).max() < 1e-7
        p = new
        if done:
            break
    return m


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs (doc_id, text) -> doc_id, COUNTS, base_failed, one vote column per rule, quality (the posterior), kept.

    The counts are written once to the shared folder. All texts' vote patterns (at most three to the number of rules,
    whatever the input) reach the driver for the fit; posteriors go back as one CASE-free join on that bounded table.
    kept is false where base_failed, else quality >= threshold. Texts without words fail; an empty table gives none.
    """
    votes = rules()
    counted = durable(measure(docs), "quality")
    names = tuple(votes)
    voted = counted.select("*", base_failed().alias("base_failed"), *[v.cast("int").alias(f"vote_{k}") for k, v in votes.items()])
    cols = [f"vote_{k}" for k in names]
    pattern = voted.groupBy(cols).count().collect()
    table = np.array([[r[c] for c in cols] for r in pattern], np.int64).reshape(-1, len(cols))
    counts = np.array([r["count"] for r in pattern], float)
    model = fit(table, counts, names)
    good = model.posterior(table) if len(table) else np.zeros(0)
    spark = docs.sparkSession
    rows = [(*map(int, t), float(q)) for t, q in zip(table, good, strict=True)]
    known = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols) + ", quality double")
    out = voted.join(F.broadcast(known), cols)
    return out.select("doc_id", *COUNTS, "base_failed", *cols, "quality", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"))
