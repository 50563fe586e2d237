"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import functools
import math
import os
import pickle
import re
import subprocess
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, arrow_map, pick, pick_columns, text_slices

#: At most so many labelled rows, and so many bytes of their texts, teach the lexicon (on the driver).
TRAIN_ROWS, TRAIN_BYTES = 4000, 16 << 20
#: The weight of a seed word of which the labels say nothing, and in how many labelled texts they do say something.
SEED_WEIGHT, SEED_TEXTS = 5.0, 5
#: At most so many lexicon entries.
LEXICON = 1500

# Common insults that the lexicon starts from, as whole words or with a plural s, until labels say otherwise.
SEEDS = "idiot moron stupid loser trash scum worthless pathetic disgusting clown imbecile dumbass asshole bastard bitch".split()
# Harmless phrases that hold a lexicon entry.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "clownfish", "sore loser", "scum line", "pond scum", "idiot proof", "trashed file")
# Blocks of letters that fold to others: Latin-1 to Cyrillic, Latin and Greek additions, letter-like signs,
# numbers and letters in circles, full-width forms, mathematical letters, and letters in squares.
FOLDED_BLOCKS = [(0x80, 0x530), (0x1E00, 0x2000), (0x2100, 0x2190), (0x2460, 0x2500), (0xFF00, 0xFF5F), (0x1D400, 0x1D800), (0x1F100, 0x1F1A0)]
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(
    zip(
        "абвеёзіїјкмнорстухѕԁɡһ" "αβεικνορτυχ" "ıøđł",
        "abbeeziijkmhopctyxsdgh" "abeikvoptux" "iodl",
        strict=True,
    )
)
# Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}


@functools.lru_cache(1)
def _table() -> dict[int, str]:
    """The letters of FOLDED_BLOCKS to lower-case Latin ones where they look alike; others and invisible signs as they
    fold. Letters of Latin alphabets keep their accents, which tell words apart."""
    out = {}
    for i in (i for a, b in FOLDED_BLOCKS for i in range(a, b)):
        c = unicodedata.normalize("NFKC", chr(i)).lower()
        if 0x1F130 <= i < 0x1F18A:  # black squares and circles have no folding of their own
            c = chr(ord("a") + (i - 0x1F130) % 32) if (i - 0x1F130) % 32 < 26 else c
        if not ("LATIN" in unicodedata.name(chr(i), "") and i < 0x250):
            c = "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        out[i] = c
    out |= {i: "" for i in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    return out


#: What the table changes, and more: ASCII and the small letters of Latin-1 stay as they are.
FOLDED = re.compile("[^\x00-\x7f\xdf-\xff]")
INSIDE = re.compile(r"[013457@$!|]+(?=[^\W\d_])")
APART = re.compile(r"[\W_]+")
#: ASCII signs to spaces.
SIGNS = {i: " " for i in range(128) if not chr(i).isalnum()}


def _plain(m: re.Match) -> str:
    """Letters for digits and signs after a letter, and for digits and @ or $ at a word's start."""
    before = m.string[m.start() - 1 : m.start()]
    if before.isalpha() or not (before.isalnum() or before == "_" or "!" in m[0] or "|" in m[0]):
        return "".join(SUBSTITUTES[c] for c in m[0])
    return m[0]


def fold(text: str) -> str:
    """A text's words in lower case, parted by one space, one at each end: plain letters for homoglyphs and invisible
    signs gone, and letters for digits and signs inside words."""
    text = text.lower()
    if not text.isascii() and FOLDED.search(text):
        text = text.translate(_table())
    text = INSIDE.sub(_plain, text)
    text = " ".join(text.translate(SIGNS).split()) if text.isascii() else APART.sub(" ", text).strip()
    return f" {text} "


def grams(word: str, low: int = 4, high: int = 10) -> set[str]:
    """The terms that a word may teach: itself with the spaces beside it, and its beginnings of `low` to `high` letters
    with the space before it. No term starts inside a word, so that "closer" is no "loser"."""
    out = {f" {word} "} if len(word) <= 24 else set()
    out.update(f" {word[:n]}" for n in range(low, min(high, len(word)) + 1))
    return out


def seed_terms() -> list[str]:
    """The seeds with the spaces beside them, and their plurals."""
    return [x for w in SEEDS for x in (f" {w} ", f" {w}{'es' if w.endswith(('s', 'sh', 'ch')) else 's'} ")]


def seeds_weighed(texts: list[str], labels: np.ndarray) -> dict[str, float]:
    """Seed terms by their log odds where labelled texts hold them often enough, else by SEED_WEIGHT; those that speak
    for the other side are left out."""
    n_pos, n_neg = labels.sum(), (1 - labels).sum()
    folded = [fold(t) for t in texts]
    out = {}
    for w in seed_terms():
        held = np.array([w in t for t in folded], bool)
        a, b = labels[held].sum(), (1 - labels[held]).sum()
        odds = math.log((a + 0.5) / (n_pos - a + 0.5)) - math.log((b + 0.5) / (n_neg - b + 0.5))
        weight = min(odds, 8.0) if a + b >= SEED_TEXTS else SEED_WEIGHT
        if weight > 0:
            out[w] = weight
    return out


class Model:
    """Lexicon weights and the calibration of a text's length-normalised sums; plain data, a bounded size."""

    def __init__(self, weights: dict[str, float], coef: list[float], centre: list[float], scale: list[float]):
        self.weights, self.coef, self.centre, self.scale = weights, coef, centre, scale

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.coef[1:]) + self.coef[0], -30, 30)))


@functools.lru_cache(8)
def _automaton(terms: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t, w in terms:
        a.add_word(t, (len(t), w))
    for t in exceptions:
        a.add_word(fold(t), (len(fold(t)), None))
    a.make_automaton()
    return a


class Matcher:
    """The automaton of all terms, and one of the seed terms for text whose accents are only a disguise."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.all = _automaton(tuple(sorted(weights.items())), exceptions)
        self.seeds = _automaton(tuple(sorted((w, weights[w]) for w in seed_terms() if w in weights)), exceptions)

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        folded = fold(text)
        out = hits(folded, self.all)
        if not out and len(self.seeds) and not folded.isascii():
            out = hits(unicodedata.normalize("NFKD", folded).encode("ascii", "ignore").decode(), self.seeds)
        return out


def hits(folded: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the lexicon's hits, one for each stretch of overlapping ones: its heaviest.

    A hit that an exception phrase covers does not count.
    """
    found, spared = [], []
    for end, (n, w) in automaton.iter(folded):
        (spared if w is None else found).append((end + 1 - n, end + 1, w))
    if spared:
        found = [x for x in found if not any(a <= x[0] and x[1] <= b for a, b, _ in spared)]
    found.sort()
    out: list[tuple[int, int, float]] = []
    for a, b, w in found:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(w, out[-1][2]))
        else:
            out.append((a, b, w))
    return out


def features(text: str, matcher: Matcher) -> tuple[float, float, float, float]:
    """Weight per word (square root), heaviest hit, and the logarithms of the numbers of hits and of words."""
    found = matcher.hits(text)
    words = len(text.split())
    if not found:
        return 0.0, 0.0, 0.0, math.log1p(words)
    return math.sqrt(sum(x[2] for x in found) / max(1, words)), max(x[2] for x in found), math.log1p(len(found)), math.log1p(words)


class Held:
    """Which candidate terms each labelled text holds, as arrays of term numbers; only terms of several toxic texts.

    Words are looked at once each. Hashed counts are taken first, so that terms of one or two texts (nearly all) never
    take memory.
    """

    def __init__(self, texts: list[str], labels: np.ndarray, least: int):
        mask = (1 << 22) - 1
        number: dict[str, int] = {}
        rows: list[np.ndarray] = []  # each text's different words, by number
        for t in texts:
            rows.append(np.array(sorted({number.setdefault(w, len(number)) for w in fold(t).split()}), np.int32))
        words = list(number)
        del number
        toxic = [r for r, y in zip(rows, labels, strict=True) if y]
        none = np.zeros(0, np.int32)
        seen = np.zeros(mask + 1, np.int32)
        of_toxic = np.unique(np.concatenate([none, *toxic])).tolist()
        hashed = {k: np.fromiter((hash(g) & mask for g in grams(words[k])), np.int32) for k in of_toxic}
        for r in toxic:
            seen[np.unique(np.concatenate([none, *(hashed[k] for k in r.tolist())]))] += 1
        del hashed
        counts: Counter[str] = Counter()
        pool: dict[str, str] = {}  # one string for each term, however many words hold it
        often = {k: found for k in of_toxic if (found := [pool.setdefault(g, g) for g in grams(words[k]) if seen[hash(g) & mask] >= least])}
        for r in toxic:
            counts.update({g for k in r.tolist() for g in often.get(k, ())})
        del often, seen, pool
        self.terms = sorted(g for g, n in counts.items() if n >= least)
        at = {g: i for i, g in enumerate(self.terms)}
        known = {k: np.array(found, np.int32) for k, w in enumerate(words) if (found := [at[g] for g in grams(w) if g in at])}
        self.rows = [np.unique(np.concatenate([none, *(known[k] for k in r.tolist() if k in known)])) for r in rows]


def _lexicon(held: Held, labels: np.ndarray, at: np.ndarray) -> dict[str, float]:
    """Terms by the weight (log odds) with which those of the texts `at` that hold them are labelled toxic.

    Of many candidates only those stay whose log odds are several standard errors above nothing; of nested terms
    found in the same toxic texts the more telling one, so that inflected forms not seen in training match too.
    """
    y, n = labels[at], len(held.terms)
    rows = [held.rows[i] for i in at]
    none = np.zeros(0, np.int32)
    a = np.bincount(np.concatenate([none, *(r for r, t in zip(rows, y, strict=True) if t)]), minlength=n)[:n]
    b = np.bincount(np.concatenate([none, *(r for r, t in zip(rows, y, strict=True) if not t)]), minlength=n)[:n]
    n_pos, n_neg = y.sum(), (1 - y).sum()
    odds = np.log((a + 0.5) / (n_pos - a + 0.5)) - np.log((b + 0.5) / (n_neg - b + 0.5))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (n_pos - a + 0.5) + 1 / (b + 0.5) + 1 / (n_neg - b + 0.5))
    good = np.flatnonzero((a >= max(3, n_pos // 100)) & (z > 4) & (odds > 2.2) & (a > b))
    best = sorted(good.tolist(), key=lambda k: (-z[k], -len(held.terms[k]), held.terms[k]))[: 4 * LEXICON]
    where: dict[int, set[int]] = {k: set() for k in best}
    for i, (r, t) in enumerate(zip(rows, y, strict=True)):
        if t:
            for k in r[np.isin(r, best)].tolist():
                where[k].add(i)
    out: dict[str, tuple[float, set[int]]] = {}
    for k in best:
        g, own = held.terms[k], where[k]
        if not any((h in g or g in h) and len(own - other) <= len(own) // 10 for h, (_, other) in out.items()):
            out[g] = (min(float(odds[k]), 8.0), own)
        if len(out) >= LEXICON:
            break
    return {g: w for g, (w, _) in out.items()}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Newton's method for ridge logistic regression; the first coefficient is the constant."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (y - p) - ridge * np.append(0, b[1:])
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b.tolist()


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The model of labelled texts. The calibration comes from lexicons of the other folds, so that it does not
    trust terms only because they were picked on the same texts. Without enough of both labels: seed terms alone."""
    y = np.array(toxic, float)
    if y.sum() < 4 or (1 - y).sum() < 4:
        return Model(dict.fromkeys(seed_terms(), SEED_WEIGHT), [-2.0, 1.0, 1.0, 1.0, 0.0], [0.3, 2.5, 0.5, 5.0], [0.3, 2.5, 0.5, 1.0])
    held = Held(texts, y, max(2, int(y.sum()) // 150))
    folds = np.arange(len(y)) % 3
    x = np.zeros((len(y), 4))
    for k in range(3):
        at = np.flatnonzero(folds != k)
        m = Matcher(seeds_weighed([texts[i] for i in at], y[at]) | _lexicon(held, y, at))
        for i in np.flatnonzero(folds == k):
            x[i] = features(texts[i], m)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    coef = _logistic((x - centre) / scale, y)
    return Model(seeds_weighed(texts, y) | _lexicon(held, y, np.arange(len(y))), coef, centre.tolist(), scale.tolist())


def fit_apart(texts: list[str], toxic: list[int]) -> Model:
    """fit in a process of its own, whose memory is given back when it ends; the driver keeps only the model."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
    code = "import pickle, sys; from brindle.llm.toxicity import fit; pickle.dump(fit(*pickle.load(sys.stdin.buffer)), sys.stdout.buffer)"
    done = subprocess.run([sys.executable, "-c", code], input=pickle.dumps((texts, toxic)), stdout=subprocess.PIPE, env=env, check=True)
    return pickle.loads(done.stdout)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample of the labelled rows outside the held-out fifth, in a hash order of doc_id.

    Only ids and labels of at most `rows` rows, then texts of at most `size` bytes together, reach the driver; a text that
    no longer fits is passed over. A doc_id that several labels name is toxic if one says so; null ids and null labels
    teach nothing.
    """
    in_train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    known = labels.where(in_train & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    spark = docs.sparkSession
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    if not chosen:
        return [], []
    label = {r.doc_id: r.toxic for r in chosen}

    def of(ids: list[int]) -> DataFrame:  # at most `rows` ids: a broadcast of some ten kilobytes
        wanted = spark.createDataFrame([(i,) for i in ids], "wanted long")
        return pick(docs).join(F.broadcast(wanted), F.col("doc_id") == F.col("wanted"))

    # of rows that share a doc_id one text is taken, the same in every run
    one = of(list(label)).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))).alias("r"))
    found = {r.doc_id: (r.r.h, r.r.n) for r in one.collect()}
    ids, left = [], size
    for r in chosen:
        if r.doc_id in found and found[r.doc_id][1] < left:
            ids.append(r.doc_id)
            left -= found[r.doc_id][1]
    if not ids:
        return [], []
    got: dict[int, str] = {}
    wanted = spark.createDataFrame([(i, found[i][0]) for i in ids], "wanted long, h long")
    texts = pick(docs).join(F.broadcast(wanted), (F.col("doc_id") == F.col("wanted")) & (F.xxhash64("text") == F.col("h")))
    for r in texts.select("doc_id", "text").dropDuplicates(["doc_id"]).collect():
        got[r.doc_id] = r.text
    ids = sorted(got)
    return [got[i] for i in ids], [label[i] for i in ids]


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score in 0 .. 1, hits; with `keep`, those columns of docs instead of doc_id.

    Whole texts, one pass, no shuffle; the model is bounded. A null or empty text has no hit and a low score; repeated
    rows stay; columns besides are never looked at; an empty table gives none.
    """
    base = docs.select(*[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep], *pick_columns())
    names = [f"keep_{c}" for c in keep] or ["doc_id"]

    def run(batches):
        matcher = Matcher(model.weights)
        for b in text_slices(batches, limit=CHUNK_BYTES):
            x = np.array([features(t, matcher) for t in b.column(b.schema.get_field_index("text")).to_pylist()]).reshape(-1, 4)
            n = np.rint(np.expm1(x[:, 2])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(model.score(x)), pa.array(n)], names=[*names, "score", "hits"])

    schema = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in names) + ", score double, hits long"
    out = arrow_map(base, run, schema)
    return out.select(*[F.col(f"`keep_{c}`").alias(c) for c in keep], *([] if keep else ["doc_id"]), "score", "hits")
