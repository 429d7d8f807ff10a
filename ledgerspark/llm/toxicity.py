"""Toxicity by noisy-channel deobfuscation.

A character trigram model counts every document. A token that mixes letters with look-alike digits and signs,
repeats a letter more than twice or sets its letters apart is read as a lattice: each look-alike may stand for its letters, a
repeat for one or two letters, a sign between letters for nothing, and in a run of
single characters a word may end behind each. Viterbi decoding under the character model
gives the likeliest words. The restored text (its words and their beginnings) is scored by a logistic model.

The model is fitted to a sample of at most SAMPLE labelled rows (those of the least hash), a bound of the fit alone; all
their features that bear out label 1 beyond chance are kept. Counts of the character model and all scores cover
all documents and whole texts. A lattice keeps two ways into a state and gives PATHS readings: all of them count.

Defined results: null and empty texts are scored by the model's intercept; rows without a label are scored like
others; repeated rows each; without training rows of both labels the score is the share of label 1 (0 without any); a
doc_id that is labelled twice counts with its larger label; columns already named score or predicted are replaced, others kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read, small_batches

#: Labelled rows that the fit looks at, at most; FOLDS-th part of the ids is held out.
SAMPLE, FOLDS = 20_000, 5
THRESHOLD = 0.5
#: Features that stand in where the labelled texts are too few for any to be sure.
FALLBACK = 50
#: Letters that a sign or digit may stand for, the likeliest first.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "#": "h", "%": "x", "&": "a",
}
APART = ".-_*~'’`/\\,:;^=·"
OUTER = APART + "!?\"()[]{}<>«»„“”…|#$%&+@"
#: Letters of the character model: a border, a to z, any other letter.
BORDER, OTHER, SYMBOLS = 0, 27, 28
#: Log-probabilities of the channel: a letter as it is, a look-alike's first, second reading, a sign or repeat left out.
ITSELF, FIRST, SECOND, DROPPED = 0.0, -0.7, -1.6, -9.0
PATHS = 6
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
REPEAT = re.compile(r"(.)\1\1")
MEMORY = 300_000


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """The model's symbol of each code point below 0x250."""
    table = np.zeros(0x250, np.int64)
    for code in range(0x250):
        base = unicodedata.normalize("NFKD", chr(code).lower())[:1]
        table[code] = ord(base) - 96 if "a" <= base <= "z" else OTHER if chr(code).isalpha() else BORDER
    return table


@lru_cache(maxsize=4096)
def _symbol(letter: str) -> int:
    return int(_symbols()[ord(letter)]) if ord(letter) < 0x250 else OTHER


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 0x250, _symbols()[np.minimum(codes, 0x24F)], OTHER)


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all texts, as an array of SYMBOLS ** 3."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for words in batch.column(0).to_pylist():
                if words:
                    s = symbols(f"  {words} ")
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        there = np.flatnonzero(total)
        yield pa.record_batch({"gram": there, "n": total[there]})

    rows = docs.select(F.col(f"`{text}`")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3)
    for gram, n in rows.collect():  # a row for each trigram of 28 symbols at most
        counts[gram] = n
    return counts


class CharacterModel:
    """Interpolated log-probabilities of a symbol after two others."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        part = lambda x: (x + 0.1) / (x.sum(axis=-1, keepdims=True) + 0.1 * SYMBOLS)
        self.table = np.log(0.7 * part(three) + 0.25 * part(two)[None] + 0.05 * part(one)[None, None]).tolist()

    def __call__(self, a: int, b: int, c: int) -> float:
        return self.table[a][b][c]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """The readings (letters, log-probability) of each run of equal characters."""
    places = []
    for run in re.finditer(r"(.)\1*", token, re.S):
        c, n = run[1], len(run[0])
        if c.isalpha():
            letters = [(c, ITSELF)]
        elif c in LOOK_ALIKES:
            letters = [(x, FIRST if i == 0 else SECOND) for i, x in enumerate(LOOK_ALIKES[c])]
        else:
            letters = []
        readings = [] if letters and c.isalpha() else [("", 0.0 if c in APART else DROPPED)]
        for x, p in letters:
            readings.append((x, p + (0.0 if n != 2 else DROPPED if c.isalpha() else FIRST)))
            if n > 1:
                readings.append((x + x, p + (FIRST if n > 2 else 0.0)))
        places.append(readings)
    return places


def _spelt(path: tuple | None) -> str:
    """The letters of a path, which holds its last ones and the path before them."""
    letters = []
    while path:
        path, last = path
        letters.append(last)
    return "".join(reversed(letters))


def _score(path: tuple[float, tuple | None]) -> float:
    return path[0]


def decode(token: str, model: CharacterModel, paths: int = PATHS, borders: bool = False) -> list[str]:
    """The likeliest words behind a token, the best first: Viterbi over the lattice with two letters as state.

    With borders a word may end behind each letter: the token is a run whose letters were all set apart.
    """
    table = model.table
    states: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {(BORDER, BORDER): [(0.0, None)]}
    for readings in lattice(token):
        if borders:
            readings = readings + [(letters + " ", channel) for letters, channel in readings if letters]
        spelt = [(letters, channel, [_symbol(c) for c in letters]) for letters, channel in readings]
        reached: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {}
        for (a, b), best in states.items():
            for letters, channel, signs in spelt:
                x, y, gain = a, b, channel
                for s in signs:
                    gain += table[x][y][s]
                    x, y = y, s
                new = [(score + gain, (word, letters) if letters else word) for score, word in best]
                if (x, y) in reached:
                    reached[x, y] = sorted(reached[x, y] + new, key=_score, reverse=True)[:2]
                else:
                    reached[x, y] = new
        states = reached
    # behind a border that closes the last word nothing more is to be paid
    ends = [(score + (0.0 if borders and b == BORDER else table[a][b][BORDER]), word) for (a, b), best in states.items() for score, word in best if word]
    return list(dict.fromkeys(_spelt(word).rstrip() for _, word in sorted(ends, key=_score, reverse=True)[: 4 * paths]))[:paths]


def suspicious(token: str) -> bool:
    """Whether a token without outer signs may hide a word."""
    if token.isalpha():
        return REPEAT.search(token) is not None
    if len(token) < 3:
        return False
    letters = sum(map(str.isalpha, token))
    return letters > 0 and 3 * letters >= len(token) - sum(map(token.count, APART))


def shapes(raw: str) -> list[str]:
    """A token without its outer signs, and with a single look-alike at either end, which may be a letter of it."""
    core = raw.strip(OUTER)
    at = raw.find(core) if core else 0
    before, after = raw[:at].lstrip(APART), raw[at + len(core) :].rstrip(APART)
    first, last = before if before in LOOK_ALIKES else "", after if after in LOOK_ALIKES else ""
    return [core, first + core + last] if core and (first or last) else [core]


def _named(word: str) -> list[str]:
    return [f"w:{word}", *(f"p{n}:{word[:n]}" for n in (4, 5) if len(word) > n)]


class Reader:
    """Features of restored texts; remembers those of each token."""

    def __init__(self, model: CharacterModel, known: dict[str, int] | None = None):
        self.model, self.known, self.seen = model, known, {}

    def token(self, raw: str, spaced: bool = False) -> tuple:
        words = set()
        for shape in shapes(raw):
            words.add(shape)
            if suspicious(shape):
                words.update(decode(shape, self.model))
            if spaced and any(map(str.isalpha, shape)):
                words.update(word for words_ in decode(shape, self.model, borders=True) for word in words_.split())
        names = {name for word in words if word for name in _named(word)}
        if self.known is None:
            return tuple(names)
        return tuple(self.known[n] for n in names if n in self.known)

    def __call__(self, text: str | None) -> set:
        if not text:
            return set()
        if len(self.seen) > MEMORY:
            self.seen.clear()
        text, found, seen = text.lower(), set(), self.seen
        tokens = set(text.split())
        tokens.update(m[0].replace(" ", "").replace("\t", "") + " " for m in SPACED.finditer(text))
        for raw in tokens:
            names = seen.get(raw)
            if names is None:
                names = self.token(raw.strip(), raw[-1] == " ")
                if len(raw) <= 64:
                    seen[raw] = names
            if names:
                found.update(names)
        return found


def restore(text: str | None, model: CharacterModel) -> str:
    """The text with its suspicious tokens read as their likeliest words."""

    def word(raw: str) -> str:
        hidden = [s for s in shapes(raw.lower()) if suspicious(s)]
        best = decode(hidden[-1], model, 1) if hidden else None
        return best[0] if best else raw

    joined = SPACED.sub(lambda m: re.sub(r"[ \t]", "", m[0]), text or "")
    return "".join(p if p.isspace() else word(p) for p in re.split(r"(\s+)", joined) if p)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled rows outside the held-out part."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    # at most `sample` rows of two numbers, written and thereby of known size
    chosen = materialize(chosen, "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    # copies of a text count once, or their own words would stand for their label
    once = rows.select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("text").alias("mark")).dropDuplicates(["mark", "toxic"]).drop("mark")
    return materialize(once, "training")


def candidate_features(rows: DataFrame, model: CharacterModel) -> list[str]:
    """The features of the sample with more evidence for label 1 than chance gives."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = Reader(model), (Counter(), Counter())
        docs = [0, 0]

        def flush() -> pa.RecordBatch:
            names = list(held[0] | held[1])
            batch = pa.record_batch({"feature": pa.array([*names, ""], pa.string()), "clean": pa.array([*(held[0][n] for n in names), docs[0]], pa.int64()), "toxic": pa.array([*(held[1][n] for n in names), docs[1]], pa.int64())})
            held[0].clear()
            held[1].clear()
            docs[:] = 0, 0
            return batch

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                held[int(toxic == 1)].update(reader(text))
                docs[int(toxic == 1)] += 1
            if len(held[0]) + len(held[1]) > MEMORY:
                yield flush()
        yield flush()

    counted = materialize(rows.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "features")
    total = counted.where("feature = ''").first()
    if total is None or not total.clean or not total.toxic:
        return []
    prior = total.toxic / (total.toxic + total.clean)
    seen = F.col("toxic") + F.col("clean")
    against = F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / seen / (1 - prior))).otherwise(F.lit(0.0))
    evidence = 2 * (F.col("toxic") * F.log(F.col("toxic") / seen / prior) + against)
    # what chance alone gives few of all features
    least = 1.5 * math.log(max(2, counted.count()))
    over = counted.where((F.col("feature") != "") & (F.col("toxic") > 0)).where(F.col("toxic") / seen > prior)
    ranked = over.select("feature", evidence.alias("evidence")).orderBy(F.col("evidence").desc(), "feature")
    strong = [r.feature for r in ranked.where(F.col("evidence") > least).collect()]
    # few texts bear out nothing beyond chance; the best there is still tells more than the labels' share
    return strong or [r.feature for r in ranked.limit(FALLBACK).collect()]


def fit(rows: DataFrame, model: CharacterModel, sample: int = SAMPLE) -> tuple[dict[str, int], np.ndarray, float]:
    """Features by name, their weights and the intercept."""
    names = candidate_features(rows, model)
    known = {n: i for i, n in enumerate(names)}
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((model, known))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.record_batch({"mark": pa.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), "toxic": batch.column("toxic").cast(pa.int32()), "found": pa.array([sorted(reader(t)) for t in texts], pa.list_(pa.int32()))})

    # exact copies count once; at most `sample` rows of numbers
    found = rows.mapInArrow(hits, "mark long, toxic int, found array<int>").dropDuplicates(["mark", "toxic"]).orderBy("mark", "toxic").limit(sample).collect()
    y = np.array([float(r.toxic == 1) for r in found])
    if not names or not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return {}, np.zeros(0), math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    doc = np.repeat(np.arange(len(found)), [len(r.found) for r in found])
    feature = np.fromiter((f for r in found for f in r.found), np.int64, len(doc))
    weight, bias = logistic(doc, feature, y, len(names))
    return known, weight, bias + shift(bias + np.bincount(doc, weight[feature], len(y)), y)


def shift(score: np.ndarray, y: np.ndarray, part: float = 0.3) -> float:
    """Moves the border of well-parted labels towards label 0: one sign suffices where training texts show several."""
    low, high = np.quantile(score[y == 0], 0.998), np.quantile(score[y == 1], 0.05)
    return float(-(low + part * (high - low))) if low < high else 0.0


def logistic(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, n: int, penalty: float = 0.1, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic regression on sparse binary features, by Adagrad."""
    weight, bias = np.zeros(n), math.log(y.mean() / (1 - y.mean()))
    scale, bias_scale = np.full(n, 1e-6), 1e-6
    for _ in range(steps):
        score = bias + np.bincount(doc, weight[feature], len(y))
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        slope = np.bincount(feature, error[doc], n) + penalty * weight
        scale += slope**2
        weight -= 0.5 * slope / np.sqrt(scale)
        bias_scale += error.sum() ** 2
        bias -= 0.5 * error.sum() / math.sqrt(bias_scale)
    return weight, float(bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with score, from 0 to 1, and predicted."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    model = CharacterModel(trigram_counts(docs))
    known, weights, bias = fit(training_rows(docs, labels, sample), model, sample)
    used = [(name, i) for name, i in known.items() if abs(weights[i]) > 0.02]
    shared = spark.sparkContext.broadcast((model, {n: k for k, (n, _) in enumerate(used)}, weights[[i for _, i in used]] if used else np.zeros(0), bias))

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, known, weights, bias = shared.value
        reader = Reader(model, known)
        for texts in batches:
            total = [bias + math.fsum(weights[i] for i in reader(t)) for t in texts]
            yield pd.Series([1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in total], dtype="float64")

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, score(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
