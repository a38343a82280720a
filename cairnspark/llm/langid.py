"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

The weights are learned by follow-the-regularised-leader (per-coordinate FTRL-proximal) with L1 and L2
penalties on a bounded sample, and a temperature is fitted on a part of the sample kept back. Document
frequencies cover every row that may be learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_apart, text_slices, unit_hash, with_fields

#: Rows that are learned from, about: of a language, and of all, in equal shares (a Bernoulli sample by a hash of id
#: and text). Every language is learned; of each, so many rows are drawn at least.
TRAIN_PER_LANG, TRAIN_ROWS, LEAST_ROWS = 800, 160_000, 40
BUCKETS = 1 << 14
NO_LANG = "und"
_codes: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point a scattered code of its small letter, 0 if it isn't a letter."""
    global _codes
    if _codes is None:
        small = np.fromiter((ord(c.lower()[0]) if (c := chr(i)).isalpha() else 0 for i in range(0x110000)), np.uint32, 0x110000)
        _codes = small * np.uint32(0x9E3779B1)
    return _codes


def gram_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the buckets of its n-grams (1 to 3 letters, word edges included) and their counts;
    both are empty for a text without letters. All other characters are word edges."""
    codes = _letters()[np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([1, *(len(t) + 1 for t in texts)]) - 1  # the edge before each text
    keep = codes != 0
    keep[1:] |= keep[:-1].copy()  # one edge after a word; further ones add nothing
    keep[0] = True
    keep[ends] = True
    at = np.cumsum(keep)[ends] - 1
    codes = codes[keep]
    two = codes[:-1] * np.uint32(31) + codes[1:]
    three = two[:-1] * np.uint32(33) + codes[2:]
    grams = np.zeros((3, len(codes)), np.int64)
    shift = 32 - BUCKETS.bit_length() + 1
    for row, x in zip(grams, (codes, two, three)):
        row[: len(x)] = (x * np.uint32(0x85EBCA6B)) >> shift
    for s, e in zip(at, at[1:]):
        if not codes[s + 1 : e].any():
            yield np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        n = np.bincount(grams[0, s + 1 : e], minlength=BUCKETS)
        n += np.bincount(grams[1, s:e], minlength=BUCKETS)
        if e - s > 2:
            n += np.bincount(grams[2, s : e - 1], minlength=BUCKETS)
        found = np.flatnonzero(n)
        yield found, n[found]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        return (x / max(np.sqrt(x @ x), 1e-12)) @ self.weights[at] + self.bias

    def predict(self, at: np.ndarray, n: np.ndarray) -> tuple[str, float]:
        if not len(at) or not self.langs:
            return NO_LANG, 0.0
        z = self.logits(at, n) / self.temperature
        p = np.exp(z - z.max())
        return self.langs[int(p.argmax())], float(p.max() / p.sum())


def fit(langs: list[str], idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0005) -> Model:
    """rows: (buckets, counts, index of the language), in a fixed order. Every fifth row is kept back for
    the temperature."""
    k = len(langs)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))  # the last row: the bias

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    def features(at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(c)) * idf[at]
        return np.append(at, BUCKETS), np.append(x / max(np.sqrt(x @ x), 1e-12), 1.0)

    learn = [(*features(at, c), y) for i, (at, c, y) in enumerate(rows) if i % 5 != 4 and len(at)]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(learn)):
            at, x, y = learn[i]
            w = weights(z[at], n[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    model = Model(langs, idf, w[:-1].astype(np.float32), w[-1], 1.0)
    held = [(model.logits(at, c), y) for i, (at, c, y) in enumerate(rows) if i % 5 == 4 and len(at)]
    if held:
        s, y = np.array([a for a, _ in held]), np.array([b for _, b in held])

        def loss(t: float) -> float:
            v = s / t
            v = v - v.max(axis=1, keepdims=True)
            return float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(y)), y]).mean())

        lo, hi = np.log(0.05), np.log(20.0)  # golden-section search
        r = (np.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = hi - r * (hi - lo), lo + r * (hi - lo)
            lo, hi = (lo, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, hi)
        model.temperature = float(np.exp((lo + hi) / 2))
    return model


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG) -> Model:
    """Learn from rows where `usable` holds and text and language are not null. per_lang bounds the sample of a
    language; where languages are many, they share TRAIN_ROWS, but none is left out (the weights, BUCKETS numbers a
    language, are on the driver). Repeated rows are in the sample together or not at all."""
    rows = docs.filter(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for b in text_slices(batches, "t"):
            for at, _ in gram_counts(b.column("t").to_pylist()):
                df[at] += 1
                df[BUCKETS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "df"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "t"):
            found = list(gram_counts(b.column("t").to_pylist()))
            cols = [pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("u"), *cols], names=["lang", "u", "at", "n"])

    df = np.zeros(BUCKETS + 1)
    for r in rows.select("t").mapInArrow(frequencies, "bucket bigint, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    per_lang = min(per_lang, max(LEAST_ROWS, TRAIN_ROWS // max(1, len(langs))))
    shares = docs.sparkSession.createDataFrame([(x, min(1.0, per_lang / n)) for x, n in sizes.items()], "lang string, share double")
    drawn = rows.withColumn("u", unit_hash(F.xxhash64("id", "t"), "langid")).join(F.broadcast(shares), "lang").filter("u < share")
    sample = drawn.select("t", "lang", "u").mapInArrow(grams, "lang string, u double, at array<int>, n array<int>")
    got = sample.orderBy("u", "lang").limit(2 * per_lang * max(1, len(langs))).toArrow()
    index = {x: i for i, x in enumerate(langs)}
    cols = [got.column(c) for c in ("at", "n")]
    return fit(langs, idf, [(np.asarray(a.values, np.int64), np.asarray(c.values, np.int64), index[y]) for a, c, y in zip(*cols, got.column("lang").to_pylist())])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' columns with lang_pred and score of every whole text. Null texts and texts without letters:
    `und`, score 0. A column of docs with one of those names is renamed input_<name>."""
    spark = docs.sparkSession
    docs = kept_apart(docs, ("lang_pred", "score"), text_col)
    schema = with_fields(docs.schema, "lang_pred string, score double")
    shared = spark.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in text_slices(batches, text_col):
            out = [m.predict(at, n) for at, n in gram_counts([t or "" for t in b.column(text_col).to_pylist()])]
            cols = [*b.columns, pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)
