"""Toxic spans by a linear-chain conditional random field.

Token labels come from document labels: a token of a toxic document is toxic if its word, or a prefix of
it, stands in toxic documents of the sample far more often than in clean ones. The chain (one per line,
states clean and toxic) is trained on these by conditional likelihood. Forward-backward marginals give
spans; their noisy-or, calibrated on the sample, gives a document's score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_apart, raw_texts, text_slices, unit_hash, with_fields

#: Labelled rows of a class that are learned from, and the longest text among them, at most.
TRAIN_PER_CLASS, TRAIN_CHARS = 800, 50_000
BUCKETS = 1 << 18
#: A feature marks toxic tokens from this G-statistic and this ratio of document rates on.
LEAST_G, LEAST_RATIO = 20.0, 8.0
#: Marginal from which a token belongs to a reported span.
SPAN_AT = 0.5
_TOKEN = re.compile(r"(?:[A-Za-z]|[^\x00-\x7f])+|\n")
#: ASCII letters in lower case and other non-ASCII bytes are of words; the line break is a token of its own.
_BREAK = b"\x01"
_CLASS = bytes(i if i >= 0x80 or 0x61 <= i <= 0x7A or i == 1 else i + 32 if 0x41 <= i <= 0x5A else 32 for i in range(256))
_CACHE = 400_000
_WIDTH = 6


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words and line breaks: those that _TOKEN finds in the text. Lower-casing makes
    no other character of a letter or a non-ASCII one than such."""
    if not text.isascii():
        text = text.decode().lower().encode()
    return text.replace(_BREAK, b" ").replace(b"\n", b" \x01 ").translate(_CLASS).split()


def _stems(word: bytes) -> list[bytes]:
    """The word and its prefixes: what token labels hang on."""
    return [b"=" + word, *(word[:k] for k in range(3, min(6, len(word) - 1) + 1))]


def _features(word: bytes) -> tuple[int, ...]:
    """Buckets of the word, its first 3 to 6 bytes and its last 3."""
    crc = zlib.crc32
    a = crc(word[:3])
    b = crc(word[3:4], a)
    c = crc(word[4:5], b)
    return crc(word, 77) % BUCKETS, a % BUCKETS, b % BUCKETS, c % BUCKETS, crc(word[5:6], c) % BUCKETS, crc(word[-3:], 99) % BUCKETS


@dataclass
class Chain:
    """weights: per feature bucket; the last stands for no feature. step: log potentials of the moves
    clean-toxic, toxic-clean, toxic-toxic (clean-clean is 0). platt: calibration of the document score."""

    weights: np.ndarray
    bias: float
    step: np.ndarray
    start: float
    platt: tuple[float, float] = (1.0, 0.0)
    cache: dict[bytes, float] = field(default_factory=dict)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in set(words) - self.cache.keys() if w != _BREAK]
        if len(self.cache) > _CACHE:
            self.cache.clear()
            new = [w for w in set(words) if w != _BREAK]
        if new:
            at = np.array([_features(w) for w in new])
            self.cache.update(zip(new, (self.weights[at].sum(axis=1) + self.bias).tolist()))
        self.cache[_BREAK] = -30.0
        return np.fromiter(map(self.cache.__getitem__, words), np.float64, len(words))


def chains(words: list[bytes], doc_ends: np.ndarray) -> np.ndarray:
    """First token of each chain: after a line break or at a document's start."""
    brk = np.fromiter((w == _BREAK for w in words), bool, len(words))
    first = np.zeros(len(words) + 1, bool)
    first[0] = True
    first[1:] |= brk
    first[doc_ends] = True
    return np.flatnonzero(first[:-1])


#: A longer chain is taken in segments of so many tokens.
SEGMENT = 1024


def messages(e: np.ndarray, first: np.ndarray, step: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the token's own potential) and backward messages as log-odds of toxic, all chains at
    once, one position of each at a time. Segments of long chains go side by side: what a segment does to a message
    is a 2x2 matrix, the product of its tokens', and only these matrices are applied one after the other."""
    n = len(e)
    size = np.diff(np.append(first, n))
    x_in, y_in = np.full(len(first), np.nan), np.zeros(len(first))
    if n and size.max() > SEGMENT:
        first, x_in, y_in = _segments(e, first, size, step, start)
        size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    at, size, x_in, y_in = first[order], size[order], x_in[order], y_in[order]
    a01, a10, a11 = np.exp(step)
    x, y = np.empty(n), np.zeros(n)
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1 if n else 1), "right")
    r = np.exp(np.nan_to_num(x_in))
    x[at] = np.where(np.isnan(x_in), e[at] + start, np.clip(e[at] + np.log((a01 + a11 * r) / (1 + a10 * r)), -40, 40))
    for t in range(1, size[0] if n else 0):
        i = at[: live[t]] + t
        r = np.exp(x[i - 1])
        x[i] = np.clip(e[i] + np.log((a01 + a11 * r) / (1 + a10 * r)), -40, 40)
    y[at + size - 1] = y_in
    for t in range((size[0] if n else 0) - 1, 0, -1):
        i = at[: live[t]] + t
        q = np.exp(np.clip(e[i] + y[i], -40, 40))
        y[i - 1] = np.log((a10 + a11 * q) / (1 + a01 * q))
    return x, y


def _segments(e: np.ndarray, first: np.ndarray, size: np.ndarray, step: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First tokens of the segments of all chains, the forward message into each (nan into a chain's first) and the
    backward message at each one's last token."""
    a01, a10, a11 = np.exp(step)
    count = -(-size // SEGMENT)
    chain = np.repeat(np.arange(len(first)), count)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
    at = first[chain] + number * SEGMENT
    length = np.minimum(size[chain] - number * SEGMENT, SEGMENT)
    order = np.argsort(-length, kind="stable")
    live = np.searchsorted(-length[order], -np.arange(1, length.max() + 1), "right")
    p = np.tile(np.eye(2), (len(at), 1, 1))
    for t in range(length.max()):
        own = order[: live[t]]
        odds = np.exp(np.clip(e[at[own] + t], -40, 40))
        clean = p[own, 0] + a10 * p[own, 1]
        toxic = odds[:, None] * (a01 * p[own, 0] + a11 * p[own, 1])
        if t == 0:  # a chain's first token has no move into it
            head = number[own] == 0
            clean[head], toxic[head] = [1.0, 0.0], np.stack([odds[head] * np.exp(start), np.zeros(head.sum())], axis=1)
        new = np.stack([clean, toxic], axis=1)
        p[own] = new / new.max(axis=(1, 2), keepdims=True)
    x_in, y_in = np.full(len(at), np.nan), np.zeros(len(at))
    ahead = np.tile([1.0, 0.0], (len(first), 1))
    back = np.ones((len(first), 2))
    begin = np.cumsum(count) - count
    low, high = np.exp(-40.0), np.exp(40.0)
    for k in range(int(count.max()) - 1):
        c = np.flatnonzero(count > k + 1)
        v = np.einsum("nij,nj->ni", p[begin[c] + k], ahead[c])
        ahead[c] = v / v.max(axis=1, keepdims=True)
        x_in[begin[c] + k + 1] = np.log(np.clip(ahead[c, 1] / np.maximum(ahead[c, 0], 1e-300), low, high))
    for k in range(int(count.max()) - 1, 0, -1):
        c = np.flatnonzero(count > k)
        v = np.einsum("nji,nj->ni", p[begin[c] + k], back[c])
        back[c] = v / v.max(axis=1, keepdims=True)
        y_in[begin[c] + k - 1] = np.log(np.clip(back[c, 1] / np.maximum(back[c, 0], 1e-300), low, high))
    return at, x_in, y_in


def _evidence(p: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """Log-odds that some token is toxic: noisy-or of the marginals over a fifth, or else the largest."""
    out = np.full(len(doc_ends), -20.0)
    s = 0
    for d, e in enumerate(doc_ends):
        if e > s:
            own = p[s:e]
            hot = own[own > 0.2]
            none = -np.log1p(-np.minimum(hot, 1 - 1e-9)).sum() if len(hot) else -np.log1p(-min(own.max(), 1 - 1e-9))
            out[d] = np.clip(np.log(np.expm1(np.clip(none, 1e-9, 30))), -20, 20)
        s = e
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    words: list[bytes] = []
    ends = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        words.extend(tokens(t))
        ends[i] = len(words)
    return words, ends


def token_labels(docs: list[tuple[bytes, int]]) -> set[bytes]:
    """Stems that mark toxic tokens, from texts and labels. Only stems of three toxic texts or more are
    looked for in the clean ones."""
    n = Counter(y for _, y in docs)
    toxic: Counter = Counter()
    for t, y in docs:
        if y:
            toxic.update({s for w in set(tokens(t)) for s in _stems(w)})
    toxic = Counter({s: a for s, a in toxic.items() if a >= 3})
    clean: Counter = Counter()
    for t, y in docs:
        if not y:
            clean.update({s for w in set(tokens(t)) for s in _stems(w) if s in toxic})
    share, marks = n[1] / max(1, n[0] + n[1]), set()
    for s, a in toxic.items():
        c = clean[s]
        if a * n[0] < LEAST_RATIO * (c + 0.5) * n[1]:
            continue
        g = 2 * (a * np.log(a / ((a + c) * share)) + (c * np.log(c / ((a + c) * (1 - share))) if c else 0))
        if g >= LEAST_G:
            marks.add(s)
    return marks


def fit(docs: list[tuple[bytes, int]], rounds: int = 40, rate: float = 0.4, l2: float = 1e-3) -> Chain | None:
    """docs: texts and labels, in a fixed order. None if there is nothing to tell toxic from clean."""
    marks = token_labels(docs)
    vocab: dict[bytes, int] = {_BREAK: 0}
    marked, parts, gold_parts, ends = [False], [], [], []
    seen = set()
    for t, y in docs:  # words as numbers, so that the texts' words aren't held
        words = tokens(t)
        for w in words:
            if w not in vocab:
                vocab[w] = len(vocab)
                marked.append(not marks.isdisjoint(_stems(w)))
        own = np.fromiter(map(vocab.__getitem__, words), np.int32, len(words))
        tag = np.fromiter((y == 1 and marked[i] for i in own), bool, len(own))
        if len(own) and (not y or tag.any()):
            parts.append(own)
            gold_parts.append(tag)
            ends.append(len(own))
            seen.add(y)
    if seen != {0, 1}:
        return None
    ids, gold, ends = np.concatenate(parts), np.concatenate(gold_parts), np.cumsum(ends)
    start_ = np.zeros(len(ids) + 1, bool)
    start_[0] = start_[ends] = True
    start_[1:] |= ids == 0
    first = np.flatnonzero(start_[:-1])
    rest = np.flatnonzero(~start_[:-1])
    # One clean word in five is shown without features, so that the bias learns what an unknown word is.
    blank = [w == _BREAK or (not m and zlib.crc32(w, 5) % 5 == 0) for w, m in zip(vocab, marked)]
    at = np.array([(BUCKETS,) * _WIDTH if x else _features(w) for w, x in zip(vocab, blank)])
    pairs = np.bincount(gold[rest - 1] * 2 + gold[rest], minlength=4)
    theta = np.zeros(BUCKETS + 1 + 5)
    theta[BUCKETS + 1 :] = [-3.0, -1.0, 0.0, 0.0, -1.0]  # bias, steps, start
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        w, bias, step, start = theta[: BUCKETS + 1].copy(), theta[-5], theta[-4:-1], theta[-1]
        w[BUCKETS] = 0
        e = (w[at].sum(axis=1) + bias)[ids]
        x, y = messages(e, first, step, start)
        p = 1 / (1 + np.exp(-np.clip(x + y, -40, 40)))
        err = p - gold
        per_word = np.bincount(ids, weights=err, minlength=len(vocab))
        a, b = np.exp(x[rest - 1]), np.exp(np.clip(e[rest] + y[rest], -40, 40))
        joint = np.stack([np.ones(len(rest)), np.exp(step[0]) * b, np.exp(step[1]) * a, np.exp(step[2]) * a * b])
        expected = (joint / joint.sum(axis=0)).sum(axis=1)
        g = np.empty_like(theta)
        g[: BUCKETS + 1] = np.bincount(at.ravel(), weights=np.repeat(per_word, _WIDTH), minlength=BUCKETS + 1)
        g[-5], g[-4:-1], g[-1] = err.sum(), (expected - pairs)[1:], err[first].sum()
        g = g / len(ends) + l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g  # Adam
        theta -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-6)
    w = theta[: BUCKETS + 1].astype(np.float32)
    w[BUCKETS] = 0
    chain = Chain(w, float(theta[-5]), theta[-4:-1].copy(), float(theta[-1]))
    s = []
    for k in range(0, len(docs), 100):
        own, own_ends = _tokens([t for t, _ in docs[k : k + 100]])
        s.append(_evidence(marginals(chain, own, own_ends), own_ends))
    s = np.column_stack([np.concatenate(s), np.ones(len(docs))])
    y = np.array([y for _, y in docs], float)
    prior, weight = np.array([1.0, 0.0]), np.array([0.5, 0.1])
    a = prior.copy()
    for _ in range(50):  # Newton steps on the penalised log-likelihood
        q = _sigmoid(s @ a)
        h = np.maximum(q * (1 - q), 1e-6)
        move = np.linalg.solve(s.T @ (s * h[:, None]) + np.diag(weight), s.T @ (q - y) + weight * (a - prior))
        a -= move * min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
    chain.platt = tuple(a.tolist())
    chain.cache.clear()
    return chain


def marginals(chain: Chain, words: list[bytes], doc_ends: np.ndarray) -> np.ndarray:
    if not words:
        return np.empty(0)
    x, y = messages(chain.emissions(words), chains(words, doc_ends), chain.step, chain.start)
    return 1 / (1 + np.exp(-np.clip(x + y, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_PER_CLASS) -> Chain | None:
    """Learn from labelled rows where `usable` holds: per_class of each class at most, those with the
    least hash of the id. Rows of `labels` with a null id or label are left out; of several labels of an
    id the largest counts."""
    known = labels.filter(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("u", unit_hash("id", "toxicity"))
    ids = known.filter("y = 1").orderBy("u", "id").limit(per_class).union(known.filter("y = 0").orderBy("u", "id").limit(per_class))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull() & (F.length("t") <= TRAIN_CHARS))
    rows = texts.join(F.broadcast(ids), "id").orderBy("u", "id", "t").limit(2 * per_class).select("t", "y").toArrow()  # ids: 2 * per_class rows at most
    return fit(list(zip(raw_texts(rows.column("t").combine_chunks()), rows.column("y").to_pylist())))


SPANS = "array<struct<start:int,end:int,marginal:double>>"


def score(docs: DataFrame, chain: Chain | None, text_col: str = "text") -> DataFrame:
    """docs' columns with score, predicted (score >= 0.5) and spans (code point offsets of toxic tokens).

    Null and empty texts are scored as texts without words. Without a model all scores are 0. A column of
    docs with one of those names is renamed input_<name>.
    """
    docs = kept_apart(docs, ("score", "predicted", "spans"), text_col)
    schema = with_fields(docs.schema, f"score double, predicted int, spans {SPANS}")
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # weights of BUCKETS features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for b in text_slices(batches, text_col):
            n, found = b.num_rows, [[] for _ in range(b.num_rows)]
            s = np.zeros(n)
            if model:
                texts = raw_texts(b.column(text_col))
                words, ends = _tokens(texts)
                p = marginals(model, words, ends)
                s = _sigmoid(_evidence(p, ends) * model.platt[0] + model.platt[1])
                hot = np.flatnonzero(p >= SPAN_AT)
                for d in np.unique(np.searchsorted(ends, hot, "right")):
                    first = ends[d - 1] if d else 0
                    own = [(m.start(), m.end(), float(q)) for m, q in zip(_TOKEN.finditer(texts[d].decode()), p[first : ends[d]]) if q >= SPAN_AT]
                    found[d] = [{"start": x, "end": y, "marginal": q} for x, y, q in own]
            cols = [*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)
