"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Words of a document that begin a shingle of some item are found by hash, with the items that have it; where the
shingles of an item weigh enough for it, every window as long as the item gets a fingerprint, from running sums of its
shingles' votes. Pairs of windows and items within RADIUS are found by multi-index Hamming blocks, without loss, and
decided by their exact weighted similarity. What may be lost is a window of little more than SIMILARITY whose
fingerprint lies beyond the radius.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, raw_texts, text_slices, with_fields

WIDTH, SIMILARITY = 5, 0.8
#: Bits of a fingerprint and the radius. Bags of 0.8 weighted similarity have a cosine of about 0.89, so a bit differs
#: by a chance of 0.15, and of 64 bits more than 18 by about 0.001.
BITS, RADIUS = 64, 18
#: Characters of benchmark text that one pass over the documents takes; a larger benchmark takes more passes.
PASS_CHARS = 8_000_000
_CLASS = bytes(i if i >= 0x80 or 0x61 <= i <= 0x7A or 0x30 <= i <= 0x39 else i + 32 if 0x41 <= i <= 0x5A else 32 for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, lower-cased."""
    if not text.isascii():
        text = text.decode().lower().encode()
    return text.translate(_CLASS).split()


def shingles(words: list[bytes], width: int = WIDTH) -> list[bytes]:
    """Of `width` words, or of all words if there are fewer."""
    k = min(width, len(words))
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if k else []


def similarity(a: list[bytes], b: list[bytes], weight: dict[bytes, float], other: float) -> float:
    """Weighted Jaccard of two bags of shingles, a window's and an item's. `other` is the weight of shingles that
    the item lacks, so a similarity does not depend on which other items are looked for beside it."""
    x, y = Counter(a), Counter(b)
    both = all_ = 0.0
    for s in x.keys() | y.keys():
        w = weight.get(s, other) if s in y else other
        both += w * min(x[s], y[s])
        all_ += w * max(x[s], y[s])
    return both / all_ if all_ else 0.0


def _digest(shingle: bytes) -> int:
    """The same in every process."""
    h = xxhash.xxh64_intdigest(shingle, 42)
    return h - (1 << 64) if h >> 63 else h


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def _roll(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _votes(words: list[bytes], k: int, weight: np.ndarray) -> np.ndarray:
    """Of each shingle of k words its vote on each bit: the root of its weight, as a whole number, for or against. The
    cosine of two sums of such votes is that of weighted bags."""
    h = _roll(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), k)  # the same in every process
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    return (2 * bits - 1) * np.rint(np.sqrt(weight) * 65536).astype(np.int64)[:, None]


def _packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit is set where the votes for it outweigh those against."""
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel() if len(sums) else np.empty(0, np.uint64)


def near(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of fingerprints within the radius, as places in a and b, and their distance.

    The bits are cut into radius + 1 blocks; a pair within the radius agrees in one block at least, so pairs that
    agree in a block, found by sorting, are all that need a look."""
    found = []
    cuts = [BITS * j // (radius + 1) for j in range(radius + 2)]
    for low, high in zip(cuts, cuts[1:]):
        mask = np.uint64((1 << (high - low)) - 1)
        x, y = (a >> np.uint64(low)) & mask, (b >> np.uint64(low)) & mask
        order = np.argsort(y, kind="stable")
        first, last = np.searchsorted(y[order], x), np.searchsorted(y[order], x, "right")
        m = last - first
        left = np.repeat(np.arange(len(a)), m)
        right = order[np.repeat(first - np.cumsum(m) + m, m) + np.arange(m.sum())]
        d = np.bitwise_count(a[left] ^ b[right])
        close = d <= radius
        found.append(np.stack([left[close], right[close], d[close].astype(np.int64)]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[0], pairs[1], pairs[2]


@dataclass
class Items:
    """The items of a pass, indexed. weight: of each shingle, the rarer among all items of the benchmark the larger.
    shared: in how many items of the benchmark a shingle is, by digest, if in several; total_items: how many have
    words. Without them the given items are the benchmark."""

    ids: list
    words: list[list[bytes]]
    shared: dict[int, int] | None = None
    total_items: int | None = None

    def __post_init__(self) -> None:
        keep = [i for i, w in enumerate(self.words) if w]
        self.ids, self.words = [self.ids[i] for i in keep], [self.words[i] for i in keep]
        self.bags = [shingles(w) for w in self.words]
        if self.shared is None:
            df = Counter(s for bag in self.bags for s in set(bag))
        else:
            df = {s: self.shared.get(_digest(s), 1) for bag in self.bags for s in bag}
        total = len(self.bags) if self.total_items is None else self.total_items
        self.other = float(np.log(1 + total))
        self.weight = {s: float(np.log(1 + total / n)) for s, n in df.items()}
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.longest = int(lengths.max()) if len(lengths) else 0
        self.total = np.array([sum(self.weight[x] for x in bag) for bag in self.bags])
        #: By shingle width: distinct hashes of the items' shingles, a table of those hashes' first bits, weights
        #: of the shingles, and for each hash from begin[h] to begin[h + 1] the items that have it and how often.
        #: Python's hash differs from one process to another, so this is made in each worker.
        self.known: dict[int, tuple[np.ndarray, ...]] = {}
        for k in sorted({min(WIDTH, n) for n in lengths.tolist()}):
            own = [i for i, w in enumerate(self.words) if min(WIDTH, len(w)) == k]
            every = np.concatenate([_roll(_hashes(self.words[i]), k) for i in own])
            item = np.repeat(own, [len(self.bags[i]) for i in own])
            h, number = np.unique(every, return_inverse=True)
            weight = np.zeros(len(h))
            weight[number] = [self.weight[x] for i in own for x in self.bags[i]]
            pairs, times = np.unique(np.stack([number, item]), axis=1, return_counts=True)
            table = np.zeros(1 << 20, bool)
            table[h >> np.uint64(44)] = True
            self.known[k] = (h, table, weight, np.searchsorted(pairs[0], np.arange(len(h) + 1)), pairs[1], times)
        #: By length in words: the items and their fingerprints.
        self.prints: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted(set(lengths.tolist())):
            own = np.flatnonzero(lengths == n)
            votes = [_votes(self.words[i], min(WIDTH, n), np.array([self.weight[x] for x in self.bags[i]])).sum(axis=0) for i in own]
            self.prints[n] = own, _packed(np.stack(votes))

    def scan(self, docs: list[list[bytes]]) -> Iterator[tuple[int, list[tuple[int, float, int, int]]]]:
        """For each document with leaks its index and (item, similarity, first word, words) of the best
        window of each item."""
        h = np.concatenate([_hashes(w) for w in docs]) if docs else np.empty(0, np.uint64)
        ends = np.cumsum([len(w) for w in docs])
        hits: dict[int, np.ndarray] = {}
        numbers: dict[int, np.ndarray] = {}
        for k, (known, table, *_) in self.known.items():
            r = _roll(h, k)
            at = np.flatnonzero(table[r >> np.uint64(44)])
            which = np.minimum(np.searchsorted(known, r[at]), len(known) - 1)
            held = known[which] == r[at]
            at, which = at[held], which[held]
            held = at + k <= ends[np.searchsorted(ends, at, "right")]  # not across documents
            hits[k], numbers[k] = at[held], which[held]
        every = np.unique(np.concatenate(list(hits.values()))) if hits else np.empty(0, np.int64)
        for d in np.unique(np.searchsorted(ends, every, "right")).tolist():
            first = int(ends[d]) - len(docs[d])
            best: dict[int, tuple[float, int, int]] = {}
            own = {}
            for k, x in hits.items():
                part = slice(np.searchsorted(x, first), np.searchsorted(x, ends[d]))
                own[k] = x[part] - first, numbers[k][part]
            mine = every[np.searchsorted(every, first) : np.searchsorted(every, ends[d])] - first
            for group in np.split(mine, np.flatnonzero(np.diff(mine) > self.longest) + 1):  # no window holds hits so far apart
                lo, hi = max(0, int(group[0]) - self.longest), min(len(docs[d]), int(group[-1]) + self.longest + WIDTH)
                for k, (x, number) in own.items():
                    part = slice(np.searchsorted(x, lo), np.searchsorted(x, hi - k, "right"))
                    self._windows(docs[d][lo:hi], k, x[part] - lo, number[part], lo, best)
            if best:
                yield d, [(i, *best[i]) for i in sorted(best)]

    def _windows(self, words: list[bytes], k: int, at: np.ndarray, number: np.ndarray, offset: int, best: dict[int, tuple[float, int, int]]) -> None:
        """Windows of some words whose known shingles of k words, by number, begin at the places `at`."""
        _, _, weight, begin, items, _ = self.known[k]
        m = begin[number + 1] - begin[number]
        row = np.repeat(begin[number] - np.cumsum(m) + m, m) + np.arange(m.sum())  # rows of (hash, item) at each place
        own, which = np.unique(items[row], return_inverse=True)
        enough = np.bincount(which, np.repeat(weight[number], m), len(own)) >= SIMILARITY * self.total[own] - 1e-6
        # A window as long as an item may reach SIMILARITY only where the item's shingles weigh enough: other lengths
        # need no fingerprints here.
        lengths = sorted({len(self.words[i]) for i in own[enough].tolist()} - set(range(len(words) + 1, self.longest + 1)))
        if not lengths:
            return
        each = np.full(len(words) - k + 1, self.other)
        each[at] = weight[number]
        sums = np.concatenate((np.zeros((1, BITS), np.int64), np.cumsum(_votes(words, k, each), axis=0)))
        for n in lengths:
            span, count = n - k + 1, len(words) - n + 1
            prints = _packed(sums[span : span + count] - sums[:count])
            number_of, prints_of = self.prints[n]
            window, item, distance = near(prints, prints_of)
            exact: dict[int, dict[int, float]] = {}

            def similar(i: int, s: int, n: int = n, exact: dict[int, dict[int, float]] = exact) -> float:
                if s not in (own := exact.setdefault(i, {})):
                    own[s] = similarity(shingles(words[s : s + n], k), self.bags[i], self.weight, self.other)
                return own[s]

            for d, s, i in sorted(zip(distance.tolist(), window.tolist(), number_of[item].tolist())):
                if not d or 1.0 not in exact.get(i, {}).values():  # equal bags have equal fingerprints
                    similar(i, s)
            for i in exact:
                sim, s = max((x, -s) for s, x in exact[i].items())
                s = -s
                # The windows beside the best one may be better, and their fingerprints beyond the radius.
                for step in (-1, 1):
                    while 0 <= s + step < count and (similar(i, s + step), -step) > (sim, 0):
                        s += step
                        sim = similar(i, s)
                if sim >= SIMILARITY and (i not in best or (sim, -s - offset) > (best[i][0], -best[i][1])):
                    best[i] = (sim, s + offset, n)


def passes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", pass_chars: int = PASS_CHARS) -> Iterator[tuple[list, list[str], dict[int, int], int]]:
    """The benchmark in portions of bounded size: ids, texts, in how many items of the whole benchmark shingles of
    the portion are (by digest, if in several), and how many items have words. Null texts are left out."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "t"):
            h = [list({_digest(x) for x in shingles(words_of(t))}) for t in raw_texts(b.column("t"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h, pa.list_(pa.int64()))], names=["id", "t", "h"])

    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("t is not null")
    rows = materialize(rows.mapInArrow(digests, with_fields(rows.schema, "h array<bigint>")), "leak-items")
    size = rows.agg(F.sum(F.length("t")).alias("n"), F.count_if(F.size("h") > 0).alias("items")).first()
    shared = materialize(rows.select(F.explode("h").alias("h")).groupBy("h").count().filter("count > 1"), "leak-shared")
    n = (size["n"] or 0) // pass_chars + 1
    for p in range(n):
        own = rows.filter(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == p)
        part = own.select("id", "t").orderBy("id", "t").toArrow()
        if part.num_rows:
            known = own.select(F.explode("h").alias("h")).distinct().join(shared, "h").toArrow()  # of a pass: bounded
            yield part.column("id").to_pylist(), part.column("t").to_pylist(), dict(zip(known.column("h").to_pylist(), known.column("count").to_pylist())), size["items"]


def _indexed(ids: list, texts: list[str], shared: dict[int, int], total: int) -> Items:
    return Items(list(ids), [words_of(t.encode()) for t in texts], shared, total)


LEAK = "doc_id {}, item_id {}, similarity double, first_word long, n_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): for each row of docs and each item that it holds,
    the most similar window (the first of equals), if the weighted similarity is SIMILARITY or more.

    Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased; items of fewer than WIDTH words are one shingle.
    Null and empty texts and items without words have no leaks. Repeated rows and items each give theirs. A shingle's
    weight counts the items of the whole benchmark that have it, whatever number of passes the benchmark takes.
    """
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for portion in passes(benchmark, item_col):
        shared = docs.sparkSession.sparkContext.broadcast(portion)  # PASS_CHARS at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _indexed(*shared.value)
            for b in text_slices(batches, "t"):
                found = [(d, *x) for d, leaks in items.scan([words_of(t) for t in raw_texts(b.column("t"))]) for x in leaks]
                if found:
                    d, i, sim, s, n = zip(*found)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array([items.ids[x] for x in i]), pa.array(sim), pa.array(s, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        one = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, LEAK.format(*kinds))
        out = one if out is None else out.unionAll(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAK.format(*kinds))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs that hold no item, unchanged and unshuffled: null and empty texts hold none, repeated rows all
    stay or go, and other columns, whatever their names, are carried along."""
    for portion in passes(benchmark, item_col):
        shared = docs.sparkSession.sparkContext.broadcast(portion)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _indexed(*shared.value)
            for b in text_slices(batches, text_col):
                keep = np.ones(b.num_rows, bool)
                keep[np.array([d for d, _ in items.scan([words_of(t) for t in raw_texts(b.column(text_col))])], np.int64)] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
