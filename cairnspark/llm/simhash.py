"""SimHash near-duplicates with BK-trees.

Fingerprints that differ in at most r bits agree on some choice of blocks (pigeonhole), so a shard is one
value of one choice of blocks and all links lie within shards. A BK-tree is built over each shard, on the
task that holds the shard: sending all trees to all tasks would broadcast data that grows with the corpus.
Trees are built and searched level by level over arrays, many shards at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_below, discard, hex64, materialize, raw_texts, text_slices
from .components import connected_components

#: A shard of more fingerprints is searched as pairs of parts, each pair in a task of its own.
SHARD_LIMIT = 20_000
#: Blocks are chosen so that a shard of evenly spread fingerprints has at most so many.
SHARD_AIM = 256
#: Fingerprints that a task searches at once, and (query, node) pairs at once.
FOREST, FRONTIER = 100_000, 1_000_000

_LANES = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)).view(np.uint64).ravel()


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit SimHash of the shingles of `width` words, repeats included; no word: 0."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= width:
        return digest(joined, 42)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    h = np.fromiter((digest(joined[s : e - 1], 42) for s, e in zip(starts, ends[width - 1 :])), np.uint64, n - width + 1)
    lanes = np.add.reduceat(_LANES[h.view(np.uint8).reshape(-1, 8)], np.arange(0, len(h), 255), axis=0)
    counts = lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp bigint) of every row; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "t"):
            fp = np.array([fingerprint(t, width) for t in raw_texts(b.column("t"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def block_plan(n: int, radius: int) -> tuple[list[tuple[int, int]], int]:
    """Blocks as (first bit, bits), and how many of them make a key: the fewest keys with which n evenly
    spread fingerprints give shards of at most SHARD_AIM."""
    for agree in range(1, 5):
        k = radius + agree
        cuts = [64 * i // k for i in range(k + 1)]
        if n <= SHARD_AIM << (64 // k * agree) or agree == 4:
            return [(s, e - s) for s, e in zip(cuts, cuts[1:])], agree
    raise AssertionError


def shard_keys(fps: DataFrame, blocks: list[tuple[int, int]], agree: int) -> DataFrame:
    """(t, k, fp): every fingerprint in one shard of each choice of blocks."""
    keys = []
    for t, chosen in enumerate(combinations(blocks, agree)):
        key = "0L"
        for start, bits in chosen:
            key = f"(shiftleft({key}, {bits}) | (shiftrightunsigned(fp, {start}) & {(1 << bits) - 1}L))"
        keys.append(f"struct({t} as t, {key} as k)")
    return fps.select("fp", F.expr(f"inline(array({', '.join(keys)}))")).select("t", "k", "fp")


def bk_forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A BK-tree over the fingerprints of each shard. shard: sorted; fp: distinct in a shard.

    Returns the root of each row's tree, and all other nodes in order of (parent, distance to it) with
    those keys, parent * 65 + distance.
    """
    n = len(fp)
    root = np.empty(n, np.int64)
    nodes, keys = [], []
    active, key = np.arange(n), shard
    top = True
    while len(active):
        first = np.concatenate(([True], key[1:] != key[:-1]))
        heads, run = active[first], np.cumsum(first) - 1
        if top:
            root[active], top = heads[run], False
        else:
            nodes.append(heads)
            keys.append(key[first])
        active, head = active[~first], heads[run[~first]]
        key = head * 65 + np.bitwise_count(fp[active] ^ fp[head])
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
    if not nodes:
        return root, np.empty(0, np.int64), np.empty(0, np.int64)
    node, k = np.concatenate(nodes), np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    return root, node[order], k[order]


def bk_links(shard: np.ndarray, fp: np.ndarray, radius: int | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), j < i, of one shard within the radius (one for all, or one by row, alike in a shard), in
    chunks: each fingerprint descends its tree by the edges whose distance is within the radius of its own."""
    root, node, keys = bk_forest(shard, fp)
    radius = np.broadcast_to(radius, len(fp))
    sizes = np.bincount(root, minlength=len(fp))[root]
    part = np.cumsum(sizes) // FRONTIER
    for q in np.split(np.arange(len(fp)), np.flatnonzero(np.diff(part)) + 1):
        at = root[q]
        while len(q):
            d = np.bitwise_count(fp[q] ^ fp[at]).astype(np.int64)
            r = radius[q]
            hit = (d <= r) & (at < q)
            if hit.any():
                yield q[hit], at[hit]
            lo = np.searchsorted(keys, at * 65 + np.maximum(d - r, 0), "left")
            hi = np.searchsorted(keys, at * 65 + np.minimum(d + r, 64), "right")
            m = hi - lo
            q = np.repeat(q, m)
            at = node[np.repeat(lo - np.cumsum(m) + m, m) + np.arange(len(q))]


Accept = Callable[[np.ndarray, np.ndarray], np.ndarray]


def spanning_links(shard: np.ndarray, fp: np.ndarray, radius: int | np.ndarray, accept: Accept | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the links of bk_links (those that are accepted) as many as join their components, none more: each hooks
    the larger root of its two components to the smaller."""
    label = np.arange(len(fp))
    for i, j in bk_links(shard, fp, radius):
        if accept:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            good = accept(i, j)
            i, j = i[good], j[good]
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            root, first = np.unique(np.maximum(a, b), return_index=True)
            yield i[first], j[first]
            label[root] = np.minimum(a, b)[first]
            while not ((up := label[label]) == label).all():
                label = up


def whole_groups(batches: Iterator[pa.RecordBatch], cut: list[str], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by `cut` as tables of about so many rows, in which every group of `cut` is whole."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:  # all but the last group are whole
            table = pa.Table.from_batches(held)
            tail = np.all([table.column(c).to_numpy() == table.column(c)[-1].as_py() for c in cut], axis=0)
            whole = n - int(tail.sum())
            if whole:
                yield table.slice(0, whole)
            held = table.slice(whole).to_batches()
            n -= whole
    if n:
        yield pa.Table.from_batches(held)


def search_shards(keyed: DataFrame, radius: int, shard_limit: int = SHARD_LIMIT, exact_keys: int | None = None, exact_radius: int = 64, accept: Callable[[pa.Table], Accept] | None = None) -> DataFrame:
    """(a, b): links between nodes of a shard, with the same components as all pairs within the radius; never
    more than a shard has nodes (or, of a shard over the limit, each pair of its parts). keyed: (t, k, fp,
    node) and what `accept` reads: it gives, for rows of a shard, the test that links must pass besides the radius.
    Shards with t from exact_keys on have exact_radius."""
    parts = materialize(keyed.groupBy("t", "k").count().filter(F.col("count") > shard_limit).select("t", "k", F.ceil(F.col("count") / shard_limit).cast("int").alias("c")), "shard-parts")
    cut, rest = ["t", "k", "i", "j"], [c for c in keyed.columns if c not in ("t", "k")]
    if parts.isEmpty():
        keyed = keyed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:  # each part of a large shard meets each other part
        own = F.pmod(F.xxhash64("node"), F.col("c")).cast("int")
        keyed = keyed.join(broadcast_below(parts, BROADCAST_GROUPS), ["t", "k"], "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("p", own)
        keyed = keyed.withColumn("o", F.explode(F.expr("sequence(0, c - 1)"))).select("t", "k", *rest, F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, cut, FOREST):
            change = np.any([c[1:] != c[:-1] for c in (table.column(x).to_numpy() for x in cut)], axis=0)
            shard, fp = np.concatenate(([0], np.cumsum(change))), table.column("fp").to_numpy().view(np.uint64)
            node = table.column("node").combine_chunks()
            within = radius if exact_keys is None else np.where(table.column("t").to_numpy() >= exact_keys, exact_radius, radius)
            for i, j in spanning_links(shard, fp, within, accept and accept(table)):
                yield pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j))], names=["a", "b"])

    kind = keyed.schema["node"].dataType.simpleString()
    return keyed.repartition(*cut).sortWithinPartitions(*cut, "fp").mapInArrow(run, f"a {kind}, b {kind}")


def near_links(fps: DataFrame, radius: int, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(a, b): edges with the same components as all pairs of the distinct bigints `fp` within the radius."""
    return search_shards(shard_keys(fps, *block_plan(fps.count(), radius)).withColumn("node", F.col("fp")), radius, shard_limit)


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    Fingerprints at most `radius` bits apart are linked; component_id is the least doc_id reachable. Null
    and empty texts have fingerprint zero, linked like any other. A null doc_id is never a component's
    name unless all its members' are null. Repeated rows stay; other columns are not read.
    """
    ids = materialize(fingerprints(docs, id_col, text_col, width), "simhash-ids")
    known = materialize(ids.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    cc = materialize(connected_components(near_links(known.select("fp"), radius)), "simhash-components")
    linked = cc.join(known.withColumnRenamed("fp", "node"), "node")
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cc.join(names, "component").select(F.col("node").alias("fp"), "component_id")
    names = materialize(known.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-names")
    return ids.join(names, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


#: For copies by similarity: words of a shingle, least Jaccard similarity, and bits within which a pair of that
#: similarity lies (9.7 of 64 differ on average, more than 20 about once in 3,000 pairs of just that similarity).
WIDTH, SIMILARITY, WIDE_RADIUS = 5, 0.8, 20
#: Minimum hashes of a text that are keys. Texts of that similarity share none of them once in ten million pairs.
MIN_HASHES = 10
#: Minimum hashes of which a byte goes along with a text, and how many of them two texts must have alike to be
#: candidates: of texts of that similarity fewer are alike once in 4,000 pairs. Texts that merely share a passage,
#: and whose fingerprints are near by chance, have few alike, and don't chain whole corpora to one component.
SKETCH, LEAST_ALIKE = 16, 7
#: Texts of so many shingles or fewer (then 10 hashes are enough) have their least fifth and one more as keys, of
#: which similar texts share one for certain; longer ones that may be similar to such texts have both kinds of
#: keys. Few shingles scatter the fingerprint more, so shards of such keys have a wider radius.
SHORT, SHORT_RADIUS = 45, 24
#: Texts of a candidate component that one task compares with each other, and their shingles, at most about: a
#: larger component is compared as pairs of parts.
PART_ROWS, PART_SHINGLES = 2_000, 1_000_000
#: Ids of candidates, and components or shards that are cut: so many are broadcast, more are joined by a shuffle.
BROADCAST_ENDS, BROADCAST_GROUPS = 500_000, 100_000
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(f"minimum {i}", 42) | 1 for i in range(SKETCH)], np.uint64)


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; of fewer words than width all together; none: empty."""
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((digest(joined[s : e - 1], 42) for s, e in zip(starts, ends[len(words) - n :])), np.uint64, n))


def _signature(text: bytes) -> tuple[bytes, int, int, bytes, list[int], list[int]]:
    """Of a text: digest of its words, SimHash of its distinct shingles, their number, a byte of each minimum hash,
    the first of these hashes (none of a short text) and its prefix: the least shingles' hashes, of which similar
    texts must share one (none of a long text)."""
    words = text.lower().split()
    h = shingle_hashes(words)
    n, node = len(h), xxhash.xxh128_digest(b" ".join(words))
    if not n:
        return node, 0, 0, bytes(SKETCH), [], []
    lanes = np.add.reduceat(_LANES[h.view(np.uint8).reshape(-1, 8)], np.arange(0, n, 255), axis=0)
    counts = lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    fp = np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0]
    spread = h >> np.uint64(29)
    least = np.array([(h * m ^ spread).min() for m in _MULTIPLIERS])
    sketch = (least >> np.uint64(7)).astype(np.uint8).tobytes()
    keys = least[:MIN_HASHES].view(np.int64).tolist() if n > SHORT else []
    prefix = h[: n - -(-4 * n // 5) + 1].view(np.int64).tolist() if 4 * n <= 5 * SHORT else []
    return node, int(fp), n, sketch, keys, prefix


def _likely(table: pa.Table) -> Accept:
    """Whether texts may be similar by their numbers of shingles and by the bytes of their minimum hashes."""
    n = table.column("n").to_numpy()
    sketch = np.frombuffer(b"".join(table.column("m").to_pylist()), np.uint8).reshape(-1, SKETCH)

    def accept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = n[i], n[j]
        ok = 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
        at = np.flatnonzero(ok)
        ok[at] = (sketch[i[at]] == sketch[j[at]]).sum(axis=1) >= LEAST_ALIKE
        return ok

    return accept


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node reachable from each of n nodes by the links (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not ((up := label[label]) == label).all():
            label = up


def _common(row: np.ndarray, token: np.ndarray, n: int, left: int) -> np.ndarray:
    """How many tokens rows have in common, as a matrix. (row, token): the sets, no pair twice. left: 0 for all n
    rows with each other (above the diagonal only), else the first `left` rows with the others."""
    order = np.lexsort((row, token))
    row, token = row[order], token[order]
    begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    df = np.diff(np.append(begin, len(row)))
    high, wide = (left, n - left) if left else (n, n)
    out = np.zeros((high, wide), np.float32)
    codes = []
    for d in range(2, 9):  # rare tokens: their pairs one by one
        own = row[begin[df == d][:, None] + np.arange(d)]
        for x in range(d - 1):
            for y in range(x + 1, d):
                a, b = own[:, x], own[:, y]
                if left:
                    across = (a < left) & (b >= left)
                    a, b = a[across], b[across] - left
                codes.append(a * wide + b)
    codes = np.concatenate(codes)
    if len(codes):
        out += np.bincount(codes, minlength=high * wide).reshape(high, wide)
    heavy = np.flatnonzero(df > 8)
    for s in range(0, len(heavy), 4096):  # frequent ones: by products of 0/1 matrices
        part = heavy[s : s + 4096]
        at = np.repeat(begin[part] - np.cumsum(df[part]) + df[part], df[part]) + np.arange(df[part].sum())
        x = np.zeros((n, len(part)), np.float32)
        x[row[at], np.repeat(np.arange(len(part)), df[part])] = 1
        out += x[:left] @ x[left:].T if left else x @ x.T
    return out


def similar_sets(sets: list[np.ndarray], left: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), a < b, between the sets of distinct hashes whose Jaccard similarity is 0.8 or more: all of
    them, or with left those between the first `left` sets and the others. Equal sets of one side are linked too."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        ok = 9 * both >= 4 * size.sum()
        return np.zeros(int(ok), np.int64), np.ones(int(ok), np.int64)
    row = np.repeat(np.arange(n), size)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    live = np.ones(n, bool)
    for _ in range(8):  # sets with too few shared hashes have no link; without them others may have too few
        df = np.bincount(token)
        shared = df[token] >= 2
        row, token = row[shared], token[shared]
        enough = live & (5 * np.bincount(row, minlength=n) >= 4 * size)
        if (enough == live).all():
            break
        live = enough
        row, token = row[live[row]], token[live[row]]
    own = np.flatnonzero(live)
    first = int(np.searchsorted(own, left)) if left else 0
    if len(own) < 2 or (left and (not first or first == len(own))):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    number = np.cumsum(live) - 1
    both = _common(number[row], token, len(own), first)
    z = size[own].astype(np.float32)
    a, b = np.nonzero(9 * both >= 4 * ((z[:first] if first else z)[:, None] + (z[first:] if first else z)))
    if first:
        b = b + first
    up = a < b
    return own[a[up]], own[b[up]]


def _decide(table: pa.Table) -> Iterator[tuple[list, list, bool]]:
    """Of each group of sorted rows (component, i, j, p, id, s): ids and the least ids that exact similarity
    joins them to, and whether the group is a whole component."""
    cuts = [table.column(c).to_numpy() for c in ("component_number", "i", "j")]
    begin = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cuts], axis=0))))
    c, p, s, ids = table.column("c").to_numpy(), table.column("p").to_numpy(), table.column("s"), table.column("id")
    for x, y in zip(begin, [*begin[1:], table.num_rows]):
        if y - x < 2:
            continue
        i, j = cuts[1][x], cuts[2][x]
        order = np.argsort(p[x:y], kind="stable") + x  # part i, then part j
        rows = dict.fromkeys(zip(ids.take(pa.array(order)).to_pylist(), s.take(pa.array(order)).to_pylist(), p[order].tolist()))  # repeated rows once
        own, sets = [v for v, _, _ in rows], [np.frombuffer(v, np.uint64) for _, v, _ in rows]
        left = sum(v == i for _, _, v in rows) if i != j else 0
        if len(own) < 2:
            continue
        if left == len(own):
            continue
        a, b = similar_sets(sets, left)
        same: dict = {}
        again = [(same.setdefault(v, k), k) for k, v in enumerate(own) if v in same or same.setdefault(v, k) != k]
        if again:  # rows of one id are one document
            a, b = np.append(a, [u for u, _ in again]), np.append(b, [v for _, v in again])
        label = roots(len(own), a.astype(np.int64), b.astype(np.int64))
        least: dict = {}
        for r, v in zip(label.tolist(), own):
            least[r] = v if r not in least else min(least[r], v)
        links = [(v, least[r]) for r, v in zip(label.tolist(), own) if v != least[r]]
        if links:
            yield [v for v, _ in links], [v for _, v in links], bool((c[x:y] == 1).all())


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_limit: int = SHARD_LIMIT, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, component_id) of every row: texts whose sets of WIDTH-word shingles have a Jaccard
    similarity of SIMILARITY or more are linked; component_id is the least doc_id reachable.

    A shard has the fingerprints of the texts that share a minimum hash (short texts: a hash of their prefix). Its
    BK-tree gives candidates, of which a spanning forest is kept. A similar pair lies in one component of these, so
    the exact sets of each component are compared with each other in a task, a large component as pairs of parts.
    What leaves a task is a forest, never pairs. Texts of the same words (A-Z lower-cased, any white space) are
    compared once; null and empty texts are one text. Rows of one doc_id are one document, even with different
    texts. Rows without doc_id are linked to texts of the same words alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "t"):
            node, fp, n, sketch, least, prefix = zip(*map(_signature, raw_texts(b.column("t"))))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(node, pa.binary()), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(sketch, pa.binary()), pa.array(least, longs), pa.array(prefix, longs)], names=["doc_id", "node", "fp", "n", "m", "h", "q"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in text_slices(batches, "t"):
            words = [t.lower().split() for t in raw_texts(b.column("t"))]
            node = b.column("node").to_pylist()  # another row of the same id may have another text, or the same
            own = []
            for i, key in enumerate(zip(b.column("id").to_pylist(), node)):
                if key not in seen and xxhash.xxh128_digest(b" ".join(words[i])) == node[i]:
                    seen.add(key)
                    own.append(i)
            s = pa.array([shingle_hashes(words[i]).tobytes() for i in own], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(own, pa.int64())) for c in ("id", "component_number", "c", "p")] + [s], names=["id", "component_number", "c", "p", "s"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, cut, part_rows):
            for a, b, whole in _decide(table):
                yield pa.RecordBatch.from_arrays([pa.array(a, table.schema.field("id").type), pa.array(b, table.schema.field("id").type), pa.array([whole] * len(a))], names=["a", "b", "whole"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = materialize(docs.mapInArrow(run, f"doc_id {kind}, node binary, fp bigint, n bigint, m binary, h array<bigint>, q array<bigint>"), "near-ids")
    known = materialize(ids.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("fp", "n", "m", "h", "q")).alias("s")).select("node", "least", "s.*"), "near-distinct")
    # A nameless text cannot be read again by its id, so its links can't be decided: it must not stand between others.
    named = known.filter("least is not null")
    keys = F.concat(F.expr("transform(h, (x, t) -> struct(t as t, x as k))"), F.transform("q", lambda x: F.struct(F.lit(MIN_HASHES).alias("t"), x.alias("k"))))
    keyed = named.select("fp", F.col("least").alias("node"), "n", "m", F.inline(keys)).select("t", "k", "fp", "node", "n", "m")
    links = materialize(search_shards(keyed, WIDE_RADIUS, shard_limit, MIN_HASHES, SHORT_RADIUS, _likely).filter("a <> b").distinct(), "near-links")
    cc = materialize(connected_components(links), "near-candidates")
    discard(links)
    members = cc.join(named.select(F.col("least").alias("node"), F.col("node").alias("digest"), "n"), "node")
    size = members.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    large = size.select("component", F.greatest(F.ceil(F.col("rows") / part_rows), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int").alias("c")).filter("c > 1")
    large = materialize(large, "near-large")
    members = members.join(broadcast_below(large, BROADCAST_GROUPS), "component", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    # component_number: a hash, so that equal numbers of two components merely have them compared too.
    members = members.select(F.col("node").alias("id"), F.col("digest").alias("node"), F.xxhash64("component").alias("component_number"), "c", F.pmod(F.xxhash64("node", "digest"), F.col("c")).cast("int").alias("p"))
    members = materialize(members, "near-members")
    shingled = docs.join(broadcast_below(members, BROADCAST_ENDS), F.col("doc_id") == F.col("id")).select("id", "component_number", "c", "p", "node", "t").mapInArrow(sets, f"id {kind}, component_number bigint, c int, p int, s binary")
    cut = ["component_number", "i", "j"]
    dealt = shingled.withColumn("o", F.explode(F.expr("sequence(0, c - 1)"))).withColumns({"i": F.least("p", "o"), "j": F.greatest("p", "o")}).drop("o")
    joined = materialize(dealt.repartition(*cut).sortWithinPartitions(*cut).mapInArrow(decide, f"a {kind}, b {kind}, whole boolean"), "near-joined")
    parted = connected_components(joined.filter("not whole"))
    names = materialize(joined.filter("whole").select(F.col("a").alias("least"), F.col("b").alias("component_id")).union(parted.select("node", "component")), "near-components")
    named = known.select("node", "least").join(names, "least", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    named = materialize(named, "near-names")
    out = ids.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")
    discard(known, cc, large, members, joined, names)
    return out
