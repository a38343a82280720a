"""Whitening, WARC archives and the prefix trie: the queries on awkward tables against plain Python with exact numbers,
and their parts."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import zstandard

from cairnspark.llm import prefix_trie, queries, warc, whitening


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return f"file://{tmp_path_factory.mktemp('new')}"


# Whitening


def vectors():
    g = np.random.default_rng(2)
    base = g.normal(size=(60, 5)) @ np.diag([3.0, 1.0, 0.3, 0.1, 0.02]) + [0, 50, -7, 0, 1]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(0, rows[0][1]), (100, rows[1][1]), (101, rows[1][1]), (None, rows[2][1])]
    return rows, [(200, None), (201, []), (202, [math.nan] * 5), (203, [None] * 5), (204, [1.0, math.inf, 0.0, 0.0, 0.0])]


def whitened(spark, rows, folder, name, extra="label int", also=(1,)):
    d = f"{folder}/{name}"
    spark.createDataFrame([(*r, *also) for r in rows], f"vec_id long, embedding array<float>, {extra}").write.parquet(f"{d}/embeddings.parquet")
    return queries.op11_whitening(spark, d).collect()


def test_whitening_equals_exact_covariance(spark, folder):
    good, bad = vectors()
    out = whitened(spark, good + bad, folder, "e", "component int, n int, x int", (4, 5, 6))
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in good}
    points = sorted({tuple(v) for v in x.values()})
    n, d = len(points), 5
    sums = [sum(p[k] for p in points) for k in range(d)]
    cov = [[Fraction(sum((n * p[a] - sums[a]) * (n * p[b] - sums[b]) for p in points), n**3) for b in range(d)] for a in range(d)]
    values = sorted(np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in cov])), reverse=True)
    trace = float(sum(cov[k][k] for k in range(d)))
    assert Counter((r.vec_id, r.component) for r in out) == Counter((i, k) for i, _ in good for k in range(1, 6))
    for r in out:
        y = [n * a - s for a, s in zip(x[r.vec_id], sums)]
        assert r.n == n and r.deviation == sum(v * v for v in y)
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-6) and r.identity_error < 1e-9
    by = {r.component: {} for r in out}
    for r in out:
        by[r.component][tuple(x[r.vec_id])] = r.whitened
    w = np.array([[by[k][p] for k in range(1, 6)] for p in points])
    assert np.abs(w.mean(axis=0)).max() < 1e-9 and np.abs(w.T @ w / n - np.eye(5)).max() < 1e-9
    back = np.array([[float(Fraction(n * p[k] - sums[k], n)) for k in range(d)] for p in points])
    v = back.T @ w / n / np.sqrt(values)  # each direction, from its projections
    assert np.abs(v.T @ v - np.eye(5)).max() < 1e-6


def test_whitening_of_nothing_and_of_one_vector(spark, folder):
    assert whitened(spark, [], folder, "e0") == []
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], folder, "e1") == []
    flat = whitened(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])], folder, "e2")
    assert [(r.vec_id, r.component, abs(r.whitened), r.explained) for r in sorted(flat)] == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_lengths_are_spaces_of_their_own_and_large_components_stay_exact(spark, folder):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0]), (4, [1.0, 2.0, 3.0]), (5, [2.0, 2.0, 3.5])]
    df = spark.createDataFrame([(*r, "a") for r in rows], "vec_id long, embedding array<float>, Component string")
    out = whitening.whiten(df).collect()
    assert {(r.vec_id, r.n) for r in out} == {(1, 3), (2, 3), (3, 3), (4, 2), (5, 2)} and out[0].input_Component == "a"
    x = [[1_000_000 + (1 << 61), 1_000_000], [1_000_000 - (1 << 61), 1_000_064], [1_000_000, 1_000_320]]
    s = [sum(v[k] for v in x) for k in (0, 1)]
    got = {r.vec_id: (r.deviation, int(r.deviation_text)) for r in out}
    for i, v in enumerate(x, 1):
        want = sum((3 * a - b) ** 2 for a, b in zip(v, s))
        assert got[i] == (want if want < 1 << 63 else None, want)


def test_digit_slices_are_exact():
    r = random.Random(1)
    y = np.array([[r.randrange(-(1 << 61), 1 << 61) for _ in range(4)] for _ in range(300)], dtype=np.int64)
    assert (sum(z.astype(object) * (1 << (whitening.LIMB * k)) for k, z in enumerate(map(lambda z: z.astype(np.int64), whitening.limbs(y)))) == y.astype(object)).all()
    assert (whitening.gram(y) == y.astype(object).T @ y.astype(object)).all()
    big = y.astype(object) * 10**30
    assert (whitening.gram(big) == big.T @ big).all()


def test_small_eigenvalues_are_not_lost_beside_large_ones():
    g = np.random.default_rng(4)
    q, _ = np.linalg.qr(g.normal(size=(6, 6)))
    want = np.array([1e12, 1e6, 1e3, 10.0, 3.0, 1.0])
    a = (q * want) @ q.T
    a = np.round((a + a.T) / 2 * 2**40).astype(object)
    _, values, explained = whitening.principal([[int(x) for x in r] for r in a], 1 << 40, 16)
    assert values == pytest.approx(want, rel=1e-4) and explained == pytest.approx(want / want.sum(), rel=1e-4)


# WARC


def page_rows():
    body = "<html>é " + "word " * 40
    rows = [(5, "http://a.b/x", body), (3, "http://a.b/y", body), (9, None, body), (4, "http://a.b/z\r\nX-Evil: 1 2", body + "!"), (6, "u", None), (7, "u", ""), (8, "u", "short"), (10, "v", "short"), (None, "w", body), (None, None, None), (11, "x", "x" * 99), (12, "x", "x" * 99), (13, "x", "y" * 100), (14, "x", "y" * 100), (15, "big", "z\r\n\r\n" * 300_000)]
    return rows + [rows[1], rows[6], (3, None, body)] + [(100 + i, "u", f"page {i} " + "<p>menu home about</p>" * 9) for i in range(80)]


def test_warc_query_equals_plain_python(spark, folder):
    d = f"{folder}/p"
    rows = page_rows()
    spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, payload string, row int").write.parquet(f"{d}/pages.parquet")
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, math.inf), math.inf if i is None else i)
    want, seen = Counter(), set()
    for i, _, h in sorted(rows, key=lambda r: math.inf if r[0] is None else r[0]):
        p = (h or "").encode()
        again = h in first and h in seen
        seen.add(h)
        want[(i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[h] if again else None)] += 1
    assert Counter(map(tuple, queries.op12_warc(spark, d).collect())) == want


def test_archives_hold_records_of_their_own_frames_behind_a_dictionary(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    archives = warc.write_archives(pages, f"file://{tmp_path}", archive_bytes=1 << 20)
    told = archives.collect()
    assert len(told) > 1 and sum(a.records for a in told) == len(page_rows()) and all(a.dictionary_bytes for a in told)
    texts = Counter(h or "" for _, _, h in page_rows())
    back = warc.read_archives(archives).collect()
    stored = Counter(bytes(r.payload).decode() for r in back if r.record_type == "response")
    assert set(stored) == set(texts) and all(stored[t] == (1 if len(t.encode()) >= 100 else texts[t]) for t in texts)
    assert {r.url for r in back if r.page_id == 4} == {"http://a.b/z%0D%0AX-Evil:%201%202"} and {r.url for r in back if r.page_id == 9} == {None}
    data = open(told[0].path.removeprefix("file://"), "rb").read()
    size = int.from_bytes(data[4:8], "little")
    assert data[:4] == bytes.fromhex("5d2a4d18") and data[8 + size : 12 + size] == bytes.fromhex("28b52ffd")
    one = zstandard.ZstdDecompressor(dict_data=warc._dictionary(data[8 : 8 + size])).decompressobj()
    assert one.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert len(list(warc.read_archive(told[0].path))) == told[0].records
    (tmp_path / "cut.warc.zst").write_bytes(data[:-3])
    with pytest.raises(ValueError, match="within a record"):
        list(warc.read_archive(str(tmp_path / "cut.warc.zst")))
    (tmp_path / "bare.warc.zst").write_bytes(data[8 + size :])
    with pytest.raises(ValueError, match="no dictionary"):
        list(warc.read_archive(str(tmp_path / "bare.warc.zst")))


def test_records_are_checked():
    r = warc.Record(1, "u", "response", 3, hashlib.sha256(b"abc").hexdigest(), None, b"abc")
    assert warc.decode(warc.encode(r)) == r
    with pytest.raises(ValueError, match="differs"):
        warc.decode(warc.encode(r).replace(b"abc\r\n", b"abd\r\n"))
    assert warc.decode(warc.encode(r).replace(b"WARC-Type: response", b"WARC-Type: metadata")) is None


def test_a_dictionary_pays_for_small_pages(tmp_path):
    records = [warc.encode(warc.Record(i, f"http://h/{i}", "response", 0, hashlib.sha256(b"").hexdigest(), None, b"")) for i in range(3000)]
    n, _, size = warc.write_archive(str(tmp_path / "a.warc.zst"), iter(records))
    alone = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert n == 3000 and size < alone / 2 and list(warc.read_archive(str(tmp_path / "a.warc.zst"))) == records


def test_no_pages_no_records(spark, folder):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/p0/pages.parquet")
    assert queries.op12_warc(spark, f"{folder}/p0").collect() == []


# Prefix trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in sorted(rebuilt.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = defaultdict(list)
    for c, v in sorted(rebuilt.items()):
        ends[tuple(v)].append(c)
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def talk_rows(seed=0, n=400):
    r = random.Random(seed)
    rows = []
    for c in [r.randrange(-150, 1200) for _ in range(n)]:
        rows += [(c, r.choice([None, *range(8)]), r.choice(["user", "bot", None]), r.choice(["hi", "héllo 😀", "", None, "x y"])) for _ in range(r.randrange(1, 6))]
    return rows + rows[:50] + [(None, 1, "user", "lost"), (500, 3, "user", "w" * 200_000)]


def built(spark, rows, folder, name):
    spark.createDataFrame([(*x, 1, "z") for x in rows], "conv_id long, turn long, role string, text string, depth int, owner string").write.parquet(f"{folder}/{name}/conversations.parquet")
    return Counter(map(tuple, queries.op13_prefix_trie(spark, f"{folder}/{name}").collect()))


def test_trie_equals_plain_python(spark, folder):
    rows = talk_rows()
    assert built(spark, rows, folder, "c") == trie_by_hand(rows)
    assert built(spark, [], folder, "c0") == Counter()
    lone = [(7, 1, "u", "a")]  # its head of 7's crc goes, and nothing is left but the root
    assert built(spark, lone, folder, "c1") == trie_by_hand(lone)


def test_long_conversations_go_by_segments_and_nested_chains_sum_up(spark, folder, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 4)
    rows = [(100 * k, t, "u", f"t{t}" if t < 30 - k else f"{k} {t}") for k in range(25) for t in range(30)]
    rows += [(101, t, "u", f"t{t}") for t in range(60)]
    assert built(spark, rows, folder, "c2") == trie_by_hand(rows)
