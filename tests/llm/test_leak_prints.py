"""Fingerprints of windows: blocks lose no pair within the radius, and few windows of enough similarity lie beyond."""

import random

import numpy as np

from cairnspark.llm import decontam


def test_blocks_give_all_pairs_within_the_radius():
    g = np.random.default_rng(1)
    b = g.integers(0, 1 << 63, 80, dtype=np.uint64)
    a = np.concatenate([b ^ np.uint64(sum(1 << int(x) for x in g.choice(64, k, replace=False))) for k in (0, 5, 17, 18, 19, 25)])
    x, y, d = decontam.near(a, b)
    every = np.bitwise_count(a[:, None] ^ b[None, :])
    assert {(i, j): int(k) for i, j, k in zip(x, y, d)} == {(int(i), int(j)): int(every[i, j]) for i, j in zip(*np.nonzero(every <= decontam.RADIUS))}
    assert len(x) >= 4 * 80 and not len(decontam.near(a[:0], b)[0])


def made(seed, n, low=0.8, high=0.84):
    """Items that share passages with each other, and documents with a window of each of barely enough similarity."""
    r = random.Random(seed)
    vocabulary = [f"w{i}".encode() for i in range(4000)]
    common = [r.choices(vocabulary, k=12) for _ in range(20)]
    items = [[*r.choices(vocabulary, k=r.randrange(12, 140)), *(r.choice(common) if r.random() < 0.4 else []), *r.choices(vocabulary, k=r.randrange(12, 60))] for _ in range(n)]
    index = decontam.Items(list(range(n)), items)
    docs = []
    for i, item in enumerate(items):
        for _ in range(30):
            w = list(item)
            for _ in range(r.randrange(1, 2 + len(w) // 20)):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[b"new%d" % r.randrange(99)], [], [w[at], b"more"]])
            w = (w + r.choices(vocabulary, k=len(item)))[: len(item)]
            sim = decontam.similarity(decontam.shingles(w), index.bags[i], index.weight, index.other)
            if low <= sim < high:
                docs.append((i, [*r.choices(vocabulary, k=25), *w, *r.choices(vocabulary, k=25)]))
                break
    return index, docs


def test_few_windows_of_barely_enough_similarity_are_lost():
    index, docs = made(3, 600)
    found = dict(index.scan([d for _, d in docs]))
    lost = [k for k, (i, _) in enumerate(docs) if i not in {x[0] for x in found.get(k, [])}]
    assert len(docs) > 300 and len(lost) <= 0.01 * len(docs), (len(lost), len(docs))


def test_windows_found_are_exact():
    index, docs = made(4, 60, 0.8, 1.01)
    for d, leaks in index.scan([d for _, d in docs]):
        for i, sim, s, n in leaks:
            windows = [docs[d][1][x : x + n] for x in range(len(docs[d][1]) - n + 1)]
            every = [decontam.similarity(decontam.shingles(w), index.bags[i], index.weight, index.other) for w in windows]
            assert n == len(index.words[i]) and sim == every[s] == max(every) and s == every.index(sim)
