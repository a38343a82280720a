"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties,
repeated rows and extra columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from cairnspark.llm import components, decontam, html_text, langid, licenses, packing, sharding, simhash, toxicity, url_filter, vector_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int"


def table(spark, rows):
    """rows: (doc_id, text[, lang]); the extra columns clash with names that operators add."""
    return spark.createDataFrame([(i, t, *(rest or ["en"]), "s", None if t is None else len(t), 0.5, 9) for i, t, *rest in rows], DOCS)


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def union(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def awkward(r):
    base = [words(r, 60) for _ in range(12)]
    texts = [*base, base[0], base[0].upper(), base[1] + " more", "", None, None, "one two", "x", words(r, 30_000), "\t \n"]
    for t in base[2:8]:
        w = t.split()
        w[r.randrange(60)] = "changed"
        texts.append(" ".join(w))
    return texts


# op1


def test_host_and_path(spark):
    urls = ["https://A.Org:80/x/Y?q#f", "http://b.org", "http://c.org?x", "no scheme", None, "//d.org/x", "s://h#/x", "http:///p"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select(url_filter.url_host(df.u).alias("h"), url_filter.url_path(df.u).alias("p")).collect()
    assert [tuple(x) for x in got] == [("a.org:80", "/x/Y"), ("b.org", ""), ("c.org", ""), ("", ""), ("", ""), ("", ""), ("h", ""), ("", "/p")]


def test_blocks_spread_to_aliases_but_not_over_rules(spark):
    pages = [
        (1, "http://bad.org/b/1", '<link rel="canonical" href="http://x.net/a">'),
        (2, "http://x.net/a", None),
        (3, "http://y.net/p", "<META HTTP-EQUIV=refresh content='0; url=//x.net/a'>"),
        (4, "http://good.org/ok", '<link href="/b/2" rel=canonical>'),
        (5, "http://ok.org/z", '<link rel=canonical href="http://x.net/a?utm=1">'),
        (6, "http://free.net/", ""),
        (7, None, '<link rel="canonical" href="http://x.net/a">'),
        (6, "http://free.net/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = spark.createDataFrame([("org", "/", "allow"), ("bad.org", "/b/", "block")], "rule_host string, rule_path string, action string")
    out = url_filter.judge_urls(df.select("page_id", "url"), rules, url_filter.alias_edges(df)).collect()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in out}
    assert len(out) == 8
    assert got == {1: ("bad.org/b/", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("org/", "allow"), 5: ("org/", "allow"), 6: (None, "allow"), 7: (None, "allow")}
    assert not url_filter.judge_urls(df.limit(0).select("page_id", "url"), rules, url_filter.alias_edges(df.limit(0))).count()


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(40), r.randrange(40)) for _ in range(30)] + [(0, k) for k in range(30, 40)] + [(k, k + 1) for k in range(12, 22)]
    want = union(40, links)
    got = components.connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert {x["node"]: x["component"] for x in got} == {x: want[x] for x in ends} and len(got) == len(ends)


# op2


def plain_simhash(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    k = min(width, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_are_all_pairs_within_the_radius(spark):
    texts = awkward(random.Random(1))
    got = simhash.near_duplicates(table(spark, [*enumerate(texts), (3, texts[3])]).repartition(3)).collect()
    fps = [plain_simhash(t, 4) for t in texts]
    want = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert len(got) == len(texts) + 1
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in range(len(texts))}
    assert not simhash.near_duplicates(table(spark, [])).count()


def test_spark_and_python_hash_alike(spark):
    assert spark.sql("select xxhash64('añb c') h").first()["h"] % 2**64 == xxhash.xxh64_intdigest("añb c", 42)


@pytest.mark.parametrize("limit", [20_000, 7])
@pytest.mark.parametrize("radius", [2, 4])
def test_shards_lose_no_link(spark, limit, radius):
    r = random.Random(radius)
    fps = [r.getrandbits(64) for _ in range(15)]
    for f in list(fps):
        for _ in range(4):
            f ^= sum(1 << b for b in r.sample(range(64), r.randrange(1, radius + 2)))
            fps.append(f)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    links = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= radius]
    got = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, shard_limit=limit).collect()
    at = {f: i for i, f in enumerate(fps)}
    assert union(len(fps), [(at[a], at[b]) for a, b in got]) == union(len(fps), links)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= radius for a, b in got)


@pytest.mark.parametrize("n", [10**3, 10**7, 10**9, 10**11])
def test_block_plans_agree_on_a_key_within_the_radius(n):
    blocks, agree = simhash.block_plan(n, 4)
    assert sum(b for _, b in blocks) == 64 and len(blocks) - 4 == agree


def test_bk_search_equals_all_pairs():
    r = np.random.default_rng(2)
    fp = np.unique(r.integers(0, 2**64, 300, dtype=np.uint64) & np.uint64(0xFFFF))
    shard = np.zeros(len(fp), np.int64)
    got = {(int(a), int(b)) for i, j in simhash.bk_links(shard, fp, 3) for a, b in zip(i, j)}
    d = np.bitwise_count(fp[:, None] ^ fp)
    assert got == {(i, j) for i in range(len(fp)) for j in range(i) if d[i, j] <= 3}


@pytest.mark.parametrize("limit", [20_000, 5])
def test_similar_documents(spark, limit):
    r = random.Random(4)
    texts = awkward(r) + [words(r, 40) for _ in range(3)]
    chain = words(r, 80).split()
    for _ in range(6):  # each similar to the next, the ends not
        texts.append(" ".join(chain))
        chain = chain[2:] + [f"new{r.randrange(999)}", f"new{r.randrange(999)}"]
    bags = []
    for t in texts:
        w = (t or "").lower().split()
        bags.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    sim = lambda a, b: a == b if not a or not b else len(a & b) / len(a | b) >= 0.8
    want = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if sim(bags[i], bags[j])])
    got = simhash.similar_documents(table(spark, enumerate(texts)), shard_limit=limit).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))


# op3, op5


def language_rows(r, n):
    letters = {"aa": "abcdé", "bb": "efghß", "cc": "ijklñ"}
    return [(i, " ".join("".join(r.choice(letters[k]) for _ in range(r.randrange(2, 7))) for _ in range(40)), k) for i in range(n) for k in (r.choice(list(letters)),)]


def test_language_model_holds_out_and_calibrates(spark):
    rows = language_rows(random.Random(1), 200)
    df = table(spark, [*rows, (900, None, "aa"), (901, "12 !!", None), (902, "", "bb"), (None, "abc abc", "aa")])
    from cairnspark.llm.common import crc_mod

    held = crc_mod("doc_id", 3) == 1
    model = langid.train(df, ~held)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert model.langs == ["aa", "bb", "cc"] and len(got) == 204
    assert all(got[i]["lang_pred"] == k for i, _, k in rows)
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and got[900]["score"] == 0
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[0]["input_score"] == 0.5
    none = langid.train(df.limit(0), ~held)
    assert {x["lang_pred"] for x in langid.identify(df.limit(5), none).collect()} == {"und"}


def test_ngrams_do_not_depend_on_the_batch():
    texts = ["Ab c", "", "é!!é", "12", "x" * 1000]
    one = [next(langid.gram_counts([t])) for t in texts]
    for (a, b), (c, d) in zip(one, langid.gram_counts(texts)):
        assert (a == c).all() and (b == d).all()
    assert not len(one[1][0]) and not len(one[3][0])


def toxic_rows(r, n):
    rows, labels = [], []
    for i in range(n):
        y = i % 4 == 0
        w = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrst')}" for _ in range(60)]
        for _ in range(3 if y else 0):
            w.insert(r.randrange(len(w)), r.choice(["zzbad", "zzworse", "ZZBAD", "zznew" + r.choice("abcdef")]))
        rows.append((i, " ".join(w) + ("\nmore words" if i % 3 else "")))
        labels.append((i, 1, int(y)))
    return rows, labels


def test_toxic_spans(spark):
    from cairnspark.llm.common import crc_mod

    rows, labels = toxic_rows(random.Random(2), 300)
    df = table(spark, [*rows, (1000, None), (1001, ""), (1002, "zzbad " * 3), (None, "bam")])
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, marks, crc_mod("doc_id", 5) != 0)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert len(got) == 304 and all(0 <= r["score"] <= 1 for r in got.values())
    wrong = [i for i, _, y in labels if got[i]["predicted"] != y]
    assert len(wrong) <= 3
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and got[1002]["predicted"] == 1
    text = dict(rows)
    for i, _, y in labels:
        for s in got[i]["spans"]:
            assert text[i][s["start"] : s["end"]].lower().startswith("zz")
    assert toxicity.train(df, marks.limit(0), crc_mod("doc_id", 5) != 0) is None
    assert {r["predicted"] for r in toxicity.score(df, None).collect()} == {0}


def test_marginals_are_those_of_all_paths():
    step, start, e = np.array([-1.0, 0.3, 0.8]), -0.5, np.array([0.2, -1.0, 2.0, 0.1, -30.0, 0.7])
    first = np.array([0, 4])
    x, y = toxicity.messages(e, first, step, start)
    p = 1 / (1 + np.exp(-(x + y)))
    move = {(0, 0): 0.0, (0, 1): step[0], (1, 0): step[1], (1, 1): step[2]}
    for s, n in ((0, 4), (4, 2)):
        total, marked = 0.0, np.zeros(n)
        for bits in range(1 << n):
            z = [bits >> k & 1 for k in range(n)]
            w = np.exp(start * z[0] + sum(e[s + k] * z[k] for k in range(n)) + sum(move[z[k], z[k + 1]] for k in range(n - 1)))
            total, marked = total + w, marked + w * np.array(z)
        assert np.allclose(p[s : s + n], marked / total)


def test_tokens_are_where_the_pattern_finds_them():
    for t in ("Ab1c\nÉÀ d'é İx KK", "", "\x01a\n\n", "ß ẞ 12"):
        assert len(toxicity.tokens(t.encode())) == len(toxicity._TOKEN.findall(t))


# op4


def test_packing_keeps_every_token_once(spark):
    r = random.Random(3)
    rows = [(i, "x" * r.choice([0, 1, 5, 60, 99, 100, 101, 333])) for i in range(200)] + [(7, "x" * 5), (None, None), (8, None)]
    got = packing.pack_documents(table(spark, rows), capacities=(32, 64, 128), group_rows=90).toPandas()
    assert got.n_tokens.sum() == sum(len(t or "") + 1 for _, t in rows)
    bins = defaultdict(list)
    for x in got.itertuples():
        bins[x.bin_id].append(x)
    for b in bins.values():
        used = sum(x.n_tokens for x in b)
        assert {x.used for x in b} == {used} and {x.capacity for x in b} == {min(c for c in (32, 64, 128) if c >= used)}
        at = 0
        for x in sorted(b, key=lambda x: x.position):
            assert x.position == at
            at += x.n_tokens
    pieces = Counter((x.n_tokens, x.start) for x in got.itertuples() if x.doc_id == 7)
    assert sum(n * c for (n, _), c in pieces.items()) == len(dict(rows[:200])[7]) + 1 + 6
    assert not packing.pack_documents(table(spark, [])).count()


def test_packing_is_near_the_volume_bound_and_joint_sizes_help():
    r = np.random.default_rng(1)
    n = r.integers(1, 900, 3000)
    bins, caps, cost = packing.best_pack(n, (256, 512, 1024))
    assert (np.bincount(bins, weights=n) <= caps).all()
    assert cost <= packing.best_pack(n, (1024,))[2]
    assert n.sum() / caps.sum() > 0.97


# op6


def brute_ring(keys, shards, capacity):
    """Keys one by one in ring order, each to the next shard clockwise that has room."""
    nodes = sharding.ring(shards, 12)
    load, out = [0] * shards, []
    for cell in keys:
        k = next((i for i, (c, _) in enumerate(nodes) if c >= cell), len(nodes))
        while load[nodes[k % len(nodes)][1]] >= capacity[nodes[k % len(nodes)][1]]:
            k += 1
        s = nodes[k % len(nodes)][1]
        out.append((s, load[s]))
        load[s] += 1
    return out


def test_bounded_loads_equal_one_by_one():
    r = random.Random(9)
    cells = sorted(r.randrange(1 << 12) for _ in range(1000))
    capacity = sharding.even_capacities(1000, 7)
    runs = sharding.place([(c, 0, n) for c, n in sorted(Counter(cells).items())], sharding.ring(7, 12), capacity)
    got = [(s, slot + k) for c, p, a, z, s, slot in runs for k in range(z - a)]
    assert got == brute_ring(cells, 7, capacity)
    with pytest.raises(ValueError):
        sharding.place([(1, 0, 5)], sharding.ring(2, 12), [2, 2])


def test_sharding_places_every_row_once(spark):
    rows = [(i % 37, f"t{i % 11}") for i in range(500)] + [(None, None)] * 5000
    out = sharding.assign(table(spark, rows).select("doc_id", "text", "shard"), ["doc_id", "text"], 8).toPandas()
    counts = Counter(out["shard"])
    assert len(out) == 5500 and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(out[out["shard"] == s]["slot"]) == list(range(n))
    assert set(out["input_shard"]) == {9}
    assert not sharding.assign(table(spark, []).select("doc_id"), ["doc_id"], 8).count()


def test_one_shard_more_moves_few(spark):
    df = spark.range(20_000)
    a = {r["id"]: r["shard"] for r in sharding.assign(df, ["id"], 8).collect()}
    b = {r["id"]: r["shard"] for r in sharding.assign(df, ["id"], 9).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.6 * len(a)  # bounded loads move more than the new shard's share


def test_shards_as_files(spark, tmp_path):
    sharding.write_shards(sharding.assign(spark.range(100).selectExpr("id", "'x' as t"), ["id"], 4), f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 100 and back.select("shard").distinct().count() == 4


# op7


def test_main_text_of_varied_pages():
    page = """<html><head><title>x</title></head><body><header class="site"><h1>Site</h1></header><nav>a b c</nav><div class="cookie-notice"><p>We use cookies on all of these many pages so that you can read them in comfort and we can too</p></div>
    <article><header><h1>A &amp; B</h1></header><p>One<br>two <b>th</b>ree&nbsp;four</p><script>var x = "<p>no</p>";</script><!-- <p>no</p> --><p>x &lt; y</p><div class="ad">Buy now</div><ul><li>item</li></ul><form><label>Name</label></form>
    <section class="comments"><p>Nice article, thank you so much for writing it, I read it twice and then my mother read it</p></section></article><aside>side</aside><footer>foot</footer></body></html>"""
    assert html_text.main_text(page) == "A & B\nOne two three four\nx < y\nitem"


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("<p", ""), ("<article><p>cut off <a hr", "cut off"), ("<article>a<p>b<p>c", "a\nb\nc"), ("<main>5 &lt; 6 &amp;amp; &#233;</main>", "5 < 6 &amp; é"), ("<article><p title='a>b'>q</p></article>", "q")])
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


def test_tree_fits_its_training_pages():
    tree = html_text.train()
    assert all(tree.keeps(b.features) == bool(b.label) for p in html_text.TRAINING for b in html_text.blocks(p))


def test_extract_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article>" + "<p>é w</p>" * 5000, "t"), (1, "u", None, "t"), (None, None, "", None)], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert sorted((r["n_chars"], r["input_text"]) for r in got if r["page_id"]) == [(0, "t"), (5000 * 4 - 1, "t")] and len(got) == 3
    assert not html_text.extract(df.limit(0)).count()


# op8


def test_search_is_exact(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(700, 6)), 1).astype(np.float32)  # many ties
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(900, None), (1000, [float("nan")] * 6), (1100, [None] * 6), (1200, []), (1300, [1.0, 2.0]), (None, [0.0] * 6), (5, rows[5][1])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>")
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vector_search, "BLOCK_QUERIES", 3)
    got = vector_search.search(df, df.filter("vec_id % 100 = 0"), k=10).collect()
    v = {i: np.floor(1024 * np.asarray(e, np.float64)).astype(np.int64) for i, e in rows}
    want = set()
    for q in range(0, 700, 100):
        s = sorted((-int(v[q] @ v[i]), i) for i in [*v, 5] if i != q)[:10]
        want |= {(q, k + 1, i, -n) for k, (n, i) in enumerate(s)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    assert not vector_search.search(df.limit(0), df.limit(0)).count()


def test_bounds_hold():
    r = np.random.default_rng(6)
    x, q = np.floor(r.normal(size=(500, 8)) * 1000), np.floor(r.normal(size=(20, 8)) * 1000)
    assert (vector_search.VAFile(x).upper_bounds(q) >= q @ x.T).all()


# op9


def test_leaks_equal_brute_force(spark):
    r = random.Random(8)
    items = [words(r, n, 5000) for n in (3, 15, 15, 22, 40, 40)] + [None, "", "!!"]
    docs = []
    for i in range(60):
        t = words(r, 80, 5000).split()
        if i % 3 == 0:
            w = items[i % 6].split()
            if i % 2 and len(w) > 30:
                w[-1] = "other"
            at = r.randrange(80)
            t[at:at] = w
        docs.append((i, " ".join(t).upper() if i % 4 == 0 else ", ".join(t)))
    docs += [(100, None), (101, ""), (102, items[4]), (103, items[0])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (round(x["similarity"], 6), x["first_word"], x["n_words"]) for x in decontam.find_leaks(table(spark, docs), bench).collect()}
    idx = decontam.Items(list(range(len(items))), [decontam.words_of((t or "").encode()) for t in items])
    want = {}
    for d, t in docs:
        w = decontam.words_of((t or "").encode())
        for k, i in enumerate(idx.ids):
            n = len(idx.words[k])
            best = max(((decontam.similarity(decontam.shingles(w[s : s + n]), idx.bags[k], idx.weight, idx.other), -s) for s in range(len(w) - n + 1)), default=(0, 0))
            if best[0] >= 0.8:
                want[d, i] = (round(best[0], 6), -best[1], n)
    assert got == want and len(want) > 15
    kept = {x["doc_id"] for x in decontam.drop_leaking(table(spark, docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert not decontam.find_leaks(table(spark, docs), bench.limit(0)).count()


def test_a_large_benchmark_takes_several_passes(spark, monkeypatch):
    r = random.Random(1)
    items = [words(r, 20, 5000) for _ in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = table(spark, [(i, words(r, 10) + " " + t) for i, t in enumerate(items)])
    monkeypatch.setattr(decontam.passes, "__defaults__", ("item_id", "text", 500))
    assert {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(docs, bench).collect()} == {(i, i) for i in range(30)}
    assert not decontam.drop_leaking(docs, bench).count()


# op10


def test_base_phrases_and_words(spark):
    texts = ["The MIT  License, and the Apache-License.", "mit licenses éMIT License", "a GNU General\nPublic # License mit license", None, "", "x" * 100_000 + " Mit-license", "SPDX-License-Identifier: BSD-3-Clause\nall rights reserved"]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, enumerate(texts)).drop("score")).collect()}
    for i, t in enumerate(texts):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        at = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(at))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert got[i]["base_labels"] == ",".join(sorted({x for _, x in at}))
    assert got[6]["labels"] == "bsd-3-clause,proprietary" and got[6]["score"] == 1.0
    assert got[3]["labels"] == "" and got[3]["score"] == 0


def test_inner_detections_are_suppressed():
    s = licenses.Scanner()
    low = b"licensed under the apache license, version 2.0 and released to the public domain"
    found = [(low[a:z], r.label) for a, z, r in s.detections(low)]
    assert found == [(b"licensed under the apache license, version 2.0", "apache-2.0"), (b"released to the public domain", "public-domain")]
    assert len(s.rules) > 300


def test_no_rule_matches_without_its_keyword():
    s = licenses.Scanner()
    samples = ["mit license", "under the gnu lesser general public license version 2.1", "licensed under bsd 3-clause license", "mozilla public license, v. 2.0", "apache license version 2.0", "gpl v3 license", "creative commons attribution-sharealike 4.0 international license", "spdx-license-identifier: mpl-2.0", "https://opensource.org/licenses/mit", "without warranty of any kind"]
    for t in samples:
        low = t.encode()
        gated = {n for _, numbers in s.automaton.iter(low.decode("latin-1")) for n in numbers}
        assert {r.number for r in s.rules if r.pattern.search(low)} <= gated
        assert s.detections(low)


def test_crc_of_ids(spark):
    from cairnspark.llm.common import crc_mod

    df = spark.createDataFrame([(0,), (17,), (-3,), (None,)], "doc_id long")
    got = [r[0] for r in df.select(crc_mod("doc_id", 5)).collect()]
    assert got == [zlib.crc32(x) % 5 for x in (b"0", b"17", b"-3", b"")]
