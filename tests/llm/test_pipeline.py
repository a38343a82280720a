"""The corpus pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline
from cairnspark.llm import decontam


def corpus(spark, folder):
    r = random.Random(6)
    vocabulary = {"aa": [f"{a}{b}{c}" for a in "bcd" for b in "aeé" for c in "lmn"], "bb": [f"{a}{b}{c}" for a in "fgh" for b in "ioö" for c in "rst"]}
    text = lambda lang, n: " ".join(r.choice(vocabulary[lang]) + str(r.randrange(9)) * (r.random() < 0.3) for _ in range(n))
    docs, labels = [], []
    for i in range(160):
        lang = ("aa", "bb")[i % 2]
        t = text(lang, 70)
        toxic = i % 4 == 1
        if toxic:
            w = t.split()
            w[10:10] = ["zzvile", "zzfoul", r.choice(["zzvile", "zzgrim"])]
            t = " ".join(w)
        docs.append((i, t, lang))
        labels.append((i, 1, int(toxic)))
    item = "Question nine: name the seven rivers that cross the long plain before the old stone bridge at dawn"
    docs += [(200, docs[0][1], "aa"), (201, docs[2][1] + " more", "aa"), (202, text("aa", 30) + " " + item + " " + text("aa", 20), "aa"), (203, "123 456", None), (204, None, None), (205, "", "bb")]
    rows = [(i, t, lang, "s", None if t is None else len(t), "extra") for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, {i for i, _, y in labels if y}


def test_every_stage_takes_effect(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, toxic = corpus(spark, folder)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {None: {i for i, *_ in docs}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == now.columns
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert now.count() == len(kept[name])
    assert kept[None] - kept["toxicity"] == toxic
    assert kept["toxicity"] - kept["language"] == {203, 204, 205}
    assert kept["language"] - kept["near_duplicates"] == {200, 201}
    assert kept["near_duplicates"] - kept["decontamination"] == {202}
    last = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert {r["doc_id"] for r in last.collect()} == kept["decontamination"]
    whole = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in whole.collect()} == kept["decontamination"]


def test_rows_without_ids_and_repeated_rows(spark):
    r = random.Random(1)
    t = [" ".join(f"w{r.randrange(300)}" for _ in range(40)) for _ in range(3)]
    rows = [(1, t[0]), (1, t[0]), (2, t[0]), (None, t[0]), (None, t[1]), (None, t[1]), (3, t[2]), (None, None)]
    df = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((x["doc_id"] or 0, x["text"] or "") for x in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == sorted([(1, t[0]), (3, t[2]), (0, t[1]), (0, "")])
    assert not corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").count()


def test_words_are_cut_alike_in_any_case():
    assert decontam.words_of("ÉTÉ d'Été-9".encode()) == decontam.words_of("été D'ÉTÉ 9".encode())


def test_near_copies_without_ids_are_linked_like_others(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    copies = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (20, 90, 150)]
    other = " ".join(f"v{r.randrange(10**6)}" for _ in range(200))
    kept = lambda rows: sorted(((x["doc_id"] or 0), x["text"]) for x in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long"), "").collect())
    assert kept([(-5, copies[0]), (None, copies[1]), (None, copies[2]), (10, other), (9, copies[1])]) == [(-5, copies[0]), (10, other)]
    nameless = kept([(None, x) for x in (*copies, other)])
    assert len(nameless) == 2 and nameless[1 if nameless[0][1] in copies else 0][1] == other


def test_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert not stage(spark, docs, folder).count(), name
    assert not corpus_pipeline.run(spark, folder).count()
