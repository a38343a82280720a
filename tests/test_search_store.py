"""The stored index: equal to a search over the notes as they are, kept up by segments, read where its terms lie."""

import os
import re

import pytest
from pyspark.sql import functions as F

from cairnspark.model import NOTES
from cairnspark.operators import search, search_store

WORDS = "harbour bridge river old town cost winter repair spring figure".split()


def notes(spark, n=60):
    rows = [dict.fromkeys(NOTES.names) | {"id": f"n{i:02}", "topic_key": f"k/{i}", "title": WORDS[i % 10], "content": " ".join(WORDS[(i * j) % 10] for j in range(1, 3 + i % 7)), "type": "skill" if i % 4 == 0 else "decision", "revision": 1} for i in range(n)]
    df = spark.createDataFrame([tuple(r[c] for c in NOTES.names) for r in rows], NOTES)
    return df.withColumn("updated_at", F.expr("timestamp '2024-01-01' + make_interval(0,0,0,0,0,cast(substr(id, 2) as int),0)"))


def files(store):
    root = store.root.removeprefix("file://")
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names}


def same(store, now, spark):
    index = search.build_index(now)
    for query, kind in (("harbour river", ""), ("old TOWN nothing", "skill")):
        want = [(r.id, round(r.score, 9)) for r in search.ranked_search(now, index, query, kind, 9).collect()]
        assert [(r.id, round(r.score, 9)) for r in search_store.ranked(store, query, kind, 9).collect()] == want and want
    assert not search_store.drifted(store, now).first().drifted


@pytest.fixture
def store(spark, tmp_path):
    return search_store.create(search_store.SearchStore(spark, f"file://{tmp_path}/index", 8), notes(spark))


def test_a_change_writes_a_segment_and_leaves_the_others(spark, store):
    now = notes(spark)
    same(store, now, spark)
    before = files(store)
    changed = now.filter("id < 'n10'").withColumns({"content": F.lit("harbour harbour cost"), "deleted_at": F.when(F.col("id") == "n03", F.lit("2024-02-02").cast("timestamp"))}).unionByName(now.filter("id = 'n20'").withColumns({"id": F.lit("new"), "content": F.lit("river town")}))
    assert search_store.save(store, changed) == 1 and before < files(store)
    now = now.join(changed.select("id"), "id", "left_anti").select(now.columns).unionByName(changed)
    same(store, now, spark)
    assert search_store.drifted(store, now.filter("id <> 'new'")).first().drifted
    search_store.merge(store)
    assert search_store.segments(store) == [0] and not before & files(store)
    same(store, now, spark)


def test_many_segments_are_merged_and_what_is_cut_off_is_not_there(spark, store):
    now = notes(spark)
    for k in range(4):
        one = now.filter(F.col("id") == f"n3{k}").withColumn("content", F.lit("bridge " * k + "harbour"))
        now = now.filter(F.col("id") != f"n3{k}").unionByName(one)
        search_store.save(store, one, most_segments=3)
    assert search_store.generation(store) == 1 and search_store.segments(store) == [0, 1]
    same(store, now, spark)
    search_store.save(store, now.limit(5).withColumn("content", F.lit("lost")))
    os.remove(f"{store.root.removeprefix('file://')}/gen=1/done/segment=2")  # as if the writer had died
    same(store, now, spark)


def test_a_search_reads_the_folders_of_its_terms(spark, store):
    plan = search_store.postings_of(store, ["river"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "In(term, [river])" in plan or "EqualTo(term,river)" in plan
    assert search_store.ranked(store, "   ").count() == 0
