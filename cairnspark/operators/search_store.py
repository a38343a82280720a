"""A stored index of notes, kept up by segments.

A change writes a segment: the postings of the notes that changed, their lengths, and tombstones that end all that
earlier segments have of them. Segments are merged into a new generation when there are many. Postings lie in folders by
a hash of their term and sorted by term, so a search reads the folders of its own terms and nothing else; lengths, dates
and types lie with the index, so it doesn't touch the notes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from .notes import live
from .search import K1, B, terms

#: Folders of a segment's postings; segments after which a change merges them.
BUCKETS, MOST_SEGMENTS = 64, 16


class SearchStore(NamedTuple):
    spark: SparkSession
    root: str
    buckets: int = BUCKETS


_TABLES = {"postings": "term string, id string, tf long, length int", "notes": "id string, length int, updated_at timestamp, type string", "gone": "id string"}


def _path(store: SearchStore, *parts: str):
    path = store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([store.root, *parts]))
    return path, path.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(store: SearchStore, folder: str, prefix: str) -> list[int]:
    """The numbers that the folder's entries have behind a prefix."""
    path, fs = _path(store, folder) if folder else _path(store)
    return sorted(int(x.getPath().getName().removeprefix(prefix)) for x in fs.listStatus(path) if x.getPath().getName().startswith(prefix)) if fs.exists(path) else []


def generation(store: SearchStore) -> int:
    """The latest generation that is complete; -1 without any."""
    return max((g for g in _numbers(store, "", "gen=") if (lambda p, fs: fs.exists(p))(*_path(store, f"gen={g}", "READY"))), default=-1)


def segments(store: SearchStore) -> list[int]:
    """The segments of the current generation that were written to the end."""
    return _numbers(store, f"gen={generation(store)}/done", "segment=")


def _mark(store: SearchStore, *parts: str) -> None:
    path, fs = _path(store, *parts)
    fs.create(path, True).close()


def _text() -> Column:
    return F.concat_ws(" ", "title", "content", "topic_key")


def _write(store: SearchStore, g: int, s: int, postings: DataFrame, notes: DataFrame, gone: DataFrame) -> None:
    """Write a segment; its mark comes last, so a segment that was cut off is not there."""
    at = lambda t: f"{store.root}/gen={g}/{t}/segment={s}"
    bucket = F.pmod(F.xxhash64("term"), F.lit(store.buckets)).cast("int")
    # A bucket of many postings is several tasks' and several files'.
    postings.withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
    notes.write.mode("overwrite").parquet(at("notes"))
    gone.write.mode("overwrite").parquet(at("gone"))
    _mark(store, f"gen={g}", "done", f"segment={s}")


def _made(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and note rows of live notes that have words."""
    words = materialize(live(notes).select("id", "updated_at", "type", terms(_text()).alias("w")).filter(F.size("w") > 0), "index-words")
    postings = words.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    return postings.select("term", "id", "tf", "length"), words.select("id", F.size("w").alias("length"), F.col("updated_at").cast("timestamp").alias("updated_at"), "type")


def create(store: SearchStore, notes: DataFrame) -> SearchStore:
    """Index all notes in a new generation."""
    g = generation(store) + 1
    _write(store, g, 0, *_made(notes), notes.select("id").limit(0))
    _mark(store, f"gen={g}", "READY")
    return store


def save(store: SearchStore, changed: DataFrame, most_segments: int = MOST_SEGMENTS) -> int:
    """Take over notes as they are now, new, changed and deleted ones, whole rows with their ids. Writes one segment,
    whose number it returns; other segments stay as they are, unless so many come together that they are merged."""
    g, s = generation(store), max(_numbers(store, f"gen={generation(store)}/postings", "segment="), default=-1) + 1
    changed = materialize(changed, "index-changed")
    _write(store, g, s, *_made(changed), changed.select("id").distinct())
    if len(segments(store)) > most_segments:
        merge(store)
    return s


def _read(store: SearchStore, name: str) -> DataFrame:
    """A table's rows of all complete segments, with their segment."""
    root = f"{store.root}/gen={generation(store)}/{name}"
    kind = _TABLES[name] + ", segment int" + (", bucket int" if name == "postings" else "")
    return store.spark.read.schema(kind).option("basePath", root).parquet(root).filter(F.col("segment").isin(segments(store)))


def _alive(store: SearchStore, rows: DataFrame) -> DataFrame:
    """Rows that no later segment has a tombstone for."""
    ended = _read(store, "gone").groupBy("id").agg(F.max("segment").alias("ended"))
    return rows.join(ended, "id", "left").filter("ended is null or ended <= segment").drop("ended")


def merge(store: SearchStore) -> None:
    """All that is alive as one segment of a new generation, which counts once it is complete; then the old one goes."""
    g = generation(store)
    postings, notes = (_alive(store, _read(store, t)).drop("segment", "bucket") for t in ("postings", "notes"))
    _write(store, g + 1, 0, postings, notes, notes.select("id").limit(0))
    _mark(store, f"gen={g + 1}", "READY")
    path, fs = _path(store, f"gen={g}")
    fs.delete(path, True)


def postings_of(store: SearchStore, words: list[str]) -> DataFrame:
    """(term, id, tf, length) of some terms: the folders of others are not read."""
    buckets = [r[0] for r in store.spark.createDataFrame([(w,) for w in words], "term string").select(F.pmod(F.xxhash64("term"), F.lit(store.buckets)).cast("int")).distinct().collect()]
    return _alive(store, _read(store, "postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(words)).drop("bucket")).drop("segment")


def ranked(store: SearchStore, query: str, note_type: str = "", limit: int = 20) -> DataFrame:
    """(id, score), as search.ranked_search, from the index alone."""
    known = _alive(store, _read(store, "notes"))
    stats = known.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    words = list(dict.fromkeys(query.lower().split()))
    if not words:
        return known.select("id", F.lit(0.0).alias("score")).limit(0)
    found = materialize(postings_of(store, words), "hits")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = found.join(df, "term").join(stats).groupBy("id").agg(F.sum(idf * weight).alias("score"))
    rows = known.filter(F.col("type") == note_type) if note_type else known
    top = rows.select("id", "updated_at").join(scored, "id").orderBy(F.desc("score"), F.desc("updated_at"), F.desc("id"))
    return (top.limit(limit) if limit > 0 else top).select("id", "score")


def drifted(store: SearchStore, notes: DataFrame) -> DataFrame:
    """One row (drifted): whether the index and the live notes with words have different ids or lengths."""
    own = live(notes).select("id", F.size(terms(_text())).alias("length")).filter("length > 0")
    mine = _alive(store, _read(store, "notes")).select("id", "length")
    sums = lambda df, x: df.agg(F.count("*").alias(f"{x}n"), F.bit_xor(F.xxhash64("id", "length")).alias(f"{x}h"))
    return sums(own, "a").join(sums(mine, "b")).select((~(F.col("an").eqNullSafe(F.col("bn")) & F.col("ah").eqNullSafe(F.col("bh")))).alias("drifted"))
