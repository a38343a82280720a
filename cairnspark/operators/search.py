"""Text search over notes: substrings, and ranked by BM25 over an inverted index derived from the notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .notes import live

#: Constants of the ranking function (Robertson and Zaragoza 2009).
K1, B = 1.2, 0.75


def substring_search(notes: DataFrame, query: str, note_type: str = "", limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """Live notes with the query, in any case, in title, content or topic, newest first and at most `limit`;
    and one row (total) of how many there are."""
    q = query.lower()
    hit = live(notes).filter(F.lower("title").contains(q) | F.lower("content").contains(q) | F.lower("topic_key").contains(q))
    hit = hit.filter(F.col("type") == note_type) if note_type else hit
    top = hit.orderBy(F.desc("updated_at"), F.desc("id"))
    return (top.limit(limit) if limit > 0 else top), hit.agg(F.count("*").alias("total"))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def build_index(notes: DataFrame) -> DataFrame:
    """(term, id, tf, length): the inverted index of live notes. Long texts are exploded and counted map-side. Where it
    is not stored, whoever filters it by term has only these terms' rows counted and moved."""
    words = live(notes).select("id", terms(F.concat_ws(" ", "title", "content", "topic_key")).alias("w"))
    # Outer, as an inner one is preceded by a filter on the array's size, which splits each text once more.
    each = words.select("id", F.size("w").alias("length"), F.explode_outer("w").alias("term")).filter("term is not null")
    return each.groupBy("term", "id").agg(F.count("*").alias("tf"), F.max("length").alias("length"))


def index_drifted(index: DataFrame, notes: DataFrame) -> DataFrame:
    """One row (drifted): whether index and live notes name different numbers of notes."""
    n = index.agg(F.count_distinct("id").alias("a")).join(live(notes).filter(F.size(terms(F.concat_ws(" ", "title", "content", "topic_key"))) > 0).agg(F.count_distinct("id").alias("b")))
    return n.select((F.col("a") != F.col("b")).alias("drifted"))


def ranked_search(notes: DataFrame, index: DataFrame, query: str, note_type: str = "", limit: int = 20) -> DataFrame:
    """(id, score) of live notes with any of the query's terms, best first, newer of equals first. The index is read
    for the rows of the query's terms alone; number and mean length of notes come from the notes."""
    # No filter on the length, which would count a text's words twice; without words it adds nothing to the sum.
    lengths = live(notes).select(F.size(terms(F.concat_ws(" ", "title", "content", "topic_key"))).alias("length"))
    stats = lengths.agg(F.count_if(F.col("length") > 0).alias("n"), F.sum("length").alias("words")).select("n", F.try_divide("words", "n").alias("mean"))
    found = materialize(index.filter(F.col("term").isin(query.lower().split())), "hits")  # the words of one query
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = found.join(df, "term").join(stats).groupBy("id").agg(F.sum(idf * weight).alias("score"))
    rows = live(notes).filter(F.col("type") == note_type) if note_type else live(notes)
    top = rows.select("id", "updated_at").join(scored, "id").orderBy(F.desc("score"), F.desc("updated_at"), F.desc("id"))
    return (top.limit(limit) if limit > 0 else top).select("id", "score")


def autolink(notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_id, to_id): live notes and the class or file nodes whose name, used once, is a symbol of theirs."""
    from ..functions.text import symbols

    names = nodes.filter(F.col("kind").isin("class", "file")).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("to_id")).filter("n = 1")
    said = live(notes).select(F.col("id").alias("from_id"), F.explode(symbols(F.concat_ws(" ", "title", "content"))).alias("name")).distinct()
    return said.join(names.select("name", "to_id"), "name").select("from_id", "to_id").distinct()


def relink(relations: DataFrame, notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """relations with the automatic links of all live notes made anew."""
    links = autolink(notes, nodes).select(F.concat_ws("-", F.lit("auto"), "from_id", "to_id").alias("id"), "from_id", "to_id", F.lit("documents_auto").alias("relation_type"))
    own = live(notes).select(F.col("id").alias("from_id"))
    old = relations.filter("relation_type = 'documents_auto'").join(own, "from_id", "left_semi").select("from_id", "to_id", "relation_type")
    return relations.join(old, ["from_id", "to_id", "relation_type"], "left_anti").unionByName(links, allowMissingColumns=True).select(relations.columns)
