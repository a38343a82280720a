"""Concepts and their cards: landmarks, entry points and traits shared with other concepts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from .closures import closure

MAX_BYTES, MAX_LINES, MAX_IMPLEMENTERS = 1024, 30, 6


def discover(files: DataFrame, roots: list[str]) -> DataFrame:
    """(name, package, path): files below a root package by the next segment, or by the root itself. Names are
    the last segment in lower case; shared ones become the whole package, then get numbers."""
    package = F.lit(None).cast("string")
    for root in reversed(roots):
        below = F.concat(F.lit(root + "."), F.substring_index(F.expr(f"substring(package, {len(root) + 2})"), ".", 1))
        package = F.when(F.col("package") == root, root).when(F.col("package").startswith(root + "."), below).otherwise(package)
    got = files.withColumn("p", package).filter("p is not null").select("path", F.col("p").alias("package"))
    names = got.select("package").distinct().withColumn("leaf", F.lower(F.substring_index("package", ".", -1)))
    names = unique_names(names.withColumnRenamed("leaf", "name"))
    return got.join(names, "package").select("name", "package", "path")


def unique_names(concepts: DataFrame) -> DataFrame:
    """(package, name) with every name once: shared ones become the package with dashes, then -2, -3 and on."""
    n = F.count("*").over(Window.partitionBy("name"))
    whole = F.regexp_replace(F.lower("package"), "[./]", "-")
    q = concepts.withColumn("name", F.when(n > 1, whole).otherwise(F.col("name")))
    k = F.row_number().over(Window.partitionBy("name").orderBy("package"))
    return q.withColumn("k", k).select("package", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", F.col("k").cast("string"))).alias("name"))


def anchors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, anchor): the topmost node that contains each node, itself if none does."""
    up = edges.filter("kind = 'contains'").select(F.col("to_id").alias("a"), F.col("from_id").alias("b")).distinct()
    contained = up.select(F.col("a").alias("id")).distinct()
    top = closure(up, contained).groupBy("source").agg(F.max(F.struct("depth", "id")).alias("t")).select(F.col("source").alias("id"), F.col("t.id").alias("anchor"))
    ids = nodes.select("id").union(edges.select("from_id")).union(edges.select("to_id")).distinct()
    return ids.join(top, "id", "left").select("id", F.coalesce("anchor", "id").alias("anchor"))


def landmarks(nodes: DataFrame, edges: DataFrame, concepts: DataFrame, most: int = 10) -> DataFrame:
    """(concept, id, name, path, fan_in, entry): the topmost nodes of each concept with most edges in; entry: used
    from outside it. concepts: (name, path)."""
    top = materialize(anchors(nodes, edges), "anchors")
    of = nodes.join(concepts.select(F.col("name").alias("concept"), "path"), "path").select("id", "concept")
    # What the concepts of a using node say of any other: whether they are all one, and how many. Anchors are few where
    # most edges lead to few files, so edges meet their nodes' ids alone and are summed by anchor before they meet more.
    spread = of.groupBy("id").agg(F.count("*").alias("m"), F.bool_or(F.col("concept").isNull()).alias("none"), F.min("concept").alias("lo"), F.max("concept").alias("hi"))
    near = top.join(spread.withColumnRenamed("id", "anchor"), "anchor", "left").select(F.col("id").alias("from_id"), F.col("anchor").alias("f"), F.coalesce("m", F.lit(1)).alias("m"), F.coalesce("none", F.lit(True)).alias("none"), "lo", "hi")
    use = edges.filter(F.col("kind").isin("calls", "extends", "implements")).select("from_id", "to_id").join(near, "from_id").join(top.select(F.col("id").alias("to_id"), F.col("anchor").alias("t")), "to_id").filter("f <> t")
    # Numbers are summed by hash; least and greatest texts would have all edges sorted, so they are taken of the sums.
    used = use.groupBy(F.col("t").alias("id"), "none", "lo", "hi").agg(F.sum("m").alias("n"))
    # A concept is left if a user has none, or the least or greatest of the users' is another.
    outside = F.col("none") | (F.col("lo") != F.col("concept")) | (F.col("hi") != F.col("concept"))
    into = used.join(of, "id", "left").groupBy("id").agg(F.sum("n").alias("fan_in"), F.bool_or(F.col("concept").isNotNull() & F.coalesce(outside, F.lit(False))).alias("entry"))
    own = nodes.join(top.filter("id = anchor").select("id"), "id", "left_semi").join(of, "id").join(into, "id", "left")
    w = Window.partitionBy("concept").orderBy(F.desc(F.coalesce("fan_in", F.lit(0))), "name", "id")
    return own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("concept", "id", "name", "path", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("entry", F.lit(False)).alias("entry"), "rank")


def shared_traits(nodes: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept, id, name, others): interfaces implemented in a concept and outside it, with the names of the
    first implementers outside."""
    top = anchors(nodes, edges)
    impl = edges.filter("kind = 'implements'").join(top.select(F.col("id").alias("from_id"), "anchor"), "from_id").filter("anchor <> to_id").select(F.col("to_id").alias("id"), F.col("anchor").alias("impl")).distinct()
    of = nodes.select(F.col("id").alias("impl"), F.col("name").alias("impl_name"), "path").join(concepts.select(F.col("name").alias("concept"), "path"), "path", "left").select("impl", "impl_name", "concept")
    placed = impl.join(of, "impl", "left")
    inside = placed.filter("concept is not null").select("id", "concept").distinct()
    other = inside.join(placed.select("id", F.col("concept").alias("oc"), "impl_name"), "id").filter("impl_name is not null and not (oc <=> concept)")
    names = other.groupBy("concept", "id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("impl_name")), 1, MAX_IMPLEMENTERS), ", ").alias("others"))
    return names.join(nodes.select("id", "name"), "id").select("concept", "id", "name", "others")


def render_cards(cards: DataFrame) -> DataFrame:
    """(name, card): text cards within MAX_BYTES and MAX_LINES, made shorter by leaving out traits and landmarks
    from the end. cards: (name, package, description, landmarks array<string>, traits array<string>)."""

    def text(r, marks: list[str], traits: list[str]) -> str:
        lines = ["---", f"name: {r.name_}", f"description: {r.description or r.package}", "---", "", f"# {r.name_} ({r.package})"]
        if marks:
            lines += ["", "Landmarks:", *(f"- {m}" for m in marks)]
        if traits:
            lines += ["", "Traits shared with other concepts:", *(f"- {t}" for t in traits)]
        return "\n".join(lines) + "\n"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = []
            for r in g.rename(columns={"name": "name_"}).itertuples():
                marks, traits = list(r.landmarks), list(r.traits)
                while True:
                    card = text(r, marks, traits)
                    fits = len(card.encode()) <= MAX_BYTES and card.count("\n") <= MAX_LINES
                    if fits or (len(marks) <= 1 and not traits):
                        break
                    if len(traits) > 3 or traits and len(marks) <= 5:
                        traits = traits[:3] if len(traits) > 3 else traits[:-1]
                    else:
                        marks = marks[:5] if len(marks) > 5 else marks[:-1]
                out.append((r.name_, card))
            yield pd.DataFrame(out, columns=["name", "card"])

    return cards.mapInPandas(run, "name string, card string")


def context_within(parts: DataFrame, budget: int) -> DataFrame:
    """(target, kind, ord, text) of what fits a byte budget: the body always, then call sites (those too long are
    passed over), callees (up to the first too long) and skills (the last one cut). parts: (target, kind,
    ord, text) with kinds body, call_site, callee, skill."""
    rank = F.when(F.col("kind") == "body", 0).when(F.col("kind") == "call_site", 1).when(F.col("kind") == "callee", 2).otherwise(3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Targets follow each other in a task, one behind the other in batches, and a target's parts are in order; what is
        # known of the last target goes on into the next batch.
        at, used, closed = object(), 0, False
        for b in batches:
            keep, texts = [], []
            for i, (target, kind, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("target", "kind", "text")))):
                if target != at:
                    at, used, closed = target, 0, False
                data = text.encode()
                n = len(data)
                if kind == "call_site":
                    if used >= budget or used + n > budget:
                        continue
                elif kind == "callee":
                    if closed or used + n > budget:
                        closed = True
                        continue
                elif kind != "body":
                    if used >= budget:
                        continue
                    if n > budget - used:
                        text = data[: budget - used].decode(errors="ignore")
                        n = len(text.encode())
                used += n
                keep.append(i)
                texts.append(text)
            left = b.select(["target", "kind", "ord"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(texts, pa.string())], ["target", "kind", "ord", "text"])

    rows = parts.select("target", "kind", F.col("ord").cast("int").alias("ord"), "text", rank.alias("k"))
    dealt = rows.repartition("target").sortWithinPartitions("target", "k", "ord", "text")
    return dealt.select("target", "kind", "ord", "text").mapInArrow(run, "target string, kind string, ord int, text string")
