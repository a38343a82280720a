"""Call trees: depth-first walks with one visited set a tree, for many entries at once.

A node's label is its path in the tree, the ids from the entry down; depth-first order is the order of labels. A node
belongs to its least label, so labels are found in rounds: a node offers its callees its label with theirs behind, those
that have a lesser one already are visited, of the others the first `fan_out` get the offer, and a callee takes the
least offer. An offer is greater than the label that it extends, so from the least label on, each round settles more,
and when a round changes nothing the labels are those of the walk, one after the other.

Where depth and fan-out bound a tree to few nodes, an entry's tree is walked in one row instead. A node in a tree of at
most T nodes looks at T + 1 callees at most, as it takes those that are not in the tree until it has enough, so its list
of callees has a bound too. Lists are fetched in rounds: the walk with the lists that are known tells which others it
comes to, and an entry whose walk lacks none is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import directory
from ..storage import materialize
from .closures import own_methods
from .order import numbered, placed

#: Trees that depth and fan-out keep to so many nodes are walked in a row each.
TREE_NODES = 200
#: Lists that are known to one that is asked for, from which entries that are done are left out by a join.
MOST = 4
HOPS = "entry string, hop int, parent_hop int, depth int, id string, crosses boolean, dispatch string, truncated boolean"


def _calls(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, callee) of calls to known nodes, and (callee, dispatch) of the methods of interfaces: the implementers'
    methods of that name, comma-joined."""
    pairs = edges.filter("kind = 'calls'").select(F.col("from_id").alias("id"), F.col("to_id").alias("callee")).distinct().join(nodes.select(F.col("id").alias("callee")), "callee", "left_semi")
    methods = own_methods(nodes, edges)
    implemented = edges.filter("kind = 'implements'").select(F.col("to_id").alias("owner"), F.col("from_id").alias("impl")).distinct()
    abstract = methods.join(implemented.select("owner").distinct(), "owner")
    concrete = implemented.join(methods.select(F.col("owner").alias("impl"), F.col("method").alias("m"), "simple"), "impl").groupBy("owner", "impl", "simple").agg(F.min("m").alias("m"))
    dispatch = abstract.join(concrete, ["owner", "simple"], "left").groupBy(F.col("method").alias("callee")).agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("dispatch"))
    return pairs, dispatch


def _lists(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(id, callees, crossing) of nodes that call known nodes: the first of these in the order of their ids, and whether
    they lie in another folder."""
    folder = nodes.select("id", directory(F.coalesce("path", F.lit(""))).alias("dir"))
    pairs = edges.filter("kind = 'calls'").select(F.col("from_id").alias("id"), F.col("to_id").alias("callee"))
    known = pairs.join(folder.select(F.col("id").alias("callee"), F.col("dir").alias("callee_dir")), "callee")
    # Parallel edges share a rank.
    first = known.withColumn("k", F.dense_rank().over(Window.partitionBy("id").orderBy("callee"))).filter(F.col("k") <= limit)
    of = first.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("callee", "callee_dir"))).alias("x")).join(folder, "id", "left")
    return of.select("id", F.col("x.callee").alias("callees"), F.transform("x", lambda x: F.coalesce(x["callee_dir"] != F.col("dir"), F.lit(False))).alias("crossing"))


def _walk(entry: str, lists: dict[str, tuple[list[str], list[bool]]], depth: int, fan_out: int) -> tuple[list[tuple], bool]:
    """Hops (parent_hop, depth, id, crosses, open) of a tree in order, open where a list is lacking, and whether some
    callees were left out."""
    hops, seen, cut = [(-1, 0, entry, False, entry not in lists)], {entry}, False
    todo = [(0, 0, iter(zip(*lists.get(entry, ((), ())))), 0)] if depth else []
    while todo:
        hop, d, callees, taken = todo.pop()
        for callee, crosses in callees:
            if callee in seen:
                continue
            if taken == fan_out:
                cut = True
                break
            seen.add(callee)
            follow = d + 1 < depth
            hops.append((hop, d + 1, callee, crosses, follow and callee not in lists))
            todo.append((hop, d, callees, taken + 1))
            if follow:
                todo.append((len(hops) - 1, d + 1, iter(zip(*lists.get(callee, ((), ())))), 0))
            break
    return hops, cut


def _by_rows(lists: DataFrame, leaves: DataFrame, entries: DataFrame, depth: int, fan_out: int) -> DataFrame:
    """(entry, hop, parent_hop, depth, id, crosses, truncated), each entry's tree walked in a row. leaves: (id) of
    nodes that are not followed unless they are the entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(9)]
            for entry, ids, callees, crossing in zip(*(b.column(c).to_pylist() for c in ("entry", "ids", "callees", "crossing"))):
                hops, cut = _walk(entry, dict(zip(ids, zip(callees, crossing))), depth, fan_out)
                settled = not any(h[4] for h in hops)
                for k, h in enumerate(hops):
                    for column, x in zip(out, (entry, k, *h, cut, settled)):
                        column.append(x)
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.bool_()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["entry", "hop", "parent_hop", "depth", "id", "crosses", "open", "truncated", "settled"])

    def fetch(wanted: DataFrame, lists: DataFrame) -> DataFrame:
        none = F.array().cast("array<string>"), F.array().cast("array<boolean>")
        return materialize(wanted.join(lists, "id", "left").select("entry", "id", F.coalesce("callees", none[0]).alias("callees"), F.coalesce("crossing", none[1]).alias("crossing")), "flow-known")

    followed = lists.join(leaves, "id", "left_anti")
    known, done = fetch(entries.select(F.col("id").alias("entry"), "id").distinct(), lists), None
    named = (("id", "ids"), ("callees", "callees"), ("crossing", "crossing"))
    while True:
        # An entry has one row at first. From then on, one that has no new list is done.
        rows = known.select("entry", *(F.array(c).alias(n) for c, n in named)) if done is None else known.groupBy("entry").agg(F.max("new").alias("new"), *(F.collect_list(c).alias(n) for c, n in named)).filter("new").drop("new")
        walked = materialize(rows.mapInArrow(run, "entry string, hop int, parent_hop int, depth int, id string, crosses boolean, open boolean, truncated boolean, settled boolean"), "flow-walked")
        one = walked.filter("settled").drop("open", "settled")
        done = one if done is None else done.unionByName(one)
        # Written, so that few of them meet the lists by a broadcast.
        wanted = materialize(walked.filter("open").select("entry", "id"), "flow-wanted")
        many = wanted.count()
        if not many:
            return done
        # A list that is fetched is known from then on, so each round settles more of an entry's walk. The lists move
        # to their entry once: those of entries that are done stay behind only where most are.
        had = known.drop("new").join(wanted, "entry", "left_semi") if MOST * many < known.count() else known.drop("new")
        known = had.withColumn("new", F.lit(False)).unionByName(fetch(wanted, followed).withColumn("new", F.lit(True)))


def call_trees(nodes: DataFrame, edges: DataFrame, entries: DataFrame, depth: int = 5, fan_out: int = 10) -> DataFrame:
    """(entry, hop, parent_hop, depth, id, crosses, dispatch, truncated): hops of each entry's (id) tree in
    order; hop 0 is the entry.

    Callees come in the order of their ids, each node once in a tree. crosses: another folder than the
    caller's. A method of an interface is not followed; dispatch lists the implementers' methods of its name.
    fan_out: followed callees of a node (0: all); truncated: the tree left some out.
    """
    pairs, dispatch = _calls(nodes, edges)
    dispatch = materialize(dispatch, "flow-calls")
    size = sum(fan_out**k for k in range(depth + 1)) if fan_out else None
    if size and size <= TREE_NODES:
        lists = materialize(_lists(nodes, edges, size + 1), "flow-lists")
        out = _by_rows(lists, dispatch.select(F.col("callee").alias("id")), entries, depth, fan_out)
        text = F.when(F.col("hop") == 0, "").otherwise(F.coalesce("dispatch", F.lit("")))
        return out.join(dispatch.withColumnRenamed("callee", "id"), "id", "left").select("entry", "hop", "parent_hop", "depth", "id", "crosses", text.alias("dispatch"), "truncated")
    pairs = materialize(pairs, "flow-calls")
    # leaf: a method of an interface. An entry is followed even if it is one.
    steps = materialize(pairs.join(dispatch.select("callee", F.lit(True).alias("leaf")), "callee", "left").select("id", "callee", F.coalesce("leaf", F.lit(False)).alias("leaf")), "flow-steps")
    roots = materialize(entries.select(F.col("id").alias("entry"), "id", F.array("id").alias("label"), F.lit(False).alias("leaf")).distinct(), "flow-labels")
    labels = roots

    def offers(labels: DataFrame) -> DataFrame:
        """(entry, callee, leaf, offer, k): what each node that is followed offers to callees that aren't visited
        before, by number."""
        open_ = labels.filter(~F.col("leaf") & (F.size("label") <= depth)).select("entry", "id", "label")
        have = labels.select("entry", F.col("id").alias("callee"), F.col("label").alias("own"))
        made = open_.join(steps, "id").withColumn("offer", F.concat("label", F.array("callee"))).join(have, ["entry", "callee"], "left")
        free = made.filter(F.col("own").isNull() | (F.col("own") >= F.col("offer")))
        # A node's callees stand side by side: as many as it has.
        return free.withColumn("k", F.row_number().over(Window.partitionBy("entry", "id").orderBy("callee")))

    while True:
        made = offers(labels)
        taken = made.filter(F.col("k") <= fan_out) if fan_out else made
        least = taken.groupBy("entry", F.col("callee").alias("id")).agg(F.min("offer").alias("label"), F.first("leaf").alias("leaf"))
        now = materialize(least.join(roots.select("entry", "id"), ["entry", "id"], "left_anti").unionByName(roots), "flow-labels")
        changed = not now.join(labels, ["entry", "id", "label"], "left_anti").isEmpty() or now.count() != labels.count()
        labels = now
        if not changed:
            break
    cut = offers(labels).filter(F.col("k") > fan_out).select("entry").distinct().withColumn("cut", F.lit(True)) if fan_out else roots.select("entry", F.lit(True).alias("cut")).limit(0)
    hops = materialize(numbered(placed(labels.select("entry", "id", "label"), ["entry", "label"], "flow-order"), ["entry"]).select("entry", "id", "label", F.col("n").cast("int").alias("hop")), "flow-hops")
    folder = nodes.select("id", directory(F.coalesce("path", F.lit(""))).alias("dir"))
    above = hops.select("entry", F.col("id").alias("caller"), F.col("hop").alias("parent_hop")).join(folder.select(F.col("id").alias("caller"), F.col("dir").alias("caller_dir")), "caller", "left")
    told = hops.withColumn("caller", F.when(F.size("label") > 1, F.element_at("label", F.greatest(F.size("label") - 1, F.lit(1)))))
    out = told.join(above, ["entry", "caller"], "left").join(folder, "id", "left").join(dispatch.withColumnRenamed("callee", "id"), "id", "left").join(cut, "entry", "left")
    root = F.size("label") == 1
    return out.select(
        "entry", "hop", F.when(root, -1).otherwise(F.col("parent_hop")).alias("parent_hop"), (F.size("label") - 1).alias("depth"), "id",
        F.coalesce(~root & (F.col("dir") != F.col("caller_dir")), F.lit(False)).alias("crosses"), F.when(root, "").otherwise(F.coalesce("dispatch", F.lit(""))).alias("dispatch"), F.coalesce("cut", F.lit(False)).alias("truncated"),
    )
