"""Prefix trie of conversations: which conversations begin alike, and what a cache of prefixes would save.

A node is a distinct sequence of first turns. Its owner is the least conversation that begins with it. A conversation
that owns a prefix owns all its longer ones too, so what a conversation owns is a chain from its first owned depth to
its end; that depth is found by binary search, in rounds that probe one depth of every conversation at once. The
chains form a tree by where they branch off, over which totals are summed bottom-up in rounds that double the
distance. Nothing is ordered or summed by one task for a whole conversation: turns are numbered after a range
partitioning, and running values go by segments of SEGMENT turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize

#: Turns of one conversation whose running values one task computes.
SEGMENT = 4096
#: monotonically_increasing_id counts rows of a partition in so many low bits.
ROW_BITS = 33
NO_ENDS = hashlib.sha256(b"").hexdigest()


def order_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, i, k1, k2, chars), written: the turns of each conversation by number from 1, each as a digest of 128
    bits of its role and text, and the code points of its text.

    Null turns come first, ties go by role and text; null roles and texts are empty; rows without a conversation take
    no part; repeated rows stay. A conversation of any length is spread over the partitions of the order.
    """
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    digest = [F.xxhash64(F.lit(salt), "role", "text").alias(k) for k, salt in (("k1", "one"), ("k2", "two"))]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id().alias("at")
    placed = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", *digest, F.length("text").cast("long").alias("chars"), at), "trie-order")
    part = F.shiftright("at", ROW_BITS).alias("part")
    parts = placed.groupBy("conv_id", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    out = materialize(placed.withColumn("part", part).join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("i"), "k1", "k2", "chars"), "trie-turns")
    discard(placed)
    return out


def share_heads(numbered: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, k1, k2, chars) and (conv_id, length): conversation c rebuilt as the first h turns of
    conversation c - c % every (none, if there is no such one), then its own turns after its first h; h is the
    unsigned crc32 of c as decimal text, modulo `most`. A conversation may end up without turns.

    A head has fewer than `most` turns, and a conversation lends its head to at most 2 * every others.
    """
    lengths = numbered.groupBy("conv_id").agg(F.max("i").alias("own"))
    c = F.col("conv_id")
    convs = lengths.select("conv_id", "own", (c - c % every).alias("lender"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    convs = convs.join(lengths.select(F.col("conv_id").alias("lender"), F.col("own").alias("lent")), "lender", "left")
    convs = convs.select("conv_id", "lender", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("head"), F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("tail"))
    convs = materialize(convs, "trie-heads")
    heads = numbered.filter((F.col("i") < most) & (c % every == 0)).withColumnRenamed("conv_id", "lender")
    heads = convs.select("conv_id", "lender", "head").join(heads, "lender").filter("i <= head").select("conv_id", F.col("i").alias("depth"), "k1", "k2", "chars")
    tails = numbered.join(convs.select("conv_id", "h", "head"), "conv_id").filter("i > h").select("conv_id", (F.col("i") - F.col("h") + F.col("head")).alias("depth"), "k1", "k2", "chars")
    return heads.unionByName(tails), convs.select("conv_id", (F.col("head") + F.col("tail")).alias("length"))


def _running(rows: DataFrame, key: str, values: dict[str, tuple[str, Column]], backwards: bool = False) -> DataFrame:
    """rows with running aggregates (sum or bit_xor) of columns along `depth` of each key, from the first depth or
    from the last. A task orders a segment of a key; what lies before a segment is aggregated by segments."""
    step = -1 if backwards else 1
    rows = rows.withColumn("segment", F.floor(F.col("depth") / SEGMENT) * step)
    agg = {"sum": F.sum, "xor": F.bit_xor}
    within = Window.partitionBy(key, "segment").orderBy(F.col("depth") * step).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "segment").agg(*(agg[kind](v).alias(f"{name}_t") for name, (kind, v) in values.items()))
    carry = totals.select(key, "segment", *(agg[kind](f"{name}_t").over(earlier).alias(f"{name}_c") for name, (kind, _) in values.items()))
    carry = carry.filter(" or ".join(f"{name}_c is not null" for name in values))
    out = rows.withColumns({name: agg[kind](v).over(within) for name, (kind, v) in values.items()}).join(carry, [key, "segment"], "left")
    both = {name: F.col(name) + F.coalesce(f"{name}_c", F.lit(0)) if kind == "sum" else F.col(name).bitwiseXOR(F.coalesce(f"{name}_c", F.lit(0))) for name, (kind, _) in values.items()}
    return out.withColumns(both).drop("segment", *(f"{name}_c" for name in values))


def prefix_digests(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, g1, g2, chars): the digest of each conversation's first `depth` turns, the exclusive or of
    128-bit digests of (position, turn): equal prefixes have equal digests, others by a chance of 2^-128."""
    terms = {g: ("xor", F.xxhash64(F.lit(g), "depth", "k1", "k2")) for g in ("g1", "g2")}
    return _running(rebuilt, "conv_id", terms).select("conv_id", "depth", "g1", "g2", "chars")


def first_owned(prefixes: DataFrame, owners: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, length, first): the least depth whose prefix has no lesser conversation; length + 1 if there is none.

    Binary search: a round looks up one prefix of each open conversation, and the least conversation of its digest.
    """
    settled, rest = None, materialize(lengths.select("conv_id", "length", F.lit(0).cast("long").alias("low"), (F.col("length") + 1).alias("high")), "trie-search")
    while True:
        done = rest.filter("low = high").select("conv_id", "length", F.col("low").alias("first"))
        settled = done if settled is None else settled.unionByName(done)
        left = rest.filter("low < high").withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2).cast("long"))
        if left.isEmpty():
            return materialize(settled, "trie-first")
        probes = left.join(prefixes.select("conv_id", "depth", "g1", "g2"), ["conv_id", "depth"]).join(owners.select("depth", "g1", "g2", "owner"), ["depth", "g1", "g2"])
        mine = F.col("owner") == F.col("conv_id")
        rest = materialize(probes.select("conv_id", "length", F.when(mine, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(mine, F.col("depth")).otherwise(F.col("high")).alias("high")), "trie-search")


def _sums_below(chains: DataFrame) -> DataFrame:
    """(chain, leaves, saved): sums over each chain and all chains that hang below it. Round k adds the sums of the
    chains 2^k steps below, which cover the steps from there to 2^(k+1) - 1."""
    chains = materialize(chains.select("chain", "up", "leaves", "saved"), "trie-sums")
    while not chains.filter("up is not null").isEmpty():
        below = chains.filter("up is not null").groupBy(F.col("up").alias("chain")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = chains.select(F.col("chain").alias("up"), F.col("up").alias("next"))
        out = chains.join(below, "chain", "left").join(above, "up", "left")
        before, chains = chains, materialize(out.select("chain", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "trie-sums")
        discard(before)
    return chains.select("chain", "leaves", "saved")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, comma-joined. Rows come sorted by node and id; one state is held."""
    key, state, out = None, None, []

    def close() -> None:
        if key is not None:
            out.append((*key, state.hexdigest()))

    for b in batches:
        for d, g1, g2, i in zip(*(b.column(c).to_pylist() for c in ("depth", "g1", "g2", "conv_id"))):
            if (d, g1, g2) == key:
                state.update(b",%d" % i)
            else:
                close()
                key, state = (d, g1, g2), hashlib.sha256(b"%d" % i)
        if len(out) > 8192:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "g1", "g2", "ends_sha256"])
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "g1", "g2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, g1, g2, ends_sha256) from (conv_id, depth, g1, g2). A hash over a node's ids is sequential, so the ids
    of a node stream through one task in their order (Spark's sort spills); none are held."""
    keys = ["depth", "g1", "g2"]
    return ends.repartition(*keys).sortWithinPartitions(*keys, "conv_id").mapInArrow(_ends, "depth long, g1 long, g2 long, ends_sha256 string")


def build_trie(rebuilt: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    rebuilt: (conv_id, depth, k1, k2, chars), depths from 1 without gaps; lengths: (conv_id, length) of all
    conversations, those without turns too: these are members of the root alone. A node is named by its least member
    and its depth; the root has depth 0 and no parent. n_leaves counts childless nodes from the node down;
    saved_tokens sums (members - 1) * code points of the last turn from the node down; ends_sha256 is over the members
    of no more turns, ascending, comma-joined. Without conversations there are no nodes.
    """
    zero = F.lit(0).cast("long")
    lengths = materialize(lengths, "trie-lengths")
    roots = lengths.select("conv_id", zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), zero.alias("chars"))
    prefixes = materialize(prefix_digests(rebuilt).unionByName(roots), "trie-prefixes")
    keys = ["depth", "g1", "g2"]
    nodes = materialize(prefixes.groupBy(keys).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")), "trie-nodes")
    found = first_owned(prefixes, nodes, lengths)
    ends = end_digests(found.select("conv_id", F.col("length").alias("depth")).join(prefixes.select("conv_id", *keys), ["conv_id", "depth"]))

    # A chain hangs at the node above its first one, which a lesser conversation owns.
    tops = found.filter("first <= length").select(F.col("conv_id").alias("chain"), "length", "first")
    hooks = tops.filter("first > 0").select("chain", (F.col("first") - 1).alias("depth")).join(prefixes.select(F.col("conv_id").alias("chain"), *keys), ["chain", "depth"])
    hooks = hooks.join(nodes.select(*keys, F.col("owner").alias("up")), keys).select("chain", "up", F.col("depth").alias("hook"))
    tops = materialize(tops.join(hooks, "chain", "left"), "trie-chains")
    branched = tops.filter("up is not null").groupBy(F.col("up").alias("chain"), F.col("hook").alias("depth")).agg(F.count("*").alias("branches"))
    own = nodes.groupBy(F.col("owner").alias("chain")).agg(F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    at_end = branched.select("chain", F.col("depth").alias("length"), F.lit(1).alias("goes_on"))
    single = tops.join(at_end, ["chain", "length"], "left").join(own, "chain").select("chain", "up", F.when(F.col("goes_on").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved", "goes_on")
    sums = _sums_below(single)

    hung = tops.filter("up is not null").join(sums, "chain").groupBy(F.col("up").alias("owner"), F.col("hook").alias("depth")).agg(F.count("*").alias("branches"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    chain = tops.select(F.col("chain").alias("owner"), "length", "first", "up")
    full = nodes.join(chain, "owner").join(hung, ["owner", "depth"], "left").na.fill(0, ["branches", "l", "s"])
    ending = (F.col("depth") == F.col("length")) & (F.col("branches") == 0)
    full = full.withColumns({"n_children": F.col("branches") + F.when(F.col("depth") < F.col("length"), 1).otherwise(0), "l": F.col("l") + F.when(ending, 1).otherwise(0), "s": F.col("s") + (F.col("n_convs") - 1) * F.col("chars")})
    summed = _running(full, "owner", {"n_leaves": ("sum", F.col("l")), "saved_tokens": ("sum", F.col("s"))}, backwards=True)
    parent = F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("up"))
    out = summed.join(ends, keys, "left")
    return out.select(F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
