"""Trie of conversation prefixes, summed up by a van Emde Boas recursion.

A conversation is its turns in order; each distinct run of first turns is a node, named by the
smallest conversation that starts with it (together with its depth that is unique).

**Names of cut prefixes.** A prefix is told apart by two 64-bit sums (exclusive or) over its turns'
digests and places, which are running totals within a conversation, so any cut has its name
without walking down from the root; equal names are one group, whose smallest conversation
becomes the node's name.

**Recursion.** Levels 1 to D are cut at half depth into an upper trie and, below each node at the cut,
a lower forest; each of these again, down to single levels. Tries of one size do not depend on each
other, so a round solves all of them at once, the smallest first: after the round for size 2s
every node knows the totals of its subtree as far as its trie of 2s levels reaches. To graft, the
trees of a lower forest, which are complete, send their totals to all nodes above them in the
upper trie; a tree finds them on the path of the conversation that names it. There are log2(D) rounds, and a node sends
once at all, in the round whose cut it stands below. A round has at most one row for every turn.

Rows are turns, not conversations: no row or group holds a whole conversation, and one with a third
of all turns spans many tasks. A trie's counts are combined before they are shuffled.

Defined cases: a null role or text is empty; a null turn number comes first; turns of one
number stand in the order of their digests (equal ones may be swapped unseen); rows without a
conv_id belong to no conversation; negative ids are like others, ``%`` having the sign of the
id; a conversation whose rebuilt form has no turn counts in the root; an empty table has no root and gives an
empty result; other columns are not read. A text is read once, for its digest and size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowguard.llm.common import cut
from flowguard.operators.blocks import in_blocks, running

#: Ids that are joined to one string at a time.
CHUNK = 20_000
EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, a, b, size): turns by place from 0, two digests, and bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"),
        F.octet_length(text).cast("long").alias("size"))
    order = ["turn", "a", "b"]
    placed = running(in_blocks(turns, ["conv_id"], order), ["conv_id"], order,
                     {"i": ("sum", F.lit(1).cast("long"))})
    return cut(placed.select("conv_id", (F.col("i") - 1).alias("i"), "a", "b", "size"))


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations unchanged: turns with their conversation's length, and (conv_id, len)."""
    lengths = cut(turns.groupBy("conv_id").agg(F.count("*").alias("len")))
    return turns.join(lengths, "conv_id"), lengths


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``h`` turns are replaced by those of conversation c - c % 5.

    ``h`` is crc32 of the decimal id, modulo 9; all turns of the other are taken if it has fewer,
    none if it doesn't exist.
    """
    def head(c):
        return F.crc32(c.cast("string").cast("binary")) % 9

    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % 5
    known = cut(sizes.select("conv_id", "n", head(F.col("conv_id")).alias("h"), base.alias("base")))
    heads = known.select(F.col("conv_id").alias("_base"), F.col("n").alias("_n"))
    convs = cut(known.join(heads, F.col("base") == F.col("_base"), "left").select(
        "conv_id", "base", F.least("h", F.coalesce("_n", F.lit(0))).alias("taken"),
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
        .withColumn("len", F.col("taken") + F.col("own")))
    i = F.col("i")
    own = (turns.where(i >= head(F.col("conv_id")))
           .join(convs.select("conv_id", "taken", "len"), "conv_id")
           .select("conv_id", (i - head(F.col("conv_id")) + F.col("taken")).alias("i"), "a", "b",
                   "size", "len"))
    first = turns.where((i < 8) & (F.col("conv_id") % 5 == 0)).withColumnRenamed("conv_id", "base")
    taken = (first.join(convs.where("taken > 0"), "base").where(i < F.col("taken"))
             .select("conv_id", "i", "a", "b", "size", "len"))
    return own.unionAll(taken), convs.select("conv_id", "len")


def digests_of_ids(ends: DataFrame) -> DataFrame:
    """(node, level, ends_sha256) of rows (node, level, conv_id): SHA-256 of the sorted ids.

    Ids are dealt out by range, so a node's ids may fill many tasks; each makes strings of up to
    ``CHUNK`` of them. The strings of a node then stream through the hash in one task, which keeps one
    at a time.
    """
    def join_ids(batches):
        node, ids = None, []

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64()) for v in (*node, ids[0])]
                + [pa.array([",".join(map(str, ids))])], ["node", "level", "first", "part"])
        for batch in batches:
            out = []
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (key != node or len(ids) == CHUNK):
                    out.append(row())
                    ids = []
                node = key
                ids.append(conv)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if ids:
            yield row()

    def digest(batches):
        node, state = None, None

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0][k] for r in rows], pa.int64()) for k in (0, 1)]
                + [pa.array([r[1] for r in rows])], ["node", "level", "ends_sha256"])
        for batch in batches:
            out = []
            for n, level, _, part in zip(*(c.to_pylist() for c in batch.columns)):
                if node == (n, level):
                    state.update(b"," + part.encode())
                else:
                    if node:
                        out.append((node, state.hexdigest()))
                    node, state = (n, level), hashlib.sha256(part.encode())
            if out:
                yield batch_of(out)
        if node:
            yield batch_of([(node, state.hexdigest())])

    parts = (ends.repartitionByRange("node", "level", "conv_id")
             .sortWithinPartitions("node", "level", "conv_id")
             .mapInArrow(join_ids, "node long, level long, first long, part string"))
    return (parts.repartition("node", "level").sortWithinPartitions("node", "level", "first")
            .mapInArrow(digest, "node long, level long, ends_sha256 string"))


def grafted(own: DataFrame, walk: DataFrame, depth: int) -> DataFrame:
    """Rows (node, level, leaves, saved) that add up to each node's totals without its own.

    ``own`` has (node, level, leaves, saved) of the nodes, levels from 0; ``walk`` has
    (conv_id, level, node, len) of every turn of every conversation.
    """
    rounds = []
    half = 1
    while half < depth:
        whole = 2 * half
        below_cut = F.col("level") % whole == half
        roots = own.where(below_cut)
        for earlier in rounds:
            roots = roots.unionAll(earlier.where(below_cut))
        roots = roots.groupBy("node", "level").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select(
            F.col("node").alias("_conv"), F.floor(F.col("level") / whole).alias("_trie"),
            "leaves", "saved")
        trie = F.floor(F.col("level") / whole)
        above_cut = walk.where((F.col("level") % whole < half)
                               & (trie * whole + half < F.col("len")))
        rounds.append(cut(above_cut.join(
            roots, (F.col("conv_id") == F.col("_conv")) & (trie == F.col("_trie")))
            .groupBy("node", "level").agg(F.sum("leaves").alias("leaves"),
                                          F.sum("saved").alias("saved"))))
        half = whole
    out = own.limit(0)
    for part in rounds:
        out = out.unionAll(part)
    return out


def prefix_trie(conversations: DataFrame, rebuild: Callable = as_they_are) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (here bytes), ends_sha256.

    ``rebuild`` turns ordered turns into those of the conversations to be compared and gives
    their lengths: :func:`as_they_are` or :func:`with_shared_heads`.
    """
    turns, lengths = rebuild(ordered_turns(conversations))
    order = ["i", "a", "b"]
    digest = {"p": ("xor", F.xxhash64("i", "a", "b")), "q": ("xor", F.xxhash64("b", "i", "a"))}
    paths = running(in_blocks(turns, ["conv_id"], order), ["conv_id"], order, digest).select(
        "conv_id", F.col("i").alias("level"), "p", "q", "size", "len")
    paths = cut(paths)
    nodes = cut(paths.groupBy("level", "p", "q").agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("size").alias("size"),
        F.max("len").alias("longest")))
    walk = cut(paths.select("conv_id", "level", "p", "q", "len")
               .join(nodes.select("level", "p", "q", "node").hint("merge"), ["level", "p", "q"])
               .select("conv_id", "level", "node", "len"))

    totals = lengths.agg(F.min("conv_id").alias("root"), F.count("*").alias("n"),
                         F.max("len").alias("depth")).first()
    if not totals["n"]:
        return _result(conversations.sparkSession.createDataFrame(
            [], "node long, level long, parent long, n_convs long, n_children long, "
                "leaves long, saved long, ends_sha256 string"))
    root = F.lit(totals["root"]).cast("long")
    own = nodes.select(
        "node", "level", F.when(F.col("longest") == F.col("level") + 1, 1).otherwise(0).cast("long")
        .alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")

    # The node above each node stands on the path of the conversation that names it.
    above = walk.select(F.col("conv_id").alias("_conv"), (F.col("level") + 1).alias("_level"),
                        F.col("node").alias("parent"))
    deeper = nodes.where("level > 0").select("node", "level")
    parents = cut(deeper.join(above, (F.col("node") == F.col("_conv"))
                              & (F.col("level") == F.col("_level")))
                  .select("node", "level", "parent"))
    children = parents.groupBy(F.col("parent").alias("node"), (F.col("level") - 1).alias("level")) \
        .agg(F.count("*").alias("n_children"))

    columns = ["node", "level", "parent", "n_convs", "n_children", "leaves", "saved"]

    def rows(df):
        return df.select(*[F.col(c) if c in df.columns else none.alias(c) for c in columns])

    # A level above the first turns: the root, which has the totals of all nodes.
    top = own.agg(
        F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).alias("n_children"),
        F.coalesce(F.sum("leaves"), F.lit(1)).alias("leaves"), F.sum("saved").alias("saved")).select(
        root.alias("node"), F.lit(-1).cast("long").alias("level"), none.alias("parent"),
        F.lit(totals["n"]).cast("long").alias("n_convs"), "n_children", "leaves", "saved")
    parts = [
        rows(nodes.select("node", "level", "n_convs")), rows(own), rows(parents), rows(children),
        rows(nodes.where("level = 0").select("node", "level", root.alias("parent"))),
        rows(grafted(own, walk, totals["depth"] or 0)), rows(top)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    summed = every.groupBy("node", "level").agg(
        F.max("parent").alias("parent"), F.max("n_convs").alias("n_convs"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("n_children", "leaves", "saved")])

    ends = (walk.where("level = len - 1").select("node", "level", "conv_id")
            .unionAll(lengths.where("len = 0").select(
                root.alias("node"), F.lit(-1).cast("long").alias("level"), "conv_id")))
    return _result(summed.join(digests_of_ids(cut(ends)), ["node", "level"], "left"))


def _result(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("node").alias("conv_id"), (F.col("level") + 1).alias("depth"),
        F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
