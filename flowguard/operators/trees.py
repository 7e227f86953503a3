"""Random forest of two classes: large nodes by counts over all rows, the rest in tasks that hold its rows.

1. Features become bins, bounded by quantiles of all rows. Rows are packed once into blocks of one
   byte a feature.
2. Every tree draws each row as often as a Poisson number says, again the same on each pass. One pass a
   level counts the drawn rows of all large nodes by (feature, bin, label); Spark adds the counts up
   and splits are chosen in tasks. Large is a node with more than a share of all rows, so there is a bounded
   number of them, whatever the table's size.
3. Smaller nodes that are still mixed get their rows in one shuffle, and each is grown to its end in a task.

A node looks at a random part of the features and takes the split with the largest fall of the Gini
impurity, counts being weighted by class. Leaves of one parent that tell the same label become one, as
in MLlib. The model, eleven bytes a node, is held by the driver and the
tasks. Counts are whole numbers, so no order of rows changes a tree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from flowguard.operators.vectors import columns_of, vector
from flowguard.session import materialised

#: Bins of a feature; rows of a block; nodes whose splits are looked for at a time.
BINS, BLOCK, AT_ONCE = 32, 65_536, 1024
#: Rows that are summed up at a time for quantiles, and points a summary has of each class at most.
SUMMED, POINTS = 131_072, 2048
#: Bytes of dealt rows that a task holds before it passes them on.
HELD = 16_000_000
#: A node is large from this share of the rows on, within these bounds.
SHARE, LEAST, MOST = 1 / 128, 20_000, 500_000
#: Random 16-bit numbers as Poisson numbers of mean 1.
DRAWS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)]),
                        (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


def points(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and rows each stands for: all values if few, else those at equal steps of rank, the last included."""
    values, n = np.unique(values, return_counts=True)
    if len(values) <= POINTS:
        return values, n
    upto = np.cumsum(n)
    at = np.unique(np.searchsorted(upto, upto[-1] * (np.arange(1, POINTS + 1) / POINTS) - 1e-6))
    return values[at], np.diff(upto[at], prepend=0)


def bin_edges(df: DataFrame, names, label: str, weights) -> list[np.ndarray]:
    """Per feature the upper bounds of all bins but the last: all values if few, else quantiles.

    Rows count by the weight of their class, as in MLlib. Tasks sum up the values of each class in points, those
    of a feature are then put together.
    """
    def summed(held):
        y, *columns = np.concatenate(held, axis=1)
        odd = not bool(np.isin(y, (0, 1)).all())
        for i, values in enumerate(columns):
            holes = np.isnan(values)
            for c in (0, 1):
                v, n = points(values[(y == c) & ~holes])
                yield i, odd, bool(holes.any()), c, v.tobytes(), n.astype(np.int64).tobytes()

    def summaries(batches):
        held, size = [], 0
        for batch in batches:
            held.append(columns_of(batch.column(0), len(names) + 1))
            size += batch.num_rows
            if size >= SUMMED:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*summed(held))], kinds)
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*summed(held))], kinds)

    def bounds(key, rows):
        values = [np.frombuffer(v) for v in rows.column("v").to_pylist()]
        n = [np.frombuffer(n, np.int64) * weights[c]
             for n, c in zip(rows.column("n").to_pylist(), rows.column("c").to_pylist())]
        values, place = np.unique(np.concatenate(values), return_inverse=True)
        if len(values) > BINS:
            whole = np.cumsum(np.bincount(place, np.concatenate(n)))
            at = np.searchsorted(whole, whole[-1:] * (np.arange(1, BINS) / BINS - 1e-9))
            values = np.unique(np.r_[values[at], values[-1:]])
        flags = [pa.array([bool(np.any(rows.column(f).to_pylist()))]) for f in ("odd", "holes")]
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()]), *flags, pa.array([values[:-1].tobytes()], pa.binary())],
            ["i", "odd", "holes", "edges"])

    kinds = ["i", "odd", "holes", "c", "v", "n"]
    cores = df.sparkSession.sparkContext.defaultParallelism
    found = (df.select(vector((label, *names))).coalesce(3 * cores).mapInArrow(
                 summaries, "i long, odd boolean, holes boolean, c long, v binary, n binary")
             .groupBy("i").applyInArrow(bounds, "i long, odd boolean, holes boolean, edges binary").collect())
    if not found:
        raise ValueError("no rows to fit on")
    if any(r["odd"] for r in found):
        raise ValueError("labels are 0 and 1")
    if any(r["holes"] for r in found):
        raise ValueError("null or NaN among the features")
    return [np.frombuffer(r["edges"]) for r in sorted(found, key=lambda r: r["i"])]


def binned(columns, edges) -> np.ndarray:
    """Bin numbers (row by feature) of features given column by column."""
    out = np.empty((len(columns[0]), len(edges)), np.uint8)
    for i, (values, bounds) in enumerate(zip(columns, edges)):
        if np.isnan(values).any():
            raise ValueError("null or NaN among the features")
        out[:, i] = np.searchsorted(bounds, values)
    return out


def packed_bins(df: DataFrame, names, label: str, edges) -> DataFrame:
    """Blocks of rows: number, bins row by row, labels."""
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            cols = columns_of(batch.column(0), len(names) + 1)
            if not np.isin(cols[0], (0, 1)).all():
                raise ValueError("labels are 0 and 1")
            y, x = cols[0].astype(np.uint8), binned(cols[1:], edges)
            for at in range(0, len(y), BLOCK):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), *[pa.array([a[at:at + BLOCK].tobytes()], pa.binary())
                                          for a in (x, y)]], ["block", "x", "y"])
                block += 1

    return df.select(vector((label, *names))).mapInArrow(run, "block long, x binary, y binary")


def drawn(seed: int, tree: int, block: int, rows: int) -> np.ndarray:
    """How often a tree draws each row of a block."""
    return DRAWS.take(np.random.default_rng((seed, tree, block)).integers(0, 65_536, rows, np.uint16))


#: What a pool holds of its nodes, and how.
NODE_PARTS = {"feature": np.int16, "cut": np.uint8, "left": np.int32, "depth": np.int16, "counts": np.int64}


class Nodes:
    """A growing pool of nodes. ``counts`` are the drawn rows of both labels; a leaf has feature -1."""

    def __init__(self, roots: np.ndarray):
        n = len(roots)
        self.feature, self.cut = np.full(n, -1, np.int16), np.zeros(n, np.uint8)
        self.left, self.depth = np.full(n, -1, np.int32), np.zeros(n, np.int16)
        self.counts = np.asarray(roots, np.int64).reshape(n, 2)

    def __len__(self):
        return len(self.feature)

    def split(self, at: np.ndarray, feature, cut, low: np.ndarray) -> np.ndarray:
        """Gives nodes two children each, the left one with counts ``low``; the children's numbers."""
        n, k = len(self), len(at)
        self.feature[at], self.cut[at], self.left[at] = feature, cut, n + 2 * np.arange(k)
        children = np.stack([low, self.counts[at] - low], axis=1).reshape(2 * k, 2)
        more = Nodes(children)
        more.depth[:] = np.repeat(self.depth[at] + 1, 2)
        self.append([more])
        return np.arange(n, n + 2 * k)

    def append(self, more: list) -> None:
        for name in NODE_PARTS:
            setattr(self, name, np.concatenate([getattr(p, name) for p in (self, *more)]))

    def graft(self, at: np.ndarray, trees: list) -> None:
        """Puts trees in the place of leaves: their roots there, their other nodes at the end."""
        total = len(self)
        for i, t in zip(at, trees):
            t.left = np.where(t.feature < 0, -1, t.left + total - 1).astype(np.int32)
            t.depth = t.depth + self.depth[i]
            self.feature[i], self.cut[i], self.left[i] = t.feature[0], t.cut[0], t.left[0]
            for name in NODE_PARTS:
                setattr(t, name, getattr(t, name)[1:])
            total += len(t)
        self.append(trees)

    def prune(self, roots: int, weights) -> None:
        """Makes a leaf of each node whose leaves all tell the same label, and drops what was below."""
        tells = self.counts[:, 1] * weights[1] > self.counts[:, 0] * weights[0]
        inner = [np.flatnonzero((self.depth == d) & (self.feature >= 0))
                 for d in range(self.depth.max() + 1)]
        for at in reversed(inner):
            a, b = self.left[at], self.left[at] + 1
            at = at[(self.feature[a] < 0) & (self.feature[b] < 0) & (tells[a] == tells[b])]
            self.feature[at] = self.left[at] = -1
        keep = np.arange(len(self)) < roots
        for at in inner:
            at = at[keep[at] & (self.feature[at] >= 0)]
            keep[self.left[at]] = keep[self.left[at] + 1] = True
        number = np.cumsum(keep, dtype=np.int32) - 1
        self.left = np.where(self.feature < 0, -1, number[self.left]).astype(np.int32)
        for name in NODE_PARTS:
            setattr(self, name, getattr(self, name)[keep])

    def towards(self, wanted: np.ndarray) -> np.ndarray:
        """Features of the nodes, -1 where no wanted leaf is below."""
        leads = np.zeros(len(self), bool)
        leads[wanted] = True
        for d in range(self.depth.max(), -1, -1):
            at = np.flatnonzero((self.depth == d) & (self.feature >= 0))
            leads[at] = leads[self.left[at]] | leads[self.left[at] + 1]
        return np.where(leads, self.feature, -1)

    def mixed(self, at: np.ndarray, depth: int, least: int) -> np.ndarray:
        """Those nodes that may be split."""
        c = self.counts[at]
        return at[(c.min(axis=1) > 0) & (self.depth[at] < depth) & (c.sum(axis=1) >= 2 * least)]


def steps(feature, cut, left) -> np.ndarray:
    """Nodes as one number each: feature, cut and left child; a leaf is negative."""
    return np.where(feature < 0, -1, left.astype(np.int64) << 24 | cut.astype(np.int64) << 16 | feature)


def walk_steps(nodes: np.ndarray, x: np.ndarray, rows: np.ndarray, root: int) -> np.ndarray:
    """Where those rows of ``x`` end that begin at a root."""
    end, open_ = np.full(len(rows), root, np.int64), None
    if nodes[root] < 0:
        return end
    flat, start, at = x.ravel(), rows * x.shape[1], end
    while len(at):
        step = nodes.take(at)
        go = step >= 0
        if not go.all():
            if open_ is None:
                end, open_ = at.copy(), np.flatnonzero(go)
            else:
                end[open_] = at
                open_ = open_[go]
            start, step = start[go], step[go]
        at = (step >> 24) + (flat.take(start + (step & 0xffff)) > (step >> 16 & 0xff))
    return end


def walk(feature, cut, left, x: np.ndarray, rows: np.ndarray, root: int) -> np.ndarray:
    """Where those rows of ``x`` end that begin at a root."""
    return walk_steps(steps(feature, cut, left), x, rows, root)


def looked_at(rng, nodes: int, features: int, k: int) -> np.ndarray:
    """A random choice of ``k`` features for each node."""
    return np.argsort(rng.random((nodes, features)), axis=1)[:, :k].astype(np.int16)


def counted(x, y, draws, node: np.ndarray, looked: np.ndarray, rows=None) -> np.ndarray:
    """Drawn rows by (node, feature looked at, bin, label); ``rows`` are their places in ``x``, else all."""
    nodes, k = looked.shape
    rows = np.arange(len(node)) if rows is None else rows
    at = looked.astype(np.int64).take(node, axis=0)
    at += (rows * x.shape[1])[:, None]
    key = (np.arange(nodes * k).reshape(nodes, 1, k) * (2 * BINS) + np.arange(2)[:, None]).reshape(
        -1, k).take(2 * node + y, axis=0)
    key += (x.ravel().take(at) * np.uint8(2)).astype(np.int64)
    return np.bincount(key.ravel(), np.repeat(draws.astype(np.float64), k), nodes * k * BINS * 2).astype(
        np.int32).reshape(nodes, k, BINS, 2)


def best_splits(counts: np.ndarray, weights, least: int):
    """Per node: whether it splits, place of the feature among those looked at, bin, and left counts."""
    low = counts.cumsum(axis=2, dtype=np.int64)
    whole, low = low[:, :, -1:], low[:, :, :-1]

    def impure(c):
        w = c * weights
        total = w.sum(axis=-1)
        return 2 * w[..., 0] * w[..., 1] / np.maximum(total, 1e-300)
    gain = impure(whole) - impure(low) - impure(whole - low)
    n = low.sum(axis=-1)
    gain[(n < least) | (whole.sum(axis=-1) - n < least)] = -1.0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    rows = np.arange(len(best))
    place, cut = best // (BINS - 1), best % (BINS - 1)
    splits = flat[rows, best] > 1e-12 * impure(whole)[:, 0, 0]
    return splits, place, cut, low[rows, place, cut]


def grown(x, y, draws, depth: int, k: int, weights, least: int, rng) -> Nodes:
    """The whole tree below a node, out of its rows; ``depth`` is what is left of it."""
    first = np.array([[draws[y == c].sum(dtype=np.int64) for c in (0, 1)]])
    nodes, at, open_ = Nodes(first), np.zeros(len(y), np.int64), np.zeros(1, np.int64)
    while len(open_ := nodes.mixed(open_, depth, least)):
        place = np.full(len(nodes), -1)
        place[open_] = np.arange(len(open_))
        keep = place[at] >= 0
        x, y, draws, at = x[keep], y[keep], draws[keep], at[keep]
        by_node = np.argsort(place[at], kind="stable")
        x, y, draws, at = x[by_node], y[by_node], draws[by_node], at[by_node]
        bounds = np.searchsorted(place[at], np.arange(len(open_) + 1))
        found = []
        looked = looked_at(rng, len(open_), x.shape[1], k)
        for i in range(0, len(open_), AT_ONCE):
            j = min(i + AT_ONCE, len(open_))
            part = slice(bounds[i], bounds[j])
            splits, own, cut, low = best_splits(
                counted(x[part], y[part], draws[part], place[at[part]] - i, looked[i:j]),
                weights, least)
            found.append((open_[i:j][splits], looked[np.arange(i, j), own][splits], cut[splits],
                          low[splits]))
        open_ = nodes.split(*[np.concatenate(f) for f in zip(*found)])
        f = nodes.feature[at]
        at = np.where(f < 0, at, nodes.left[at] + (x[np.arange(len(at)), f] > nodes.cut[at]))
    nodes.prune(1, weights)
    return nodes


class ForestFit:
    """Trees in one pool of nodes; ``value`` is the weighted share of label 1 in a leaf."""

    def __init__(self, names, edges, roots, feature, cut, left, value):
        self.names, self.edges, self.roots = list(names), edges, roots
        self.feature, self.cut, self.left, self.value = feature, cut, left, value

    def probability(self, columns) -> np.ndarray:
        """Mean over the trees of the leaves' values, of features given column by column."""
        total = np.zeros(len(columns[0]))
        x = binned(columns, self.edges)
        rows, nodes = np.arange(len(x)), steps(self.feature, self.cut, self.left)
        for root in self.roots:
            total += self.value[walk_steps(nodes, x, rows, root)]
        return total / len(self.roots)

    def with_probability(self, df: DataFrame, out: str) -> DataFrame:
        """The rows with the probability of label 1. A null or NaN among the features is an error."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf(DoubleType())
        def score(rows: pa.Array) -> pa.Array:
            fit = shared.value
            return pa.array(fit.probability(columns_of(rows, len(fit.names))))

        return df.withColumn(out, score(vector(self.names)))


def fit_trees(train: DataFrame, names, label: str, weights, trees: int, depth: int, seed: int,
              least: int = 2) -> ForestFit:
    """Fits on all rows of ``train``.

    ``weights`` are those of labels 0 and 1; a child has ``least`` drawn rows or more.
    """
    names, weights = list(names), np.asarray(weights, np.float64)
    size, k = len(names), math.ceil(math.sqrt(len(names)))
    edges = bin_edges(train, names, label, weights)
    context = train.sparkSession.sparkContext
    blocks = materialised(packed_bins(train, names, label, edges)).coalesce(3 * context.defaultParallelism)

    def rows_of(batch):
        for block, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            yield block, np.frombuffer(x, np.uint8).reshape(-1, size), np.frombuffer(y, np.uint8)

    def at_nodes(batches, pool, wanted):
        """(tree, bins, labels, places of drawn rows, draws, place among the wanted nodes) by block and tree."""
        place = np.full(len(pool), -1)
        place[wanted] = np.arange(len(wanted))
        feature = pool.towards(wanted)
        some = [t for t in range(trees) if feature[t] >= 0 or place[t] >= 0]
        leads = steps(feature, pool.cut, pool.left)
        for batch in batches:
            for block, x, y in rows_of(batch):
                for tree in some:
                    draws = drawn(seed, tree, block, len(y))
                    rows = np.flatnonzero(draws != 0)
                    node = place.take(walk_steps(leads, x, rows, tree))
                    inside = node >= 0
                    if not inside.all():
                        rows, node = rows[inside], node[inside]
                    if len(rows):
                        yield tree, x, y, rows, draws.take(rows), node

    def first(batches):
        total = np.zeros((trees, 2), np.int64)
        for batch in batches:
            for block, _, y in rows_of(batch):
                for tree in range(trees):
                    total[tree] += np.bincount(y, drawn(seed, tree, block, len(y)), 2).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(trees)), pa.array(total[:, 0]),
                                          pa.array(total[:, 1])], ["tree", "a", "b"])

    roots = np.zeros((trees, 2), np.int64)
    for r in (blocks.mapInArrow(first, "tree long, a long, b long").groupBy("tree")
              .agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()):
        roots[r["tree"]] = r["a"], r["b"]
    large = min(max(SHARE * roots.sum() / trees, LEAST), MOST)
    nodes, open_, small, tree_of = Nodes(roots), np.arange(trees), [], np.arange(trees)
    while True:
        open_ = nodes.mixed(open_, depth, least)
        is_large = nodes.counts[open_].sum(axis=1) > large
        small.append(open_[~is_large])
        open_ = open_[is_large]
        if not len(open_):
            break
        looked = looked_at(np.random.default_rng((seed, 1, len(nodes))), len(open_), size, k)
        # Open nodes stand in the order of their trees.
        shared = context.broadcast((nodes, open_, looked, np.searchsorted(tree_of[open_], np.arange(trees + 1))))

        def count(batches):
            pool, wanted, looked, bounds = shared.value
            total = np.zeros((len(wanted), k, BINS, 2), np.int32)
            for tree, x, y, rows, draws, node in at_nodes(batches, pool, wanted):
                i, j = bounds[tree], bounds[tree + 1]
                total[i:j] += counted(x, y[rows], draws, node - i, looked[i:j], rows)
            parts = range(0, len(wanted), AT_ONCE // 8)
            for i in parts:
                part = total[i:i + AT_ONCE // 8]
                if part.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i]), pa.array([part.tobytes()], pa.binary())], ["part", "counts"])

        def choose(key, rows):
            i, total = key[0].as_py(), 0
            for c in rows.column("counts"):
                total = total + np.frombuffer(c.as_buffer(), np.int32).astype(np.int64)
            splits, place, cut, low = best_splits(total.reshape(-1, k, BINS, 2), weights, least)
            at = np.flatnonzero(splits)
            return pa.Table.from_arrays(
                [pa.array(v.astype(np.int64)) for v in (at + i, place[at], cut[at], low[at, 0],
                                                        low[at, 1])], ["i", "place", "cut", "a", "b"])

        found = (blocks.mapInArrow(count, "part long, counts binary").groupBy("part")
                 .applyInArrow(choose, "i long, place long, cut long, a long, b long")
                 .toPandas().sort_values("i"))
        i = found["i"].to_numpy()
        tree_of = np.r_[tree_of, np.repeat(tree_of[open_[i]], 2)]
        open_ = nodes.split(open_[i], looked[i, found["place"].to_numpy()], found["cut"].to_numpy(),
                            found[["a", "b"]].to_numpy())

    small = np.concatenate(small)
    shared_end = context.broadcast((nodes, small))

    def deal(batches):
        pool, wanted = shared_end.value

        def passed_on():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int64()),
                 *[pa.array([b"".join(p[i] for p in parts) for parts in held.values()], pa.binary())
                   for i in range(3)]], ["node", "x", "y", "draws"])
        held, size = {}, 0
        for _, x, y, rows, draws, node in at_nodes(batches, pool, wanted):
            order = np.argsort(node, kind="stable")
            rows, draws, node = rows[order], draws[order], node[order]
            x, y = x[rows], y[rows]
            ends = [0, *(np.flatnonzero(np.diff(node)) + 1), len(node)]
            for i, j in zip(ends, ends[1:]):
                held.setdefault(int(node[i]), []).append(
                    (x[i:j].tobytes(), y[i:j].tobytes(), draws[i:j].tobytes()))
            size += x.nbytes
            if size > HELD:
                yield from passed_on()
                held, size = {}, 0
        if held:
            yield from passed_on()

    def finish(key, rows):
        pool, wanted = shared_end.value
        node = key[0].as_py()
        x, y, draws = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8)
                       for c in ("x", "y", "draws"))
        own = grown(x.reshape(-1, size), y, draws, depth - int(pool.depth[wanted[node]]), k, weights,
                    least, np.random.default_rng((seed, 2, int(wanted[node]))))
        return pa.Table.from_arrays(
            [pa.array([node]), *[pa.array([getattr(own, n).tobytes()], pa.binary()) for n in NODE_PARTS]],
            ["node", *NODE_PARTS])

    ends = (blocks.mapInArrow(deal, "node long, x binary, y binary, draws binary").groupBy("node")
            .applyInArrow(finish, ", ".join(["node long", *[f"{n} binary" for n in NODE_PARTS]]))
            .toPandas().sort_values("node"))
    below = []
    for row in ends[list(NODE_PARTS)].itertuples(index=False):
        tree = Nodes(np.zeros((0, 2)))
        for (name, kind), data in zip(NODE_PARTS.items(), row):
            setattr(tree, name, np.frombuffer(data, kind))
        tree.counts = tree.counts.reshape(-1, 2)
        below.append(tree)
    nodes.graft(small[ends["node"].to_numpy()], below)
    nodes.prune(trees, weights)
    w = nodes.counts * weights
    value = (w[:, 1] / np.maximum(w.sum(axis=1), 1e-300)).astype(np.float32)
    # A tree that drew no row has nothing to say.
    return ForestFit(names, edges, np.flatnonzero(roots.sum(axis=1)), nodes.feature, nodes.cut, nodes.left, value)
