"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. Each text becomes the set of its shingles, of which a digest, the size and the keys of the
   bands of a SuperMinHash signature are kept. Texts with equal sets are one node from here on.
2. Nodes with a band key in common are a bucket. Its smallest id is compared with each other
   member (a star, not all pairs), on full sets of words. Components follow from those links.
3. Buckets whose members are now in several components are compared exactly: members outside
   the centre's component with all others, in tiles of bounded size, by products of
   incidence matrices. Links found there complete the components.

So no link between nodes of a bucket is lost whatever its size, and no task holds a bucket.
With the default of 40 bands of 5 rows, a pair at the threshold of 0.8 shares no bucket with a
probability of 1.3e-7.

Defined cases: texts without words, and null texts, are empty sets: they stand alone and are
kept. Texts with fewer words than a shingle are one shingle. A null id is never grouped and is
kept. Rows that repeat an id are one document for grouping and give one result each; an empty
table gives an empty result. Other columns are neither read nor returned by
:func:`near_duplicates`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowguard.llm.common import WORD, blocks, cut, texts
from flowguard.llm.components import Forest, components
from flowguard.llm.words import ASCII_LOWER, ODD, WordHasher, grams, mix, per_text

BANDS, ROWS = 40, 5
#: Most members of one side of a tile, on average.
TILE = 256
#: Elements whose permutations are held at a time.
ELEMENTS = 60_000


def super_min_hash(elements: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (sets x m) of sets of 64-bit hashes.

    In round j each element puts the value j + r into the j-th place of its own random
    permutation of the registers; a set is finished when all its registers are below the next
    round. Values have j in the upper 16 bits and r in the lower 48.
    """
    out = np.full((len(elements), m), np.iinfo(np.uint64).max, np.uint64)
    start = 0
    while start < len(elements):
        end, total = start, 0
        while end < len(elements) and (end == start or total + len(elements[end]) <= ELEMENTS):
            total += len(elements[end])
            end += 1
        _signatures(elements[start:end], out[start:end])
        start = end
    return out


def _signatures(elements: list[np.ndarray], out: np.ndarray) -> None:
    n, m = out.shape
    x = np.concatenate(elements)
    owner = np.repeat(np.arange(n), [len(e) for e in elements])
    flat = out.reshape(-1)
    place = None
    for j in range(m):
        if not len(x):
            return
        random = mix(x + np.uint64((2 * j + 1) * int(ODD) % 2 ** 64))
        to = j + ((random >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            register, first = to, to
        else:
            if place is None:
                place = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
                rows = np.arange(len(x))
                place[rows, first] = 0
                place[:, 0] = first
            rows = np.arange(len(x))
            register = place[rows, to].astype(np.int64)
            place[rows, to] = place[:, j]
        value = (np.uint64(j) << np.uint64(48)) | (mix(random + ODD) >> np.uint64(16))
        np.minimum.at(flat, owner * m + register, value)
        open_sets = out.max(axis=1) >= (np.uint64(j + 1) << np.uint64(48))
        stay = open_sets[owner]
        if not stay.all():
            x, owner = x[stay], owner[stay]
            if place is not None:
                place = place[stay]
            first = first[stay]


def signatures(docs: DataFrame, n: int = 2, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands): set size, a 128-bit digest of the set, band keys."""
    def run(batches):
        hasher = WordHasher(fold_case=True)
        for batch, values in blocks(batches):
            hashes, counts = hasher.texts(values)

            def shingles(words):
                return np.unique(grams(words, min(n, len(words)))) if len(words) else words
            sets = per_text(hashes, counts, shingles)
            sizes = np.array([len(s) for s in sets], np.int64)
            mixed = [(mix(s), mix(s ^ ODD)) for s in sets]
            d1 = np.array([a.sum(dtype=np.uint64) for a, _ in mixed], np.uint64).view(np.int64)
            d2 = np.array([b.sum(dtype=np.uint64) for _, b in mixed], np.uint64).view(np.int64)
            sig = super_min_hash(sets, bands * rows).reshape(len(sets), bands, rows)
            keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2])
            for r in range(rows):
                keys = mix(keys * ODD + sig[:, :, r])
            keys = np.ascontiguousarray(keys[sizes > 0]).view(np.int64).reshape(-1)
            ends = np.r_[0, np.cumsum(np.where(sizes > 0, bands, 0))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(d1), pa.array(d2),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))],
                ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return texts(docs).mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def shingle_set(text: str, n: int) -> frozenset:
    words = WORD.findall(text.translate(ASCII_LOWER))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(n))))


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared) > 0


def verify_stars(edges: DataFrame, read: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) among the edges (centre, node) whose full sets are alike enough."""
    member = read.select(F.col("doc_id").alias("node"), F.col("text").alias("node_text"))
    centre = read.select(F.col("doc_id").alias("centre"), F.col("text").alias("centre_text"))

    def run(batches):
        # A few hundred texts at a time are taken out of a batch.
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            forest, last, own = Forest(), None, frozenset()
            for c, v, ct, vt in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != last:
                    last, own = c, shingle_set(ct, n)
                other = shingle_set(vt, n)
                small, large = sorted((len(own), len(other)))
                if 100 * small >= percent * large and linked(
                        len(own & other), len(own), len(other), percent):
                    forest.join(c, v)
            a, b = forest.links()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                             ["a", "b"])

    return (edges.join(member, "node").join(centre, "centre")
            .select("centre", "node", "centre_text", "node_text")
            .mapInArrow(run, "a long, b long"))


def _shared_counts(left: list[frozenset], right: list[frozenset], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with all of the other."""
    known: dict = {}
    for s in left:
        for x in s:
            known.setdefault(x, len(known))

    def places(sets):
        own = [np.array([known[x] for x in s if x in known], np.int64) for s in sets]
        return np.repeat(np.arange(len(own)), [len(o) for o in own]), np.concatenate(own)
    (lr, lc), (rr, rc) = places(left), places(right)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(known), width):
        sides = []
        for rows, cols, size in ((lr, lc, len(left)), (rr, rc, len(right))):
            take = (cols >= at) & (cols < at + width)
            dense = np.zeros((size, width), np.float32)
            dense[rows[take], cols[take] - at] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _tile(n: int, percent: int):
    def run(tile: pa.Table) -> pa.Table:
        rows = tile.to_pydict()
        nodes, comps = rows["node"], rows["comp"]
        sets = [shingle_set(t, n) for t in rows["text"]]
        sides = [[i for i, s in enumerate(rows["side"]) if s == k] for k in (0, 1)]
        left, right = sides if sides[0] and sides[1] else (sides[0] or sides[1],) * 2
        forest = Forest()
        if left:
            shared = _shared_counts([sets[i] for i in left], [sets[i] for i in right])
            a = np.array([len(sets[i]) for i in left])[:, None]
            b = np.array([len(sets[i]) for i in right])[None, :]
            for i, k in np.argwhere((100 * shared >= percent * (a + b - shared)) & (shared > 0)):
                i, k = left[i], right[k]
                if comps[i] != comps[k]:
                    forest.join(nodes[i], nodes[k])
        a, b = forest.links()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def rest_of_buckets(members: DataFrame, found: DataFrame, read: DataFrame, n: int,
                    percent: int, tile: int = TILE) -> DataFrame:
    """Links between different components within a bucket that its star did not reach.

    ``members`` has (key, centre, node) without the centres. Members in the centre's component
    are one side, all others the other; the others are compared with both sides. Buckets with the
    same members are looked at once.
    """
    comp_of = found.select(F.col("node").alias("_n"), "comp")
    inside = (members.select("key", "centre", "node")
              .join(comp_of, F.col("node") == F.col("_n"), "left")
              .select("key", "centre", "node", F.coalesce("comp", "node").alias("comp")))
    centre_of = found.select(F.col("node").alias("_c"), F.col("comp").alias("_cc"))
    inside = (inside.join(centre_of, F.col("centre") == F.col("_c"), "left")
              .select("key", "centre", "node", "comp",
                      F.coalesce("_cc", "centre").alias("centre_comp")))
    own = F.col("comp") == F.col("centre_comp")
    sizes = (inside.groupBy("key").agg(
        F.max("centre").alias("centre"), F.max("centre_comp").alias("centre_comp"),
        F.sum(F.when(own, 1).otherwise(0)).alias("n_own"),
        F.sum(F.when(own, 0).otherwise(1)).alias("n_other"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"))
        .filter((F.col("n_other") > 0) & (F.col("n_own") + F.col("n_other") > 1)))
    # The centre itself needs no comparison: its star has been verified.
    once = sizes.groupBy("centre", "members", "n_own", "n_other").agg(F.min("key").alias("key"))
    rows = (once.select("key", F.greatest(F.ceil(F.col("n_own") / tile), F.lit(0)).cast("int")
                        .alias("own_blocks"),
                        F.ceil(F.col("n_other") / tile).cast("int").alias("other_blocks"))
            .join(inside.select("key", "node", "comp", own.alias("own")), "key"))
    block = F.pmod(F.xxhash64("node"), F.greatest(
        F.when(F.col("own"), F.col("own_blocks")).otherwise(F.col("other_blocks")), F.lit(1))
        ).cast("int")
    rows = rows.withColumn("block", block)

    def tiles(kind, x, y, side):
        return F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"),
                        y.cast("int").alias("y"), side.cast("int").alias("side"))
    b = F.col("block")

    def upto(blocks_col):
        return F.when(F.col(blocks_col) > 0, F.sequence(F.lit(0), F.col(blocks_col) - 1)).otherwise(
            F.array().cast("array<int>"))
    mine = F.transform(upto("other_blocks"), lambda y: tiles(0, b, y, F.lit(0)))
    theirs = F.concat(
        F.transform(upto("own_blocks"), lambda x: tiles(0, x, b, F.lit(1))),
        F.transform(upto("other_blocks"), lambda y: tiles(
            1, F.least(b, y), F.greatest(b, y), F.when(b > y, 1).otherwise(0))))
    placed = rows.select("key", "node", "comp", F.explode(
        F.when(F.col("own"), mine).otherwise(theirs)).alias("t"))
    return (placed.select("key", "t.*", "node", "comp")
            .join(read.withColumnRenamed("doc_id", "node"), "node")
            .select("key", "kind", "x", "y", "side", "node", "comp", "text")
            .groupBy("key", "kind", "x", "y").applyInArrow(_tile(n, percent), "a long, b long"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``.

    Texts are linked when at least ``percent`` of 100 of the union of their ``n``-word shingles is
    shared; a component is named by its smallest id, the one that is kept.
    """
    read = texts(docs)
    signed = cut(signatures(docs, n, bands, rows))
    sets = (signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
            .groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "bands")).alias("r")))
    nodes = cut(sets.select("d1", "d2", F.col("r.doc_id").alias("node"),
                            F.col("r.bands").alias("bands")))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = (keyed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n"))
               .filter("n > 1").select("key", "centre"))
    members = cut(keyed.join(buckets, "key").filter("node <> centre"))
    edges = members.select("centre", "node").distinct()
    wanted = edges.select(F.explode(F.array("centre", "node")).alias("doc_id")).distinct()
    read = cut(read.join(wanted, "doc_id", "left_semi").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")))
    stars = cut(verify_stars(edges, read, n, percent))
    found = components(stars)
    more = cut(rest_of_buckets(members, found, read, n, percent))
    found = components(stars.unionAll(more))
    named = (nodes.select("d1", "d2", "node")
             .join(found, "node", "left")
             .select("d1", "d2", F.coalesce("comp", "node").alias("component_id")))
    joined = (signed.select("doc_id", "n_shingles", "d1", "d2")
              .join(named, ["d1", "d2"], "left"))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = joined.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(
        F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"),
                                             F.lit(True)))


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that represent their group, with all their columns, each id once.

    Of rows that share an id, the one with the smallest hash of its columns (maps aside) stays. Rows
    without an id are all kept.
    """
    kept = (near_duplicates(docs, n, percent).filter("kept AND doc_id IS NOT NULL")
            .select(F.col("doc_id").alias("_kept_id")).distinct())
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*hashed))
    rank = "_rank"
    while rank in docs.columns:
        rank += "_"
    chosen = docs.join(kept, docs["doc_id"] == kept["_kept_id"], "left_semi")
    once = (chosen.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1)
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
    return once.unionAll(docs.filter(F.col("doc_id").isNull()))
