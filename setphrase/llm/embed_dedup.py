"""Embedding near-dedup (1): a forest of random-projection trees with spill overlap.

Each level of a tree projects on a random direction and splits a node near the median of a
bounded sample; vectors within ``spill`` of the split go to both sides. All vectors are routed,
compared within leaves, and pairs that reach the cosine are verified in double precision and
united. A pair that meets in several leaves counts in the first of them only (both ends carry
the list of their leaves), so links are counted without listing pairs: a leaf emits one row for
each member, with its number of new links and its root in the leaf's spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setphrase.llm.common import Forest, connected_components, cut, sieve, sifted, spread_join

LEAF = 1024
BLOCK = 2048
LEAF_BITS = 24
SAMPLE = 20_000


class RandomForest:
    """Directions and thresholds of all trees: trees x depth directions, trees x (2**depth - 1) thresholds."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, spill: float, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        size = sample.shape[1]
        self.directions = rng.standard_normal((trees, depth, size)).astype(np.float32) / np.sqrt(size)
        self.margin = np.float32(spill / np.sqrt(size))
        self.splits = np.zeros((trees, (1 << depth) - 1), np.float32)
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                x = sample @ self.directions[t, level]
                order = np.lexsort((x, node))
                present, start, n = np.unique(node[order], return_index=True, return_counts=True)
                at = (1 << level) - 1
                # the split is drawn around the median, so that trees cut dense places apart
                middle = start + np.clip((n * rng.uniform(0.35, 0.65, len(n))).astype(int), 0, n - 1)
                self.splits[t, at + present] = x[order][middle]
                node = node * 2 + (x > self.splits[t, at + node])

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row reaches, by row and ascending leaf; a leaf's number holds its tree."""
        rows, leaves = [], []
        for t in range(self.trees):
            who, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                away = (x @ self.directions[t, level])[who] - self.splits[t, (1 << level) - 1 + node]
                left, right = away <= self.margin, away > -self.margin
                who, node = np.concatenate([who[left], who[right]]), np.concatenate([node[left] * 2, node[right] * 2 + 1])
            rows.append(who)
            leaves.append(t << LEAF_BITS | node)
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def leaf_links(x: np.ndarray, many: np.ndarray, block: np.ndarray, seen: list[np.ndarray], pair: tuple[int, int], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(new links of each member, root of each member) for one leaf, or one pair of blocks of it.

    x: unit vectors in double precision, many: how many rows each stands for, seen: its leaves before this one.
    """
    n = len(x)
    if pair[0] == pair[1]:
        left = right = np.arange(n)
    else:
        left, right = np.flatnonzero(block == pair[0]), np.flatnonzero(block == pair[1])
    names, where = np.unique(np.concatenate(seen), return_inverse=True) if n else (np.zeros(0), np.zeros(0, int))
    met = np.zeros((n, len(names)), np.float32)
    met[np.repeat(np.arange(n), [len(e) for e in seen]), where] = 1
    links, forest, single = np.zeros(n, np.int64), Forest(n), x.astype(np.float32)
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        i, j = np.nonzero(single[rows] @ single[right].T >= np.float32(cosine - 1e-4))
        i, j = rows[i], right[j]
        if pair[0] == pair[1]:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        for cut_ in range(0, len(i), 200_000):
            p, q = i[cut_ : cut_ + 200_000], j[cut_ : cut_ + 200_000]
            ok = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
            p, q = p[ok], q[ok]
            if len(names):
                new = np.einsum("ij,ij->i", met[p], met[q]) == 0 if len(p) < 2_000 else ~(met[rows] @ met[right].T > 0)[np.searchsorted(rows, p), np.searchsorted(right, q)]
                p, q = p[new], q[new]
            np.add.at(links, p, many[q])
            np.add.at(links, q, many[p])
            forest.join(p, q)
    return links, forest.root


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, trees: int = 6, spill: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows (id, n_links, component_id, kept) for every row of vectors; other columns are ignored.

    A vector that is null, empty or zero, or that holds a null or non-finite component, links
    with nothing; vectors of different lengths don't link with each other. Equal vectors are
    compared once and counted as often as they occur. Rows that repeat an id are rows of their
    own, with the links of their own vectors. A component has the smallest id in it that is not
    null, and null only if it has no other. An empty table gives no rows.

    The forest is fitted to about SAMPLE vectors of each length, those whose hashes are lowest;
    it routes and compares all of them. A column of floats is shuffled as floats, which lose
    nothing: cosines are computed in double precision.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    sound = F.coalesce((F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = cut(source.withColumn("ok", sound).withColumn("row", F.monotonically_increasing_id()))
    sums = rows.where("ok").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("many"), F.min("row").alias("key"))
    whole = cut(sums.withColumn("size", F.size("v")))

    made = None
    for size, n in [(r["size"], r["n"]) for r in whole.groupBy("size").agg(F.count("*").alias("n")).collect()]:
        part = whole.where(F.col("size") == size)
        drawn = part.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000_000)) < F.lit(SAMPLE / n * 1e9)).select("v").toArrow()["v"].combine_chunks()
        sample = unit(drawn).astype(np.float32) if len(drawn) else np.zeros((0, size), np.float32)
        depth = min(16, max(0, int(np.ceil(np.log2(n / LEAF)))))
        links = _links(part, RandomForest(sample, depth, trees, spill, seed), cosine, kind)
        made = links if made is None else made.unionByName(links)
    if made is None:
        made = spark.createDataFrame([], "key long, n long, root long")
    made = cut(made)
    counts = made.groupBy("key").agg(F.sum("n").alias("n"))
    components = cut(connected_components(made.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))))
    first = components.join(whole.select(F.col("key").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("first"), F.count("*").alias("nodes"))
    placed = spread_join(components, cut(first), ["component"], "nodes").select(F.col("node").alias("key"), "first")
    named = whole.select("key", "rep", "many").join(counts, "key", "left").join(placed.withColumn("placed", F.lit(True)), "key", "left")
    named = cut(named.select("key", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.when(F.col("placed"), F.col("first")).otherwise(F.col("rep")).alias("component_id"), "many"))
    # a row is its vector's key unless the vector is repeated; only rows that may repeat one are shuffled with it
    again = cut(whole.where("many > 1").select("v", "key"))
    copies = sifted(rows.where("ok").select("row", "v"), "v", cut(sieve(again, "v"))).where("_hit").join(again, "v").select("row", "key")
    keyed = rows.select("row", "id", "ok").join(copies, "row", "left").select("id", F.when(F.col("ok"), F.coalesce("key", "row")).alias("key"), F.col("ok"))
    linked = spread_join(keyed.where("ok"), named, ["key"], "many").select("id", "n_links", "component_id")
    alone = keyed.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found = linked.unionByName(alone)
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def unit(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of unit length, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(vectors: DataFrame, trees: RandomForest, cosine: float, kind: str) -> DataFrame:
    """Rows (key, n, root): new links of a vector in a leaf, and its root there."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                part = batch.slice(at, 2_000)
                row, leaf = trees.route(unit(part.column(1)).astype(np.float32))
                # a row carries the leaves of its vector that come before its own
                order = np.arange(len(row)) - np.r_[0, np.cumsum(np.bincount(row, minlength=len(part)))][row]
                ends = np.r_[0, np.cumsum(order)]
                where = np.arange(ends[-1]) - np.repeat(ends[:-1] - (np.arange(len(row)) - order), order)
                seen = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf[where], pa.int32()))
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), part.column(0).take(taken), part.column(2).take(taken), part.column(1).take(taken), seen], ["leaf", "key", "many", "v", "seen"])

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("key").combine_chunks()
        x = unit(group["v"].chunk(0)) if group.num_rows else np.zeros((0, 1))
        names, lists = group["key"].to_numpy(), group["seen"].chunk(0) if group.num_rows else pa.array([], pa.list_(pa.int32()))
        flat, ends = lists.flatten().to_numpy(), np.cumsum(np.r_[0, lists.value_lengths().to_numpy()])
        seen = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        links, root = leaf_links(x, group["many"].to_numpy(), group["block"].to_numpy(), seen, (key[1].as_py(), key[2].as_py()), cosine)
        return pa.table({"key": names, "n": links, "root": names[root]})

    routed = cut(vectors.select("key", "v", "many").mapInArrow(route, f"leaf long, key long, many long, v array<{kind}>, seen array<int>"))
    # blocks of a leaf that is larger than BLOCK: each pair of blocks is a group of its own.
    # A tree has at most 2**16 leaves, so there are at most trees x 65,536 sizes
    sizes = routed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = routed.join(F.broadcast(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = other.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return paired.groupBy("leaf", "low", "high").applyInArrow(compare, "key long, n long, root long")
