"""Helpers that the operators share: lineage cuts, table access, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setphrase.functions.lineage import checkpoint_dir, cut

WHITE = r"[\x20\x09-\x0D]+"
HEAVY = 20_000
ROWS_AT_ONCE = 1_000
ROWS_A_FILE = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for a table that is written and read again."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def whole_texts(df: DataFrame) -> DataFrame:
    """df, whose texts go to Python: Arrow batches of ROWS_AT_ONCE rows, unless the session has its own size, so that a batch of long texts stays small on both sides."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":  # Spark's default
        conf.set(key, str(ROWS_AT_ONCE))
    return df


def sieve(keys: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """A bitmap of 2**bits bits (at most 2**(bits - 6) rows) in which the hash of each key sets one."""
    bit = F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(bit, 6).alias("_w"), F.lit(1).cast("long").alias("_one"), bit.alias("_b"))
    return words.groupBy("_w").agg(F.bit_or(F.expr("shiftleft(_one, cast(_b & 63 as int))")).alias("_bits"))


def sifted(df: DataFrame, key: str, bitmap: DataFrame, bits: int = 24) -> DataFrame:
    """df with a column ``_hit``: false only where the key is not among the sieve's, so such rows need no shuffle."""
    bit = F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))
    found = df.withColumn("_b", bit).withColumn("_w", F.shiftright("_b", 6)).join(F.broadcast(bitmap), "_w", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.expr("shiftleft(1L, cast(_b & 63 as int))")) != 0, F.lit(False))
    return found.withColumn("_hit", hit).drop("_w", "_b", "_bits")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each led by as many underscores as it takes to clash with no taken one (in any case)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, gone: DataFrame, *keys: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """df without the rows whose keys are a row of gone (null equals null); only rows that pass a sieve of gone's first key are shuffled, and only theirs are the other keys made.

    A key is made by a function that is given a function from df's column names to columns, which
    are renamed here so that df may have any names. An id alone doesn't name a row (it may be null
    or repeated): keys should hold what decided, such as a hash of the text.
    """
    at = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    column = lambda c: F.col(at[c])
    names = [f"_gone{i}" for i in range(len(keys))]
    gone = cut(gone.toDF(*names).distinct())
    marked = sifted(df.toDF(*at.values()).withColumn("_key0", keys[0](column)), "_key0", cut(sieve(gone, "_gone0")))
    same = [F.col(f"_key{i}").eqNullSafe(F.col(name)) for i, name in enumerate(names)]
    keyed = marked.where("_hit").withColumns({f"_key{i}": key(column) for i, key in enumerate(keys)})
    kept = keyed.join(gone, reduce(and_, same), "left_anti").select(marked.columns)
    return marked.where("not _hit").unionByName(kept).select(*[column(c).alias(c) for c in df.columns])


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """rows joined to groups, which have a row for each key and the number of its rows in the column ``size``.

    Keys of more than ``heavy`` rows, of which there are at most a heavy-th of the rows, are sent
    to all tasks, so that a key that a third of all rows share isn't one task's; the rest is shuffled.
    """
    large = F.broadcast(groups.where(F.col(size) > heavy))
    rest = rows.join(F.broadcast(groups.where(F.col(size) > heavy).select(*keys)), keys, "left_anti")
    return rows.join(large, keys).unionByName(rest.join(groups.where(F.col(size) <= heavy), keys, how))


def crc32_of_id(doc_id: str) -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


class Forest:
    """Union-find over 0..n-1 whose unions and finds are whole-array operations; a root is the smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
            self.root = root


def _digest(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as so many rows need: a small table shuffled in many partitions costs files and tasks, not data."""
    return df.coalesce(-(-max(1, rows) // ROWS_A_FILE))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node with a link to another; component is the smallest reachable node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), whose number
    of rounds grows with the logarithm of the longest path. A node's minimum is pre-aggregated
    and written before it is joined back, so that the join of a hub's links can be split.
    No step makes more rows than twice the links, so their number tells how many partitions do.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    edges = cut(ends.distinct())
    before = _digest(edges)
    few = lambda df: gathered(df, 2 * before[0])
    edges = few(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(few(large.where("u <> v").distinct()))
        after = _digest(large)
        least = cut(few(large.groupBy("u").agg(F.min("v").alias("m"))))
        if after == before and least.count() == after[0]:
            break
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(few(moved.unionByName(least.withColumnRenamed("m", "v")).distinct()))
        before = _digest(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
