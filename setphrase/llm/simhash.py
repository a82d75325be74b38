"""SimHash near-dedup (6) by the generalised pigeonhole principle.

A fingerprint is split into partitions, whose number depends on how many fingerprints there are:
few wide ones for many, so that a cell (a value of a partition) holds few of them. Bits that are
correlated over all fingerprints share a partition, so that the others tell more apart. Two
fingerprints within ``tau`` bits of each other agree up to T_i bits in some partition i of m
whenever the thresholds T_i of the one (-1: partition not probed) add up to tau - m + 1. Each
fingerprint gets the thresholds that promise it the fewest candidates, by dynamic programming over
the partitions on a histogram of partition values (their first 16 bits, so at most 65,536 counts
a partition, whatever the input).

A fingerprint is listed in the cell of its own value in each partition, and probes the cells
within T_i bits of it. Cells with more than BLOCK rows, listed and probing, are compared block by
block; what a block emits is a spanning forest of the links that it verified, at most a row for
each member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setphrase.llm.common import Forest, connected_components, cut, sieve, sifted, spread_join, whole_texts, without

BITS, COUNTED = 64, 16
BLOCK = 2048
CHUNK = 1024
CELLS_SENT = 1_000_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORDS_AT_ONCE = 200_000
MEMBERS, LETTERS = 512, 4_000_000
BANDS, BAND_ROWS = 20, 5
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle of a UTF-8 text, in order and with repeats, in bounded runs."""
    words = text.translate(LOWER).split()  # bytes.split() cuts at exactly [\\x20\\x09-\\x0D]
    if not words:
        return
    if len(words) < shingle:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
        return
    for first in range(0, len(words) - shingle + 1, WORDS_AT_ONCE):
        part = words[first : first + WORDS_AT_ONCE + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(part) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit b is 1 if set in over half the shingle hashes; 0 for a text without words."""
    n, votes = 0, np.zeros(BITS, np.int64)
    for h in shingle_hashes((text or "").encode("utf-8", "surrogatepass"), shingle):
        n += len(h)
        votes += bit_counts(h)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0]) if n else 0


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fp): the fingerprint as a signed long. Whole texts, a document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["id", "fp"])

    return whole_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, "id long, fp long")


def _correlations(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """Sums over all fingerprints of products of bits: 64 x 64 counts, summed by the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS), np.int64)
        for frame in frames:
            for at in range(0, len(frame), 65_536):
                part = np.ascontiguousarray(frame["fp"].to_numpy(np.int64)[at : at + 65_536])
                x = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (x.T @ x).astype(np.int64)
        yield pd.DataFrame({"cell": np.arange(BITS * BITS), "n": total.ravel()})

    sums = distinct.select("fp").mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros(BITS * BITS, np.int64)
    both[sums["cell"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return both.reshape(BITS, BITS), distinct.count()


def widths(n: int, tau: int) -> list[int]:
    """Widths of the partitions that promise the least work for n evenly spread fingerprints: a row for each cell probed, and candidates, of which a row is worth fifty."""

    def cost(parts: int) -> float:
        each = _even(BITS, parts)
        return sum(sum(comb(w, r) for r in range(t + 1)) * (1 + n / 2**w / 50) for w, t in zip(each, _even(tau + 1, parts, -1)))

    return _even(BITS, min(range(2, min(tau + 1, 8) + 1), key=cost) if tau else 1)


def _even(total: int, parts: int, plus: int = 0) -> list[int]:
    return [total // parts + (i < total % parts) + plus for i in range(parts)]


def group_bits(both: np.ndarray, n: int, sizes: list[int]) -> list[list[int]]:
    """Groups of bits of these sizes: each starts with the most correlated free pair and takes the free bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    correlation = np.divide(both / max(n, 1) - np.outer(p, p), spread, out=np.zeros((BITS, BITS)), where=spread > 0)
    correlation = np.abs(correlation)
    np.fill_diagonal(correlation, -1)
    free, groups = list(range(BITS)), []
    for size in sizes:
        pairs = correlation[np.ix_(free, free)]
        i, j = divmod(int(pairs.argmax()), len(free))
        group = [free[i], free[j]]
        while len(group) < size:
            rest = [b for b in free if b not in group]
            group.append(rest[int(correlation[np.ix_(rest, group)].mean(1).argmax())])
        groups.append(sorted(group))
        free = [b for b in free if b not in group]
    return groups


def part_values(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The value of each partition: (len(groups), n)."""
    out = np.zeros((len(groups), len(fp)), np.int64)
    x = fp.view(np.uint64)
    for g, group in enumerate(groups):
        for k, b in enumerate(group):
            out[g] |= ((x >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


@cache
def ball(width: int, radius: int) -> np.ndarray:
    """The masks of exactly so many bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def counted(value: np.ndarray, width: int) -> np.ndarray:
    """The bits of a value by which it is counted in the histogram."""
    return value >> max(0, width - COUNTED)


def thresholds(values: np.ndarray, histogram: np.ndarray, tau: int, sizes: list[int]) -> np.ndarray:
    """(partitions, n) thresholds from -1 to tau that add up to tau - partitions + 1, with the fewest candidates and probes.

    cost[i, t + 1] estimates what threshold t in partition i brings: the fingerprints in the
    cells within t bits, and one for each cell probed. Least sums are carried from partition to
    partition (dynamic programming over the sum so far).
    """
    parts, n = values.shape
    cost = np.zeros((parts, tau + 2, n))
    for i, width in enumerate(sizes):
        share = 2.0 ** -max(0, width - COUNTED)  # of a counted value's fingerprints, in one of its cells
        for t in range(tau + 1):
            if t > width:
                cost[i, t + 1] = np.inf
                continue
            # cells at exactly t bits; a ball of 3 bits in 16 has 697 cells
            at = sum((histogram[i][counted(values[i] ^ m, width)] * share for m in ball(width, t)), np.zeros(n)) if t < 2 else np.full(n, histogram[i].sum() * comb(width, t) / 2**width)
            cost[i, t + 1] = cost[i, t] + at + comb(width, t)
    goal = tau + 1  # thresholds counted from -1
    best, choice = np.full((goal + 1, n), np.inf), []
    best[0] = 0
    for i in range(parts):
        new, pick = np.full((goal + 1, n), np.inf), np.zeros((goal + 1, n), np.int64)
        for s in range(goal + 1):
            for t in range(min(tau + 1, s) + 1):
                c = best[s - t] + cost[i, t]
                better = c < new[s]
                new[s] = np.where(better, c, new[s])
                pick[s] = np.where(better, t, pick[s])
        best = new
        choice.append(pick)
    out, s, cols = np.zeros((parts, n), np.int64), np.full(n, goal), np.arange(n)
    for i in range(parts - 1, -1, -1):
        t = choice[i][s, cols]
        out[i] = t - 1
        s = s - t
    return out


def link_block(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, probe: np.ndarray, listed: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (rep, smaller rep) of the verified links within each key; rows are sorted by (key, rep)."""
    n = len(key)
    first = np.r_[True, key[1:] != key[:-1]] if n else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    end = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n])) if n else np.zeros(0, np.int64)
    forest, here, lag = Forest(n), np.arange(n), 1
    x = fp.view(np.uint64)
    while True:
        here = here[here + lag < end[here]]
        if not len(here):
            break
        there = here + lag
        ok = (np.bitwise_count(x[here] ^ x[there]) <= tau) & ((probe[here] & listed[there]) | (probe[there] & listed[here]))
        if ok.any():
            forest.join(here[ok], there[ok])
        lag += 1
    moved = np.flatnonzero(forest.root != np.arange(n))
    a, b = rep[moved], rep[forest.root[moved]]
    return a[a != b], b[a != b]


def near_links(distinct: DataFrame, tau: int, sizes: list[int] | None = None) -> DataFrame:
    """Links (a, b) that connect, among rows (fp, rep) of different fingerprints, those within tau bits of each other.

    ``sizes`` are the partitions' widths, which add up to 64; without them ``widths`` chooses.
    """
    both, n = _correlations(distinct)
    sizes = sizes or widths(n, tau)
    groups = group_bits(both, n, sizes)

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, values in enumerate(part_values(frame["fp"].to_numpy(np.int64), groups)):
                yield pd.DataFrame({"part": np.int32(p), "value": counted(values, sizes[p]).astype(np.int32)})

    counts = distinct.select("fp").mapInPandas(cells, "part int, value int").groupBy("part", "value").agg(F.count("*").alias("n")).toPandas()
    histogram = np.zeros((len(sizes), 1 << COUNTED), np.int64)
    histogram[counts["part"].to_numpy(np.int64), counts["value"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cell rows of each fingerprint: its own cell in each partition, and those that it probes."""
        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                part_ = frame.iloc[at : at + CHUNK]
                fp, rep = part_["fp"].to_numpy(np.int64), part_["rep"].to_numpy(np.int64)
                values = part_values(fp, groups)
                t = thresholds(values, histogram, tau, sizes)
                for p, width in enumerate(sizes):
                    rows = [(np.arange(len(fp)), values[p], t[p] >= 0, np.ones(len(fp), bool))]
                    for r in range(1, tau + 1):
                        far = np.flatnonzero(t[p] >= r)
                        for m in ball(width, r) if len(far) else ():
                            hit = far[histogram[p][counted(values[p][far] ^ m, width)] > 0]
                            rows.append((hit, values[p][hit] ^ m, np.ones(len(hit), bool), np.zeros(len(hit), bool)))
                    who, value, probe, listed = (np.concatenate(x) for x in zip(*rows))
                    flags = (probe * 1 + listed * 2).astype(np.int8)
                    for cut_ in range(0, len(who), 50_000):
                        some = slice(cut_, cut_ + 50_000)
                        yield pd.DataFrame({"cell": np.int64(p) << 56 | value[some], "fp": fp[who[some]], "rep": rep[who[some]], "flags": flags[some]})

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) < 20_000:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = rows[["cell", "low", "high"]].iloc[-1]
            whole = (rows[["cell", "low", "high"]] != last).to_numpy().any(1)
            yield found(rows[whole])
            held = [rows[~whole]]
        if held:
            yield found(pd.concat(held, ignore_index=True))

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        flags = rows["flags"].to_numpy(np.int8)
        names = [rows[c].to_numpy() for c in ("cell", "low", "high")]
        new = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in names])] if len(rows) else np.zeros(0, bool)
        a, b = link_block(np.cumsum(new), rows["fp"].to_numpy(np.int64), rows["rep"].to_numpy(np.int64), (flags & 1) > 0, (flags & 2) > 0, tau)
        return pd.DataFrame({"a": a, "b": b})

    known = distinct.where("rep is not null")
    dealt = cut(known.mapInPandas(spread, "cell long, fp long, rep long, flags byte"))
    # the rows of a large cell go to each pair of its blocks that holds theirs
    large = cut(dealt.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    large = F.broadcast(large) if large.count() <= CELLS_SENT else large
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = dealt.join(large, "cell", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    paired = other.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "rep", "flags")
    key = ["cell", "low", "high"]
    return cut(paired.repartition(*key).sortWithinPartitions(*key, "rep").mapInPandas(links, "a long, b long").distinct())


def near_groups(prints: DataFrame, tau: int = 3) -> DataFrame:
    """Rows (id, fp, component_id) from rows (id, fp): components of fingerprints within tau bits of each other.

    Equal fingerprints are one node, so copies cost nothing beyond one aggregation. A null id
    never stands for others unless all rows of a fingerprint have one.
    """
    prints = cut(prints)
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    components = connected_components(near_links(distinct, tau))
    named = cut(distinct.join(components, distinct["rep"] == components["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n"))
    return spread_join(prints, named, ["fp"], "n").select("id", "fp", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 3) -> DataFrame:
    """Rows (id, fingerprint, component_id, kept) for every row of docs.

    A null or empty text has fingerprint zero, which links like any other. Rows that repeat an
    id are rows of one document. Rows with a null id are grouped with the others, and a
    fingerprint that only such rows have makes a component of its own, whose id is null.
    """
    found = near_groups(fingerprints(docs, id_col, text_col, shingle), tau)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    runs = list(shingle_hashes((text or "").encode("utf-8", "surrogatepass"), shingle))
    return np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)


def similar_enough(texts: DataFrame, edges: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts (rows k, t) have a Jaccard similarity of word shingles of at least so much."""
    pairs = edges.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = shingle_set(a.as_py(), shingle), shingle_set(b.as_py(), shingle)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def compare_cell(node: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of a left and a right row that are similar enough, of different groups and not connected by an earlier pair."""
    names, label = np.unique(group, return_inverse=True)
    sizes = np.array([len(x) for x in sets], np.int64)
    joined = np.concatenate(sets) if sizes.sum() else np.zeros(0, np.uint64)
    values, flat = np.unique(joined, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    ends = np.cumsum(sizes)
    flag, found = np.zeros(len(values), bool), []
    for a in np.flatnonzero(left):
        mine = flat[ends[a] - sizes[a] : ends[a]]
        flag[mine] = True
        both = np.bincount(owner[flag[flat]], minlength=len(sets))
        flag[mine] = False
        for b in np.flatnonzero(right & (both >= similarity * (sizes[a] + sizes - both))):
            if label[a] != label[b]:
                found.append((int(node[a]), int(node[b])))
                label[label == label[b]] = label[a]
    return found


def missed_links(texts: DataFrame, edges: DataFrame, kept: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Similar pairs (a, b) among the members of a component of ``edges`` that ``kept``, the verified ones, don't connect.

    Members of one verified group need no comparison with each other. The largest group of a
    component is only compared with the rest of it; both are cut into blocks of bounded size.
    """
    groups = connected_components(kept).withColumnRenamed("component", "group")
    placed = connected_components(edges).join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    placed = cut(placed.join(texts.select(F.col("k").alias("node"), F.length("t").alias("size")), "node"))
    sums = placed.groupBy("component", "group").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    whole = sums.groupBy("component").agg(F.max(F.struct("n", "size", "group")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("groups"))
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(MEMBERS)), F.ceil(size / F.lit(LETTERS)), F.lit(1))
    rest = blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"))
    open_ = cut(whole.where("groups > 1").select("component", F.col("main.group").alias("main"), blocks(F.col("main.n"), F.col("main.size")).alias("mains"), rest.alias("rests")))
    rows = placed.join(open_, "component").withColumn("in_main", F.col("group") == F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests")))
    # blocks of the rest come first, those of the largest group after them
    rows = rows.withColumn("own", own + F.when(F.col("in_main"), F.col("rests")).otherwise(0))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("in_main"), F.col("rests")).otherwise(F.col("rests") + F.col("mains")) - 1))
    rows = rows.select("component", "node", "group", "own", other.alias("other"))
    rows = rows.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "group", "own")
    rows = rows.join(texts.withColumnRenamed("k", "node"), "node").select("component", "low", "high", "node", "group", "own", "t")
    key = ["component", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in zip(*batch.columns):
                *cell, node, group, own, text = (x.as_py() for x in row)
                if cell != at:
                    yield found(at, held)
                    at, held = cell, []
                held.append((node, group, own, shingle_set(text, shingle)))
        yield found(at, held)

    def found(cell: list | None, held: list) -> pa.RecordBatch:
        pairs = []
        if len(held) > 1:
            node, group, own = (np.array(x, np.int64) for x in list(zip(*held))[:3])
            pairs = compare_cell(node, group, own == cell[1], own == cell[2], [h[3] for h in held], similarity)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(compare, "a long, b long")


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (id, h, fp, bands): the text's MD5, its fingerprint of three-word shingles, and BANDS fingerprints of minima.

    Each band hashes BAND_ROWS minima of the ``shingle``-word set under different hash functions
    (b = a x + c mod 2**64, the upper bits), so two texts agree in a band with probability J ** BAND_ROWS
    for a Jaccard similarity J, whatever kind of edit parts them. A text without words has none.
    """
    rng = np.random.default_rng(7)
    factor, plus = (rng.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))

    def bands(text: str | None) -> np.ndarray | None:
        least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
        some = False
        for h in shingle_hashes((text or "").encode("utf-8", "surrogatepass"), shingle):
            some = True
            for at in range(0, len(h), CHUNK):
                x = h[at : at + CHUNK]
                x = (x ^ (x >> np.uint64(29))) * P1
                least = np.minimum(least, mixed(x[:, None] * factor + plus).min(0))
        if not some:
            return None
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * P2
        for row in least.reshape(BANDS, BAND_ROWS).T:
            key = mixed(key * P3 + row)
        return key.view(np.int64)

    def mixed(x: np.ndarray) -> np.ndarray:
        return x ^ (x >> np.uint64(32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, keys, ends = np.zeros(len(batch), np.uint64), np.zeros((len(batch), BANDS), np.int64), np.zeros(len(batch) + 1, np.int32)
            for i, t in enumerate(batch.column(2)):
                text = t.as_py()
                made[i], found = fingerprint(text), bands(text)
                if found is not None:
                    keys[ends[i] // BANDS] = found
                ends[i + 1] = ends[i] + (BANDS if found is not None else 0)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()[: ends[-1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made.view(np.int64)), keys], ["id", "h", "fp", "bands"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("h"), F.col(text_col).alias("text"))
    return whole_texts(source).mapInArrow(run, "id long, h binary, fp long, bands array<long>")


def text_hash(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def band_links(banded: DataFrame) -> DataFrame:
    """Links (a, b) of rows (node, bands) that share a band, each with the smallest node of the band."""
    keyed = cut(banded.select("node", F.explode("bands").alias("band")))
    least = cut(keyed.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("band", "b"))
    return keyed.join(least, "band").where("node > b").select(F.col("node").alias("a"), "b").distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 3, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates (its smallest id), with all its columns.

    Fingerprints of three-word shingles within ``tau`` bits propose links, and so do the bands of
    ``shingle``-word sets (J ** BAND_ROWS in each of BANDS); a link counts if the texts'
    ``shingle``-word sets are at least so similar. All pairs that the proposed links connect are
    compared, unless verified links connect them. Two texts without words are equal.
    Texts are the nodes: different texts of one fingerprint are compared like any others.
    A text's rows go except those with its smallest id; null is the largest.
    """
    prints = cut(sketches(docs, id_col, text_col, shingle))
    # numbered in the order of ids, so that the smallest node has the smallest id
    nodes = prints.groupBy("h").agg(F.min("id").alias("first"), F.min("fp").alias("fp"))
    nodes = cut(nodes.orderBy(F.col("first").asc_nulls_last(), "h").withColumn("node", F.monotonically_increasing_id()))
    distinct = cut(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    alike = nodes.join(distinct, "fp").where("node > rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    banded = prints.where("size(bands) > 0").join(nodes.select("h", "node"), "h").select("node", "bands")
    edges = cut(near_links(distinct, tau).unionByName(alike).unionByName(band_links(banded)).distinct())
    # only texts that a link names (by a sieve of the ids) are shuffled
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = cut(nodes.select("h", "first", "node").join(ends, "node"))
    texts = docs.select(F.col(id_col).cast("long").alias("first"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = sifted(texts, "first", cut(sieve(ends, "first"))).where("_hit").select(text_hash("t").alias("h"), "t")
    texts = cut(texts.distinct().join(ends, "h").select(F.col("node").alias("k"), "t"))
    kept = cut(similar_enough(texts, edges, shingle, similarity))
    links = cut(kept.unionByName(missed_links(texts, edges, kept, shingle, similarity)))
    later = connected_components(links).where("node > component").select("node", F.lit(True).alias("later"))
    decided = cut(nodes.join(later, "node", "left").select("h", "first", "later"))
    gone = prints.join(decided, "h").where(F.col("later").isNotNull() | ~F.col("id").eqNullSafe(F.col("first"))).select("id", "h")
    return without(docs, gone, lambda c: c(id_col).cast("long"), lambda c: text_hash(c(text_col)))
