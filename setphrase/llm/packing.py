"""Best-fit packing (4): a configuration linear program over the length histogram.

Pieces of one length are interchangeable, so the packing is solved over the histogram, whose
size is the sequence length and not the corpus. The covering program (each column a multiset of
lengths that fits one sequence) is solved by multiplicative weights; the columns of a round are
knapsacks of the present weights, priced by dynamic programming. Its solution is rounded down,
what that leaves open is solved and rounded again, and the last rest, of less than about one
sequence, is packed best-fit.

Pieces are then dealt to places by their rank within their length: the rank is a sum over
(length, bucket) counts and a rank within the bucket. A length has a bucket for every
BUCKET_ROWS pieces, so one that a third of all rows share is ranked by many tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setphrase.llm.common import cut, whole_texts
from setphrase.llm.tokens import TOKENIZER, encoder, some

BUCKET_ROWS = 2_000
Pattern = tuple[tuple[int, int], ...]  # (length, how many), lengths descending


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing by counts: (pattern, sequences that hold it)."""
    open_: dict[int, Counter] = defaultdict(Counter)  # room -> patterns with so much room
    rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                fits = size // length
                for each, n in ((fits, left // fits), (left % fits, 1)):
                    if each and n:
                        room = size - each * length
                        if not open_[room]:
                            bisect.insort(rooms, room)
                        open_[room][((length, each),)] += n
                break
            room = rooms[i]
            pattern, n = open_[room].popitem()
            each = min(room // length, left)
            use = min(n, left // each)
            if use < n:
                open_[room][pattern] += n - use
            if not open_[room]:
                rooms.pop(i)
            rest = room - each * length
            if not open_[rest]:
                bisect.insort(rooms, rest)
            open_[rest][(*pattern, (length, each))] += use
            left -= use * each
    return [(p, n) for room in sorted(open_) for p, n in sorted(open_[room].items())]


class Pricing:
    """Columns for given prices: dynamic programming over the room, items from the shortest on.

    An item is k pieces of one length; ``most`` bounds how many of a length a column holds (split
    into powers of two). best[r, room] is the worth of the best multiset of the first r items, and
    last[r, room] the last of them that it takes (-1: none).
    """

    def __init__(self, lengths: np.ndarray, worth: np.ndarray, most: np.ndarray, size: int):
        order = np.argsort(lengths, kind="stable")
        self.items = [(int(i), k, k * int(lengths[i])) for i in order.tolist() for k in _powers(int(most[i])) if k * lengths[i] <= size]
        self.size, self.lengths = size, lengths
        self.best = np.zeros((len(self.items) + 1, size + 1), np.float32)
        self.last = np.full((len(self.items) + 1, size + 1), -1, np.int16 if len(self.items) < 1 << 15 else np.int32)
        for r, (i, k, w) in enumerate(self.items):
            old, new = self.best[r], self.best[r + 1]
            gain = old[: size + 1 - w] + np.float32(k * worth[i])
            new[:w] = old[:w]
            np.maximum(gain, old[w:], out=new[w:])
            self.last[r + 1] = self.last[r]
            self.last[r + 1, w:][gain > old[w:]] = r
        # the best column in which an item is the last, and so of the greatest length
        self.worth = np.array([k * worth[i] + self.best[r, size - w] for r, (i, k, w) in enumerate(self.items)])

    def columns(self, share: float) -> Iterator[dict[int, int]]:
        """Columns worth at least ``share`` of the best one, one for each last item, the best first: index of length -> how many."""
        if not len(self.worth):
            return
        for top in np.argsort(-self.worth, kind="stable").tolist():
            if self.worth[top] < share * self.worth.max():
                return
            found: Counter = Counter()
            r, room = top, self.size
            while r >= 0:
                i, k, w = self.items[r]
                found[i] += k
                room -= w
                r = int(self.last[r, room])
            yield found


def _powers(n: int) -> list[int]:
    """Summands by which every number up to n can be made: 1, 2, 4, ... and a rest."""
    made = []
    while n > 0:
        made.append(min(n, 1 << len(made)))
        n -= made[-1]
    return made


def start_prices(lengths: np.ndarray, need: np.ndarray, size: int, blend: float = 0.1, tilt: float = 0.2) -> tuple[np.ndarray, float]:
    """(prices of lengths to start from, lower bound of the linear program's value).

    Sizes are a feasible dual solution, and so are the dual feasible functions that round (k + 1) x / size
    down (an exact multiple keeps its value) and divide by k; the one with the greatest bound is taken, with a small
    part of the sizes so that nothing is worthless. Long pieces are worth a little more than
    their size, so that short ones, which fit anywhere, are left for the end.
    """
    best, bound = lengths / size, float((lengths * need).sum()) / size
    for k in range(1, 100):
        whole, part = np.divmod((k + 1) * lengths, size)
        dual = np.where(part == 0, lengths / size, whole / k)
        value = float((dual * need).sum())
        if value > bound:
            best, bound = dual, value
    return (size * (1 - blend) * best + blend * lengths) * (1 + tilt * lengths / size), bound


def configuration_lp(histogram: dict[int, int], size: int, rate: float = 2.0, share: float = 0.98) -> list[tuple[Pattern, float]]:
    """A fractional cover of the histogram by patterns, by multiplicative weights.

    A length's price starts at its dual price (start_prices) and is
    multiplied by exp(rate x the share of its demand that is open, less the mean share), so a
    length that lags behind becomes worth more. A round prices columns by the knapsack program
    and adds those worth at least ``share`` of the best, each until half of its scarcest length's
    open demand is covered. A column holds a length at most twice, or twice as often as an average
    sequence must if that is more. Rounds end when what is open doesn't fill one sequence, however many that takes:
    each round covers a whole sequence or halves an open demand.
    """
    lengths = np.array(sorted(histogram, reverse=True))
    need = np.array([histogram[int(x)] for x in lengths], float)
    rest, found, prices = need.copy(), Counter(), start_prices(lengths, need, size)[0]
    while True:
        some_ = rest >= 1
        least = float((lengths * rest)[some_].sum()) / size
        if least < 1:
            return list(found.items())
        open_ = rest / need
        worth = prices * np.exp(rate * (open_ - open_[some_].mean()))
        most = np.where(some_, np.minimum(np.floor(rest), np.maximum(2, np.ceil(2 * rest / least))), 0).astype(int)
        for column in Pricing(lengths, worth, most, size).columns(share):
            i, k = np.fromiter(column, int, len(column)), np.fromiter(column.values(), float, len(column))
            bound = float((rest[i] / k).min())
            if bound < 1:
                continue
            amount = bound if bound < 2 else bound / 2
            rest[i] -= k * amount
            found[tuple(sorted(((int(lengths[j]), n) for j, n in column.items()), reverse=True))] += amount


def solve(histogram: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences hold each; every length of the histogram is placed exactly as often as it occurs.

    The program's amounts are rounded down and what that leaves open is a program of its own,
    until a program yields no whole sequence; the rest (less than about one sequence) is put
    where it fits best.
    """
    full = histogram.get(size, 0)
    rest = {x: n for x, n in histogram.items() if n and x < size}
    made: Counter = Counter()
    while rest:
        before = made.total()
        for pattern, amount in configuration_lp(rest, size):
            n = min([int(amount + 1e-9), *(rest.get(x, 0) // k for x, k in pattern)])
            if n > 0:
                made[pattern] += n
                for x, k in pattern:
                    rest[x] -= n * k
        rest = {x: n for x, n in rest.items() if n}
        if made.total() == before:
            break
    for pattern, n in best_fit(rest, size):
        made[pattern] += n
    return [(((size, 1),), full)] * bool(full) + list(made.items())


def places(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, end, base, each, at): pieces of a length ranked first..end-1 lie ``each`` to a sequence from sequence ``base`` on, the first at offset ``at``."""
    rows, base, done = [], 0, Counter()
    for pattern, n in patterns:
        at = 0
        for length, each in pattern:
            rows.append((length, done[length], done[length] + n * each, base, each, at))
            done[length] += n * each
            at += length * each
        base += n
    return rows


def cut_pieces(docs: DataFrame, size: int, end_id: int, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """Rows (doc, piece, start, length, crc): a document's ids and end_id, cut only if longer than size."""

    tail = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for first, part in some(texts):
                rows, piece, start, length, crc = [], [], [], [], []
                for i, raw in enumerate(enc.ids(part)):
                    ids = memoryview(np.frombuffer(raw + tail, "<u2").astype("<u4").tobytes())
                    n = len(ids) // 4
                    for k, a in enumerate(range(0, n, size)):
                        b = min(n, a + size)
                        rows.append(first + i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc", "piece", "start", "length", "crc"])

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return whole_texts(source).mapInArrow(run, "doc long, piece int, start long, length long, crc long")


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    A null or empty text is one piece that holds end_id alone. Rows with a null id and rows that
    repeat an id are packed like any other. An empty table gives no rows; other columns are
    ignored. What is collected is the histogram (at most ``size`` rows). What is broadcast are the
    buckets of each length (at most ``size`` rows) and the places: an entry for each length of each
    pattern, and each pattern covers a sequence or halves an open demand, so their number grows
    with size x log(pieces). The sums that ranks start from are joined on the ranks' own
    partitioning.
    """
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, size, end_id, id_col, text_col, tokenizer))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = places(solve(histogram, size))
    dealt = spark.createDataFrame(rows, "length long, first long, end long, base long, each int, at long")
    split = spark.createDataFrame([(x, -(-n // bucket_rows)) for x, n in histogram.items()], "length long, buckets long")
    keyed = pieces.join(F.broadcast(split), "length").withColumn("bucket", F.pmod(F.xxhash64("doc", "piece", "crc"), F.col("buckets")).cast("int")).drop("buckets")
    sums = cut(keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc", "piece", "crc")
    ranked = keyed.withColumn("r", F.row_number().over(order) - 1).join(bases, ["length", "bucket"])
    ranked = ranked.withColumn("r", F.col("r") + F.col("before")).drop("before", "bucket")
    found = ranked.join(F.broadcast(dealt), (ranked["length"] == dealt["length"]) & (F.col("r") >= F.col("first")) & (F.col("r") < F.col("end"))).drop(dealt["length"])
    k = F.col("r") - F.col("first")
    return found.select(
        F.col("doc").alias(id_col),
        "piece",
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        (F.col("base") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + k % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
