"""Co-occurrence and selection over blocks of documents, with pairs of terms as numbers.

A block is a run of documents of about BLOCK_TOKENS tokens. Its pairs are counted where it is read
and dealt out as compressed lists of sorted numbers, a list for each part of all pairs; a part
adds up the lists of all blocks, and tells each block which of its own pairs are frequent. Only
lists and the blocks themselves are shuffled, never an occurrence or a token as a row.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setphrase.functions.lineage import cut

#: Tokens of a block, and pairs (repeats included) that a part adds up on average.
BLOCK_TOKENS, PART_PAIRS = 2_000_000, 4_000_000
#: Terms that travel with the tasks at most; about 30 bytes each.
MOST_TERMS = 8_000_000
#: Parts at most into which n-grams are dealt.
MOST_PARTS = 20_000
LISTS = "block string, part int, body binary"


class Terms:
    """A vocabulary (term, term_id, tf), the most frequent terms first; a term's number is its place."""

    def __init__(self, vocab: DataFrame):
        rows = vocab.select("term", "term_id", "tf").where("term is not null").toArrow().combine_chunks()
        rows = rows.sort_by([("tf", "descending"), ("term_id", "ascending")]).combine_chunks()
        self.term, self.id, self.tf = (rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in ("term", "term_id", "tf"))
        self.base = max(1, len(self.term))

    def numbers(self, flat: pa.Array) -> np.ndarray:
        """The number of each token, -1 for those outside the vocabulary."""
        return pc.fill_null(pc.index_in(flat, value_set=self.term), -1).to_numpy(zero_copy_only=False).astype(np.int32)


def packed(keys: np.ndarray, n: np.ndarray | None = None) -> bytes:
    """Ascending keys and their counts (1 or more), compressed."""
    steps = np.diff(keys, prepend=0)
    steps = steps.astype(np.uint32 if len(steps) == 0 or steps.max() < 1 << 32 else np.uint64)
    n = np.zeros(0, np.uint8) if n is None else n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint64)
    a = pa.compress(steps.tobytes(), codec="zstd", asbytes=True)
    return struct.pack("<QBBQ", len(keys), steps.itemsize, n.itemsize, len(a) if len(keys) else 0) + (a + pa.compress(n.tobytes(), codec="zstd", asbytes=True) if len(keys) else b"")


def unpacked(body: bytes, counted: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    size, width, wide, first = struct.unpack_from("<QBBQ", body)
    at = struct.calcsize("<QBBQ")
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opened = lambda raw, kind, w: np.frombuffer(pa.decompress(raw, decompressed_size=size * w, codec="zstd", asbytes=True), f"<u{w}").astype(np.int64)
    keys = np.cumsum(opened(body[at : at + first], "u", width))
    return keys, opened(body[at + first :], "u", wide) if counted else None


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables (doc_id, tokens) of at most so many tokens; a longer document has one of its own."""
    held, n = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for row, size in enumerate(sizes):
            if n and n + size > most:
                yield pa.Table.from_batches([*held, batch.slice(start, row - start)]).combine_chunks()
                held, n, start = [], 0, row
            n += int(size)
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def laid_flat(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens of a table, the row of each, and where each row begins (and the last ends)."""
    column = table.column(1).combine_chunks() if table.num_rows else pa.array([], table.schema.field(1).type)
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), np.repeat(np.arange(len(sizes)), sizes), np.concatenate([[0], np.cumsum(sizes)])


def paired(numbers: np.ndarray, row: np.ndarray, reach: int, base: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distance up to reach: the first places of pairs of known terms in one row, and the pairs' keys."""
    for d in range(1, reach + 1):
        a, b = numbers[:-d], numbers[d:]
        at = np.nonzero((a >= 0) & (b >= 0) & (row[:-d] == row[d:]))[0]
        yield d, at, a[at].astype(np.int64) * base + b[at]


def added_up(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and their counts."""
    if not len(keys):
        return keys, keys
    order = None if n is None else np.argsort(keys, kind="stable")
    keys = np.sort(keys) if order is None else keys[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    sums = np.diff(first, append=len(keys)) if order is None else np.add.reduceat(n[order], first)
    return keys[first], sums


def parts_of(vocab: DataFrame, reach: int) -> int:
    """Into how many parts the pairs of a corpus are dealt; an odd number."""
    total = vocab.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n")).first()["n"]
    return int(total * reach // PART_PAIRS) | 1


def lists(docs: DataFrame, terms, reach: int, parts: int, window: int | None = None) -> DataFrame:
    """(block, part, body): each block's counted pairs in each part; ``terms`` is a broadcast of Terms.

    With a window also its documents, as part -1; pairs beyond the reach but within the window are then listed with a count of 0.

    Blocks are named at random: what needs their names must keep the table.
    """
    most = BLOCK_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for table in pieces(batches, most):
            name = uuid.uuid4().hex
            flat, row, _ = laid_flat(table)
            found = [(d <= reach, keys) for d, _, keys in paired(known.numbers(flat), row, max(reach, window or 0), known.base)]
            beyond = None if (window or 0) <= reach else np.concatenate([np.full(len(k), own, np.int64) for own, k in found])
            keys, n = added_up(np.concatenate([k for _, k in found]), beyond)
            del found, beyond
            part = keys % parts
            order = np.argsort(part, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
            keys, n = keys[order] // parts, n[order]
            bodies = {p: packed(keys[a:b], n[a:b]) for p, (a, b) in enumerate(zip(ends, ends[1:])) if b > a}
            if window is not None:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table)
                bodies[-1] = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(bodies), pa.string()), pa.array(list(bodies), pa.int32()), pa.array(list(bodies.values()), pa.binary())], ["block", "part", "body"])

    return docs.select("doc_id", "tokens").where(F.size("tokens") > 0).mapInArrow(run, LISTS)


def cooccurrences(made: DataFrame, terms, parts: int) -> DataFrame:
    """(t1, t2, id1, id2, freq) of lists."""

    def run(table: pa.Table) -> pa.Table:
        known, part = terms.value, table.column("part")[0].as_py()
        opened = [unpacked(body) for body in table.column("body").to_pylist()]
        keys, n = added_up(np.concatenate([k for k, _ in opened]), np.concatenate([c for _, c in opened]))
        a, b = (pa.array(x) for x in np.divmod(keys * parts + part, known.base))
        return pa.table({"t1": known.term.take(a), "t2": known.term.take(b), "id1": known.id.take(a).cast(pa.int64()), "id2": known.id.take(b).cast(pa.int64()), "freq": pa.array(n, pa.int64())})

    return made.where("part >= 0").groupBy("part").applyInArrow(run, "t1 string, t2 string, id1 long, id2 long, freq long")


def bigrams(docs: DataFrame, reach: int) -> DataFrame | None:
    """(w1, w2, n_ii, n_ix, n_xi, n_xx) of terms up to ``reach`` positions apart in (doc_id, tokens); None if there are more than MOST_TERMS terms.

    Sums of either term are counted by term, not from the pairs; they travel with the tasks.
    """
    counted = cut(first_seen(docs).groupBy("term").agg(F.sum("n").alias("tf")).withColumn("term_id", F.lit(0).cast("long")))
    if counted.count() > MOST_TERMS:
        return None
    context, most = docs.sparkSession.sparkContext, BLOCK_TOKENS
    terms = context.broadcast(Terms(counted))
    parts, base = parts_of(counted, reach), terms.value.base

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, most):
            flat, row, _ = laid_flat(table)
            numbers, n = terms.value.numbers(flat), np.zeros((2, base), np.int64)
            for d, at, _ in paired(numbers, row, reach, base):
                n[0] += np.bincount(numbers[at], minlength=base)
                n[1] += np.bincount(numbers[at + d], minlength=base)
            some = np.nonzero(n.any(axis=0))[0]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0][some]), pa.array(n[1][some])], ["number", "n1", "n2"])

    rows = docs.select("doc_id", "tokens").where(F.size("tokens") > 0)
    sums = rows.mapInArrow(ends, "number long, n1 long, n2 long").groupBy("number").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).toArrow()
    n = np.zeros((2, base), np.int64)
    n[:, sums.column("number").to_numpy()] = np.stack([sums.column("n1").to_numpy(), sums.column("n2").to_numpy()])
    sent = context.broadcast(n)

    def run(table: pa.Table) -> pa.Table:
        known, (first, second), part = terms.value, sent.value, table.column("part")[0].as_py()
        opened = [unpacked(body) for body in table.column("body").to_pylist()]
        keys, freq = added_up(np.concatenate([k for k, _ in opened]), np.concatenate([c for _, c in opened]))
        a, b = np.divmod(keys * parts + part, known.base)
        total = pa.array(np.full(len(keys), first.sum()))
        return pa.table({"w1": known.term.take(pa.array(a)), "w2": known.term.take(pa.array(b)), "n_ii": pa.array(freq), "n_ix": pa.array(first[a]), "n_xi": pa.array(second[b]), "n_xx": total})

    return lists(docs, terms, reach, parts).groupBy("part").applyInArrow(run, "w1 string, w2 string, n_ii long, n_ix long, n_xi long, n_xx long")


def frequent(made: DataFrame, parts: int, least: int) -> DataFrame:
    """(block, part, body): of each block's pairs, those that all blocks together hold at least so often."""

    def run(table: pa.Table) -> pa.Table:
        opened = [unpacked(body) for body in table.column("body").to_pylist()]
        keys, n = added_up(np.concatenate([k for k, _ in opened]), np.concatenate([c for _, c in opened]))
        keys = keys[n >= least]
        kept = [k[_held(k, keys)] for k, _ in opened]
        some = [i for i, k in enumerate(kept) if len(k)]
        return table.take(pa.array(some, pa.int64())).select(["block", "part"]).append_column("body", pa.array([packed(kept[i]) for i in some], pa.binary()))

    return made.where("part >= 0").groupBy("part").applyInArrow(run, LISTS)


def _held(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are among sorted numbers."""
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x


def selected(made: DataFrame, strong: DataFrame, terms, parts: int, min_cooc_freq: int, min_neighbour_cooc: int, window: int, id_type: str) -> DataFrame:
    """(doc_id, tokens, sel, chars): each document with its selected tokens, the others null, and where each token begins in the tokens joined by blanks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, tables = terms.value, []
        lists_ = [unpacked(body, False)[0] * parts + part for part, body in zip(right.column("part").to_pylist(), right.column("body").to_pylist())]
        keys = np.sort(np.concatenate(lists_)) if lists_ else np.zeros(0, np.int64)
        for body in left.column("body").to_pylist():
            table = pa.ipc.open_stream(body).read_all()
            flat, row, starts = laid_flat(table)
            numbers = known.numbers(flat)
            often = known.tf.to_numpy(zero_copy_only=False) >= min_cooc_freq
            numbers = np.where((numbers >= 0) & np.append(often, False)[numbers], numbers, -1)
            if min_neighbour_cooc > 0:
                credit = np.zeros(len(numbers), np.int32)
                for d, at, pairs in paired(numbers, row, window, known.base):
                    at = at[_held(pairs, keys)]
                    credit[at] += 1
                    credit[at + d] += 1
                numbers = np.where(credit >= min_neighbour_cooc, numbers, -1)
            sel = pc.if_else(pa.array(numbers >= 0), flat, pa.scalar(None, flat.type))
            sizes = pc.fill_null(pc.utf8_length(flat), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            before = np.cumsum(sizes) - sizes
            chars = pa.array(before - before[starts[:-1]][row] if len(before) else before)
            ends = pa.array(starts, pa.int32())
            lay = lambda x: pa.ListArray.from_arrays(ends, x)
            tables.append(pa.table({"doc_id": table.column(0), "tokens": lay(flat), "sel": lay(sel), "chars": lay(chars)}))
        return pa.concat_tables(tables)

    docs = made.where("part = -1").groupBy("block")
    return docs.cogroup(strong.groupBy("block")).applyInArrow(run, f"doc_id {id_type}, tokens array<string>, sel array<string>, chars array<bigint>")


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, tf) of (doc_id, tokens): terms are counted by blocks."""

    most = BLOCK_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, most):
            counted = pc.value_counts(laid_flat(table)[0])
            yield pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], ["term", "n"])

    seen = docs.select("doc_id", "tokens").where(F.size("tokens") > 0).mapInArrow(run, "term string, n long")
    return seen.groupBy("term").agg(F.sum("n").alias("tf"))


def first_seen(docs: DataFrame) -> DataFrame:
    """(term, f struct<doc_id, pos>, n) for the distinct terms of each block: where each comes first by (doc_id, pos), and how often it comes."""

    most = BLOCK_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, most):
            flat, row, starts = laid_flat(table)
            order = pc.sort_indices(table.column(0), sort_keys=[("", "ascending")], null_placement="at_start").to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ids = table.column(0).combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            # equal ids are one document: they rank alike
            same = np.concatenate([[0], np.cumsum(~np.asarray(pc.fill_null(pc.equal(ids.take(pa.array(order[1:])), ids.take(pa.array(order[:-1]))), False)))]) if len(order) > 1 else np.zeros(len(order), np.int64)
            rank = same[rank]
            pos = np.arange(len(row)) - starts[:-1][row]
            coded = flat.dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.lexsort((pos, rank[row], code))
            first = place[np.nonzero(np.concatenate([[True], np.diff(code[place]) != 0]))[0]] if len(place) else place
            n = np.bincount(code, minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), ids.take(pa.array(row[first])).cast(pa.int64()), pa.array(pos[first].astype(np.int32)), pa.array(n[code[first]], pa.int64())], ["term", "doc_id", "pos", "n"])

    seen = docs.select("doc_id", "tokens").where(F.size("tokens") > 0).mapInArrow(run, "term string, doc_id long, pos int, n long")
    return seen.select("term", F.struct("doc_id", "pos").alias("f"), "n")


def grams(docs: DataFrame, offsets: list[tuple[int, ...]], least: int = 1) -> DataFrame | None:
    """(terms array, freq) of the n-grams whose terms stand at such offsets in (doc_id, tokens) and that occur at least so often; None if there are more than MOST_TERMS terms.

    An n-gram is a number to the base of the vocabulary, too long for 64 bits: its remainder by
    the number of parts is its part, the quotient its key there.
    """
    counted = cut(term_counts(docs).withColumn("term_id", F.lit(0).cast("long")))
    if counted.count() > MOST_TERMS:
        return None
    terms, most = docs.sparkSession.sparkContext.broadcast(Terms(counted)), BLOCK_TOKENS
    base, n = terms.value.base, len(offsets[0])
    # quotients stay below 2 ** 62
    parts = max(parts_of(counted, len(offsets)), base**n >> 62) | 1
    if parts > MOST_PARTS:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, most):
            flat, row, _ = laid_flat(table)
            numbers = terms.value.numbers(flat).astype(np.int64)
            keys, part = [], []
            for group in offsets:
                at = np.nonzero(row[: max(0, len(row) - group[-1])] == row[group[-1] :])[0]
                whole, over = np.divmod(numbers[at], parts)
                for k in group[1:]:
                    # (whole * parts + over) * base + next, divided by parts again
                    more, over = np.divmod(over * base + numbers[at + k], parts)
                    whole = whole * base + more
                keys.append(whole)
                part.append(over.astype(np.int32))
            keys, part = np.concatenate(keys), np.concatenate(part)
            order = np.argsort(part, kind="stable")
            keys, ends = keys[order], np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
            del order, part
            bodies = {p: packed(*added_up(keys[a:b])) for p, (a, b) in enumerate(zip(ends, ends[1:])) if b > a}
            yield pa.RecordBatch.from_arrays([pa.array([""] * len(bodies), pa.string()), pa.array(list(bodies), pa.int32()), pa.array(list(bodies.values()), pa.binary())], ["block", "part", "body"])

    def total(table: pa.Table) -> pa.Table:
        known, over = terms.value, np.int64(table.column("part")[0].as_py())
        opened = [unpacked(body) for body in table.column("body").to_pylist()]
        whole, freq = added_up(np.concatenate([k for k, _ in opened]), np.concatenate([c for _, c in opened]))
        whole, freq = whole[freq >= least], freq[freq >= least]
        over, found = np.full(len(whole), over), np.empty((len(whole), n), np.int64)
        for k in range(n - 1, 0, -1):
            whole, more = np.divmod(whole, base)
            over, found[:, k] = np.divmod(more * parts + over, base)
        found[:, 0] = whole * parts + over
        lists_ = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * np.int32(n)), known.term.take(pa.array(found.ravel())))
        return pa.table({"terms": lists_, "freq": pa.array(freq, pa.int64())})

    rows = docs.select("doc_id", "tokens").where(F.size("tokens") > 0)
    return rows.mapInArrow(run, LISTS).groupBy("part").applyInArrow(total, "terms array<string>, freq long")
