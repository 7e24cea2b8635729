"""Interpolated modified Kneser-Ney models of token ids, and the losses of documents under them (base of operators 1 and 4).

Every model's vocabulary is that of a tokenizer, so models share it and no token is unknown.  Counts, continuation counts and
probabilities are tables with a row for each n-gram, sharded by Spark and never gathered; they grow with what was counted.

Documents are scored by joins with these tables, but not token by token: documents are dealt to blocks of a fixed number of bytes by
a hash of their key and text; each block asks for its distinct n-grams, with how often it has them; the answers come from a join with the
tables, and meet the block's documents again by a co-group.  So what is moved is the documents once and a block's
distinct n-grams twice, however often a document or a block repeats them, and a frequent n-gram is a row for each block at most.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import maybe_broadcast, stored
from .tokens import encoded_batches, vocabulary_size

#: Bits of a token in a packed n-gram: its id and 1; 0 stands for the places before a text.  Three tokens fit a long.
BITS = 20
#: Bytes of text in a block.
BLOCK_BYTES = 32 << 20
#: n-grams of a task that are held before they are added up, and after.
HELD, SUMMED = 4 << 20, 2 << 20


def codes(ids: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The packed n-gram that ends at each token of texts that begin at ``offsets`` (which have the end, too)."""
    own = ids.astype(np.int64) + 1
    inside = np.arange(len(own)) - np.repeat(offsets[:-1], np.diff(offsets))
    packed = own.copy()
    for k in range(1, order):
        before = np.zeros(len(own), np.int64)
        before[k:] = own[: max(0, len(own) - k)]
        before[inside < k] = 0
        packed |= before << (BITS * k)
    return packed


def _width(tokenizer: str) -> np.dtype:
    """How ids travel: in 2 bytes where that is enough."""
    vocabulary = vocabulary_size(tokenizer)
    if vocabulary >= (1 << BITS) - 1:
        raise ValueError(f"ids must be below {(1 << BITS) - 1}")
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def placed(docs: DataFrame, tokenizer: str, *columns: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, ``columns``, n_ids and ids (token ids, compressed) of each row of ``docs`` (the columns and text), dealt out by block.

    A row's block follows from its columns and text alone, so it is the same in each evaluation.
    """
    width = _width(tokenizer)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64(*columns, "text"), F.lit(size // block_bytes + 1)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]):
        for rows, counts, ids in encoded_batches(batches, tokenizer):
            raw, ends = memoryview(ids.astype(width).tobytes()), width.itemsize * np.cumsum(counts)
            packed = [pa.compress(raw[e - width.itemsize * n : e], "zstd", asbytes=True) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(counts, pa.int32()), pa.array(packed, pa.binary())], ["block", *columns, "n_ids", "ids"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(block.alias("block"), *columns, "text").mapInArrow(run, f"block int, {kinds}, n_ids int, ids binary").repartition("block")


def _slices(rows, width: np.dtype, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, ids, offsets of rows) of :func:`placed` rows, about ``most`` ids at a time."""
    n, packed = np.asarray(rows.column("n_ids")).astype(np.int64), rows.column("ids")
    ends, first = np.cumsum(n), 0
    while first < len(n):
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        raw = [pa.decompress(x, int(k) * width.itemsize, "zstd", asbytes=True) for x, k in zip(packed.slice(first, stop - first).to_pylist(), n[first:stop], strict=True) if k]
        yield first, stop, np.frombuffer(b"".join(raw), width), np.concatenate([[0], np.cumsum(n[first:stop])])
        first = stop


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, and the sums of their counts (a row for each)."""
    keys, at = np.unique(grams, return_inverse=True)
    return keys, np.stack([np.bincount(at, c, len(keys)).astype(np.int64) for c in counts.T], 1) if counts.shape[1] else np.zeros((len(keys), 0), np.int64)


def asked(rows: DataFrame, tokenizer: str, order: int, flags: Sequence[str] = ()) -> DataFrame:
    """block, gram and, by flag, n: the distinct n-grams of each block of :func:`placed` rows, and how often they stand in rows where a flag is true.

    A block's n-gram is more than one row only if a task holds very many of them.
    """
    width, names = _width(tokenizer), [f"n_{f}" for f in flags]

    def batches_of(done: dict):
        for block, (keys, counts) in done.items():
            for i in range(0, len(keys), 1 << 16):
                own = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block), pa.int32()), pa.array(own), *(pa.array(c) for c in counts[i : i + (1 << 16)].T)], ["block", "gram", *names])

    def run(batches: Iterator[pa.RecordBatch]):
        new: dict[int, list] = defaultdict(list)
        done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def add_up():
            for block, parts in new.items():
                distinct = [_summed(g, c) for g, c in parts]
                before = [done[block]] if block in done else []
                done[block] = _summed(*(np.concatenate(x) for x in zip(*before, *distinct, strict=True)))
            new.clear()

        for batch in batches:
            blocks = np.asarray(batch.column("block"))
            marks = np.stack([np.asarray(batch.column(f).fill_null(False).to_numpy(zero_copy_only=False), bool) for f in flags], 1) if flags else np.zeros((len(batch), 0), bool)
            for first, stop, ids, offsets in _slices(batch, width):
                grams, sizes = codes(ids, offsets, order), np.diff(offsets)
                for block in np.unique(blocks[first:stop]).tolist():
                    mine = np.repeat(blocks[first:stop] == block, sizes)
                    new[block].append((grams[mine], np.repeat(marks[first:stop], sizes, 0)[mine].astype(np.int64)))
                held += len(grams)
                if held > HELD:
                    add_up()
                    held = 0
                    if sum(len(k) for k, _ in done.values()) > SUMMED:
                        yield from batches_of(done)
                        done.clear()
        add_up()
        yield from batches_of(done)

    return rows.mapInArrow(run, ", ".join(["block int", "gram long", *(f"{n} long" for n in names)]))


def counts_of(docs: DataFrame, tokenizer: str, order: int, name: str) -> DataFrame:
    """gram and ``name``: how often each n-gram stands in all texts of ``docs`` (text).  Tasks add up what they read; nothing but distinct n-grams is moved."""
    _width(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]):
        new, keys, counts, held = [], np.zeros(0, np.int64), np.zeros((0, 1), np.int64), 0

        def add_up():
            parts = [(keys, counts), *((g, n[:, None]) for g, n in new)]
            new.clear()
            return _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

        def batches_of():
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16), 0])], ["gram", name])

        for _, sizes, ids in encoded_batches(batches, tokenizer):
            own = np.unique(codes(ids, np.concatenate([[0], np.cumsum(sizes)]), order), return_counts=True)
            new.append(own)
            held += len(own[0])
            if held > SUMMED:
                (keys, counts), held = add_up(), 0
                if len(keys) > SUMMED:
                    yield from batches_of()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = add_up()
        yield from batches_of()

    rows = docs.select("text").mapInArrow(run, f"gram long, {name} long")
    return rows.groupBy("gram").agg(F.sum(name).alias(name))


def counted(rows: DataFrame, flags: Sequence[str] = ()) -> DataFrame:
    """gram, and n by flag, over all blocks of :func:`asked` rows; n-grams that no flag has seen are left out."""
    names = [f"n_{f}" for f in flags]
    return rows.groupBy("gram").agg(*(F.sum(n).alias(n) for n in names)).filter(F.greatest(*names, F.lit(0)) > 0)


def _discounts(level: DataFrame, names: Sequence[str]) -> dict[str, list[float]]:
    """The three discounts of modified Kneser-Ney of each model, from its counts of counts 1 to 4, held between 0 and the count."""
    seen = level.agg(*(F.count_if(F.col(m) == i).alias(f"{m}{i}") for m in names for i in (1, 2, 3, 4))).first()  # one row
    out = {}
    for m in names:
        c = [0, *(seen[f"{m}{i}"] for i in (1, 2, 3, 4))]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0.5
        out[m] = [min(max(i - (i + 1) * y * c[i + 1] / c[i] if c[i] else 0.5 * i, 0.05), i - 0.05) for i in (1, 2, 3)]
    return out


class KneserNey:
    """Models of one order and vocabulary from ``counts`` (gram and a column of counts for each of ``names``), as tables.

    Lower orders count the distinct n-grams one longer.  The shortest is interpolated with one of ``vocabulary`` equally likely ids.  A
    model without counts is uniform.
    """

    def __init__(self, counts: DataFrame, names: Sequence[str], order: int, vocabulary: int):
        self.names, self.order, self.vocabulary = list(names), order, vocabulary
        self.levels, self.direct, self.weights = {order: counts}, {}, {}
        for k in range(order - 1, 0, -1):
            suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")
            self.levels[k] = stored(self.levels[k + 1].groupBy(suffix).agg(*(F.count_if(F.col(m) > 0).alias(m) for m in self.names)), f"grams{k}")
        for k, level in self.levels.items():
            cuts = _discounts(level, self.names)
            of = lambda m, cuts=cuts: F.when(F.col(m) >= 3, cuts[m][2]).when(F.col(m) == 2, cuts[m][1]).when(F.col(m) == 1, cuts[m][0]).otherwise(0.0)
            cut = level.select("gram", F.shiftright("gram", BITS).alias("context"), *self.names, *(of(m).alias(f"{m}_cut") for m in self.names))
            sums = stored(cut.groupBy("context").agg(*(x for m in self.names for x in (F.sum(m).alias(f"{m}_sum"), F.sum(f"{m}_cut").alias(f"{m}_cuts")))), f"sums{k}")
            direct = cut.join(sums, "context").select("gram", *(F.try_divide(F.col(m) - F.col(f"{m}_cut"), F.col(f"{m}_sum")).alias(f"{m}_direct") for m in self.names))
            self.direct[k] = stored(direct, f"direct{k}")
            self.weights[k] = sums.select("context", *(F.try_divide(f"{m}_cuts", f"{m}_sum").alias(f"{m}_weight") for m in self.names))

    def losses(self, wanted: DataFrame) -> DataFrame:
        """The columns of ``wanted`` (gram, and others, which stay) and by model the loss (-ln p) of each n-gram.

        An n-gram that a model hasn't seen has the shorter one's probability under the weight of its context, or as it is if that is new, too.
        """
        out, p = wanted, {m: F.lit(1.0 / self.vocabulary) for m in self.names}
        for k in range(1, self.order + 1):
            short = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
            for table, key, at in ((self.direct[k], "gram", short), (self.weights[k], "context", F.shiftright(short, BITS))):
                named = table.select(F.col(key).alias("_key"), *(F.col(c).alias(f"{c}{k}") for c in table.columns if c != key))
                out = out.join(maybe_broadcast(named, 16 * len(named.columns) * named.count()), at == F.col("_key"), "left").drop("_key")
            p = {m: F.coalesce(F.col(f"{m}_direct{k}"), F.lit(0.0)) + F.coalesce(F.col(f"{m}_weight{k}"), F.lit(1.0)) * p[m] for m in self.names}
        return out.select(*wanted.columns, *((-F.ln(p[m])).alias(m) for m in self.names))


def scored(rows: DataFrame, answers: DataFrame, tokenizer: str, order: int, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``columns``, n_tokens and by model the sum of the losses of each of the :func:`placed` ``rows``.

    answers: block, gram and the losses ``names`` of all n-grams of each block.
    """
    width = _width(tokenizer)

    def run(docs: pa.Table, losses: pa.Table) -> pa.Table:
        by = np.argsort(np.asarray(losses.column("gram")))
        keys, values = np.asarray(losses.column("gram"))[by], [np.asarray(losses.column(m))[by] for m in names]
        parts = [[np.zeros(0)] for _ in names]
        for _, _, ids, offsets in _slices(docs, width):
            at = np.searchsorted(keys, codes(ids, offsets, order))
            for out, value in zip(parts, values, strict=True):
                so_far = np.concatenate([[0.0], np.cumsum(value[at])])
                out.append(so_far[offsets[1:]] - so_far[offsets[:-1]])
        n = docs.column("n_ids").cast(pa.int64())
        return pa.Table.from_arrays([*(docs.column(c) for c in columns), n, *(pa.array(np.concatenate(x)) for x in parts)], [*columns, "n_tokens", *names])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"{kinds}, n_tokens long, {', '.join(f'{m} double' for m in names)}")
