"""Token ids as compressed binary blocks (operator 2): an adaptive context-mixing range coder.

A block of up to ``BLOCK`` ids is coded by itself: its model starts empty, so any block can be read alone.  The model has three
predictions of the next id, each as the block has taught it so far: the frequencies of ids (order 0), the id that followed the
last one (order 1) and the id that followed the last two (order 2), the latter two with how sure they are.  They are mixed: an id's
probability is the sum of the three, under weights that stand for how sure orders 1 and 2 are and that move, after each id, towards the
predictions that gave it more.  The range coder writes the id under this mixture.

A block's ids are cut into runs of equal length, which are coded side by side, a numpy lane for each, with one model: each step codes
the next id of every run and then teaches the model all of them.

Layout (little endian): magic ``IDX2``; u32 documents, blocks; u32 CRC-32 of the rest of the head; u32 lengths by document; for each
block u32 ids, lanes, vocabulary, words, CRC-32 of its ids (as u32); then the blocks: u16 words by lane, and the lanes' words (u16).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import maybe_broadcast, small_batches
from .tokens import encoded_batches

MAGIC = b"IDX2"
BLOCK = 1 << 21
#: Ids of a run, so that a whole block has 4096 lanes.
RUN = 512
#: Ids after which a segment ends, at the end of a document.
SEGMENT_IDS = 4 << 20
END_ID = 0
#: Ids must be below this.
MOST_IDS = 1 << 24
_U = np.uint64
_TOP, _LOW, _ALL = _U(1 << 48), _U(1 << 40), _U((1 << 64) - 1)
_W, _WORD = _U(16), _U(48)


def _steps() -> np.ndarray:
    """How cells of orders 1 and 2 change, by the case: (how sure order 2 and order 1 were, 3 bits each; whether they agreed; which was right).

    A right cell gets surer by one, 7 at most; a wrong one half as sure, and is replaced if it wasn't sure at all.
    """
    case = np.arange(512)
    sure, hit = np.stack([(case >> 3) & 7, case >> 6]), np.stack([case & 1, (case >> 1) & 1]) == 1
    step = np.where(hit, np.minimum(sure + 1, 7), sure // 2) - sure
    return (step << 24).astype(np.uint32)


_STEP = _steps()


class Mixture:
    """The model of a block: three predictions and the weights under which they are mixed.

    A cell of orders 1 and 2 has an id and, above 24 bits, how sure it is (0 to 7).  Weights are 256ths.  In the code's range the ids
    that orders 2 and 1 predict come first, each with all that the mixture gives it, and then all other ids in order.
    Places in tables are never beyond them; they are taken with "clip", since numpy takes longer for the check.
    """

    WEIGHT_BITS = 8
    HASH_BITS = 18  # of the cells of order 2 at most, which then stay in a core's cache
    SURE = np.uint32(1 << 24)
    GROWTH = 1.35  # of the steps from one table of frequencies to the next
    WEIGHED = 8  # steps from one set of weights to the next

    def __init__(self, ids: int, lanes: int, vocabulary: int):
        self.bits = max(20, vocabulary.bit_length() + 4)
        self.total_bits = self.bits + self.WEIGHT_BITS
        self.kind = np.int32 if self.total_bits < 31 else np.int64
        self.shift = np.uint32(32 - min(self.HASH_BITS, max(8, ids.bit_length())))
        self.vocabulary, self.seen, self.pending, self.steps, self.due = vocabulary, np.zeros(vocabulary, np.int64), [], 0, 1
        self.cells1, self.cells2 = np.zeros(vocabulary, np.uint32), np.zeros(1 << (32 - int(self.shift)), np.uint32)
        self.credit, self.cases = np.tile(np.array([[8.0], [8.0], [48.0]]), 128), []  # credit of orders 2, 1, 0 by how sure the first two are
        self.last, self.hashed = np.zeros(lanes, np.int64), np.zeros(lanes, np.uint32)
        self._weigh()
        self._count()

    def _weigh(self) -> None:
        """Give the predictions credit for the ids that they foresaw, and take the weights from that."""
        if self.cases:
            none, by1, by2, both = np.bincount(np.concatenate(self.cases), minlength=512).reshape(128, 4).T
            part = self.credit[0] / (self.credit[0] + self.credit[1])
            self.credit += [by2 + both * part, by1 + both * (1 - part), none]
            self.credit[:, self.credit.sum(0) > 4096] /= 2
            self.cases = []
        w2, w1 = np.maximum(1, (self.credit[:2] * 253 / self.credit.sum(0)).astype(self.kind))
        agreed = np.arange(128) % 2 == 1  # then both weights are of one id
        self.w0 = 256 - w2 - w1
        self.mass2, self.mass1 = np.where(agreed, w2 + w1, w2) << self.bits, np.where(agreed, 0, w1) << self.bits

    def _count(self) -> None:
        """Take the frequencies of order 0 from the ids so far; none is 0."""
        if self.pending:
            self.seen += np.bincount(np.concatenate(self.pending), minlength=self.vocabulary)
            self.pending = []
        spare = (1 << self.bits) - self.vocabulary
        freq = 1 + (self.seen * (spare / max(1, int(self.seen.sum())))).astype(np.int64)
        self.freq, self.start, self.slots = freq.astype(self.kind), (np.cumsum(freq) - freq).astype(self.kind), None

    def predict(self, n: int) -> None:
        """Look up the predictions for the first ``n`` lanes."""
        last = self.last[:n]
        self.multiplied = last.astype(np.uint32) * np.uint32(2246822519)
        self.at2 = ((self.multiplied ^ self.hashed[:n]) >> self.shift).astype(np.int64)
        self.was1, self.was2 = self.cells1.take(last, mode="clip"), self.cells2.take(self.at2, mode="clip")
        mask = self.SURE - np.uint32(1)
        self.id1, self.id2 = self.was1 & mask, self.was2 & mask
        same = self.id1 == self.id2
        context = (self.was2 >> np.uint32(24)) << np.uint32(4)
        context |= (self.was1 >> np.uint32(24)) << np.uint32(1)
        context |= same
        self.context = context.astype(np.int64)
        self.weight = self.w0.take(self.context, mode="clip")
        # What the order-0 part has of the predicted ids moves to them; two equal ids are one.
        self.own2, self.own1 = self.freq.take(self.id2.astype(np.int64), mode="clip"), self.freq.take(self.id1.astype(np.int64), mode="clip") * ~same
        self.size2 = self.mass2.take(self.context, mode="clip") + self.weight * self.own2
        self.both = self.size2 + self.mass1.take(self.context, mode="clip") + self.weight * self.own1

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the ids under the mixture, out of 1 << total_bits."""
        self.new = ids.astype(np.uint32)
        self.hit1, self.hit2 = self.new == self.id1, self.new == self.id2
        start = self.start.take(ids, mode="clip")
        start -= self.own2 * (self.id2 < self.new)
        start -= self.own1 * (self.id1 < self.new)
        start = self.both + self.weight * start
        size = self.weight * self.freq.take(ids, mode="clip")
        np.copyto(start, self.size2, where=self.hit1)
        np.copyto(size, self.both - self.size2, where=self.hit1)
        np.copyto(start, 0, where=self.hit2)
        np.copyto(size, self.size2, where=self.hit2)
        return start, size

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids in whose intervals the values lie, start, size), the latter two as :meth:`interval` gives them."""
        if self.slots is None:
            self.slots = np.repeat(np.arange(self.vocabulary, dtype=np.uint16 if self.vocabulary <= 1 << 16 else np.uint32), self.freq)
        by2 = value < self.size2
        out, start, size = self.id1.astype(np.int64), self.size2 * ~by2, self.both - self.size2
        np.copyto(out, self.id2, where=by2)
        np.copyto(size, self.size2, where=by2)
        rest = np.flatnonzero(value >= self.both)
        id1, id2, own1, own2, value, both, weight = (x.take(rest, mode="clip") for x in (self.id1, self.id2, self.own1, self.own2, value, self.both, self.weight))
        at = ((value - both) / weight).astype(np.int64)  # exact: below 2 ** 53
        own_low = own2.copy()
        np.copyto(own_low, own1, where=id1 < id2)
        moved = own_low * (at >= self.start.take(np.minimum(id1, id2).astype(np.int64), mode="clip"))
        moved += (own1 + own2 - own_low) * (at + moved >= self.start.take(np.maximum(id1, id2).astype(np.int64), mode="clip"))
        ids = self.slots.take(at + moved, mode="clip").astype(np.int64)
        out[rest] = ids
        start[rest] = both + weight * (self.start.take(ids, mode="clip") - moved)
        size[rest] = weight * self.freq.take(ids, mode="clip")
        self.new = out.astype(np.uint32)
        self.hit1, self.hit2 = self.new == self.id1, self.new == self.id2
        return out, start, size

    def learn(self, ids: np.ndarray) -> None:
        """ids: those that came, whose interval was the last asked for."""
        n = len(ids)
        case = self.hit2 * np.int64(2)
        case += self.hit1
        case |= self.context << 2
        for cells, at, was, hit, step in ((self.cells1, self.last[:n], self.was1, self.hit1, _STEP[0]), (self.cells2, self.at2, self.was2, self.hit2, _STEP[1])):
            cell = was + step.take(case, mode="clip")
            np.copyto(cell, self.new, where=(was < self.SURE) & ~hit)
            cells[at] = cell
        np.multiply(self.multiplied, np.uint32(3266489917), out=self.hashed[:n])
        self.last[:n] = ids
        self.pending.append(ids)
        self.cases.append(case)
        self.steps += 1
        if self.steps % self.WEIGHED == 0:
            self._weigh()
        if self.steps == self.due:
            self._count()
            self.due = max(self.steps + 1, int(self.steps * self.GROWTH))


def _lanes(n: int) -> tuple[int, np.ndarray]:
    """(lanes, first id of each and the end) of a block of n ids; longer runs first."""
    lanes = -(-n // RUN)
    return lanes, np.cumsum([0, *(n // lanes + (np.arange(lanes) < n % lanes))]) if n else np.zeros(1, np.int64)


def _narrow(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Whether an interval must give out its upper 16 bits before the next id."""
    return ((low ^ (low + width)) < _TOP) | (width < _LOW)


def _cut(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The width, less what would carry over into the upper bits."""
    out = (_U(0) - low) & (_LOW - _U(1))
    np.copyto(out, width, where=(low ^ (low + width)) < _TOP)
    return out


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """The words of a block of ids below ``vocabulary``."""
    lanes, first = _lanes(len(ids))
    steps = int(first[1]) if lanes else 0
    model, low, width = Mixture(len(ids), lanes, vocabulary), np.zeros(lanes, _U), np.full(lanes, _ALL)
    words, used = np.zeros((2 * steps + 8, lanes), np.uint16), np.zeros(lanes, np.int64)
    whole = int(first[-1] - first[-2]) if lanes else 0  # steps that every lane takes
    for t in range(steps):
        n = lanes if t < whole else int((np.diff(first) > t).sum())
        own = ids[first[:n] + t].astype(np.int64)
        model.predict(n)
        start, size = model.interval(own)
        r = width[:n] >> _U(model.total_bits)
        low[:n] += r * start.astype(_U)
        width[:n] = r * size.astype(_U)
        out = np.flatnonzero(_narrow(low[:n], width[:n]))
        while len(out):
            x = low[out]
            words[used[out], out] = x >> _WORD
            used[out] += 1
            y = _cut(x, width[out]) << _W
            x = x << _W
            low[out], width[out] = x, y
            out = out[_narrow(x, y)]
        model.learn(own)
    end = low + (_LOW - _U(1))  # its upper 24 bits lie in the last interval, which is wider than these words' rest
    for k in range(2):
        words[used, np.arange(lanes)] = end >> _U(48 - 16 * k) & _U(0xFFFF if k == 0 else 0xFF00)
        used += 1
    kept = np.arange(len(words))[:, None] < used
    return used.astype("<u2").tobytes() + words.T[kept.T].astype("<u2").tobytes()


def decode_block(raw: bytes, n_ids: int, vocabulary: int) -> np.ndarray:
    """The ids of a block; anything where the words are damaged, which its checksum tells."""
    lanes, first = _lanes(n_ids)
    steps = int(first[1]) if lanes else 0
    used = np.frombuffer(raw, "<u2", lanes).astype(np.int64)
    coded = np.frombuffer(raw, "<u2", offset=2 * lanes)
    if int(used.sum()) != len(coded) or int(used.max(initial=0)) > 2 * steps + 8:
        raise ValueError("a block is damaged")
    words = np.zeros((lanes, int(used.max(initial=0)) + 8), np.uint16)  # zeros where a lane has no more
    words[np.arange(words.shape[1]) < used[:, None]] = coded
    words = words.T.ravel()
    at = np.arange(lanes)

    def word(lane):
        where = at.take(lane, mode="clip")
        at[lane] = where + lanes
        return words.take(where, mode="clip").astype(_U)

    model, low, width, code = Mixture(n_ids, lanes, vocabulary), np.zeros(lanes, _U), np.full(lanes, _ALL), np.zeros(lanes, _U)
    every = np.arange(lanes)
    for _ in range(4):
        code = (code << _W) | word(every)
    ids = np.zeros(n_ids, np.uint32)
    whole = int(first[-1] - first[-2]) if lanes else 0
    for t in range(steps):
        n = lanes if t < whole else int((np.diff(first) > t).sum())
        model.predict(n)
        r = width[:n] >> _U(model.total_bits)
        value = np.minimum((code[:n] - low[:n]) // np.maximum(r, _U(1)), _U((1 << model.total_bits) - 1)).astype(model.kind)
        own, start, size = model.find(value)
        low[:n] += r * start.astype(_U)
        width[:n] = r * size.astype(_U)
        out = np.flatnonzero(_narrow(low[:n], width[:n]))
        while len(out):
            x = low[out]
            y = _cut(x, width[out]) << _W
            code[out] = (code[out] << _W) | word(out)
            x = x << _W
            low[out], width[out] = x, y
            out = out[_narrow(x, y) & (y > _U(0))]
        ids[first[:n] + t] = own
        model.learn(own)
    return ids


def write_segment(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment's bytes; ids below MOST_IDS."""
    if len(ids) and int(ids.max()) >= MOST_IDS:
        raise ValueError(f"ids must be below {MOST_IDS}")
    ids = ids.astype("<u4")
    index, payloads = [], []
    for i in range(0, len(ids), block):
        own = ids[i : i + block]
        vocabulary = int(own.max()) + 1
        payloads.append(encode_block(own, vocabulary))
        index.append(struct.pack("<IIIII", len(own), _lanes(len(own))[0], vocabulary, len(payloads[-1]) // 2, zlib.crc32(own.tobytes())))
    head = struct.pack("<II", len(lengths), len(index))
    rest = lengths.astype("<u4").tobytes() + b"".join(index)
    return MAGIC + head + struct.pack("<I", zlib.crc32(head + rest)) + rest + b"".join(payloads)


def read_head(raw: bytes) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """(lengths by document, (place, bytes, ids, vocabulary, checksum) of each block) of a segment."""
    if len(raw) < 16 or raw[:4] != MAGIC:
        raise ValueError("a segment's head is damaged")
    docs, blocks, crc = struct.unpack_from("<III", raw, 4)
    at = 16 + 4 * docs + 20 * blocks
    if len(raw) < at or zlib.crc32(raw[4:12] + raw[16:at]) != crc:
        raise ValueError("a segment's head is damaged")
    found, place = [], at
    for i in range(blocks):
        n, _, vocabulary, words, check = struct.unpack_from("<IIIII", raw, at - 20 * (blocks - i))
        found.append((place, 2 * words, n, vocabulary, check))
        place += 2 * words
    return np.frombuffer(raw, "<u4", docs, 16), found


def read_block(raw: bytes, place: int, size: int, n: int, vocabulary: int, check: int) -> np.ndarray:
    """The ids of one block of a segment, without any other."""
    if len(raw) < place + size:
        raise ValueError("a block is damaged")
    ids = decode_block(raw[place : place + size], n, vocabulary)
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("a block is damaged")
    return ids


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths by document, ids) of a segment."""
    lengths, blocks = read_head(raw)
    return lengths, np.concatenate([np.zeros(0, np.uint32), *(read_block(raw, *b) for b in blocks)])


def write_ids(docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text, append ``END_ID``, and write segments in ascending ``key`` order under ``path``.

    A row of the table at ``path`` is a segment: part and number (their order is that of the keys), keys (of its
    documents, in order), n_ids, segment (its bytes, as laid out above).  Rows of one key stand in the order
    of their texts' hashes, then of their texts; a null key comes first; a null text is its end id alone; repeated rows stay.  Spark
    commits the table, so a task that runs again leaves no half of a segment.  Other columns aren't read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        part, number, keys, sizes, held = TaskContext.get().partitionId(), 0, [], [], []

        def segment():
            ids = np.concatenate(held)
            out = pa.RecordBatch.from_pylist([{"part": part, "number": number, "keys": list(keys), "n_ids": len(ids), "segment": write_segment(ids, np.array(sizes, np.int64))}], pa.schema([("part", pa.int64()), ("number", pa.int64()), ("keys", pa.list_(key_type)), ("n_ids", pa.int64()), ("segment", pa.binary())]))
            for x in (keys, sizes, held):
                x.clear()
            return out

        for rows, counts, ids in encoded_batches(batches, tokenizer, "text"):
            key_type = rows.column(0).type
            ends = np.cumsum(counts + 1)
            with_end = np.full(int(ends[-1]), END_ID, np.uint32)
            kept = np.ones(len(with_end), bool)
            kept[ends - 1] = False
            with_end[kept] = ids
            keys += rows.column(0).to_pylist()
            sizes += (counts + 1).tolist()
            held.append(with_end)
            if sum(map(len, held)) >= segment_ids:
                yield segment()
                number += 1
        if held:
            yield segment()

    schema = f"part long, number long, keys array<{kind}>, n_ids long, segment binary"
    ordered = docs.select(F.col(key), F.col(text).alias("text")).repartitionByRange(F.col(key), F.xxhash64("text")).sortWithinPartitions(F.col(key).asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first())
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(run, schema).write.mode("overwrite").parquet(path)


def read_ids(spark, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Decode the segments at ``path``: a row for each document with ``key``, start (ids of all documents before it), n_tokens, ids, ids_crc32.

    Without ``with_ids`` the ids are read, and their sums taken, but not returned.  Sums of ids are formed by part first and
    then over the parts, of which there is one for each partition that wrote.  An empty table gives no rows.
    """
    table = spark.read.parquet(path)
    kind = table.schema["keys"].dataType.elementType.simpleString()
    small = table.select("part", "number", "n_ids")
    parts = small.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("of_part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before = small.withColumn("in_part", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts.select("part", "of_part"), "part").select("part", "number", (F.col("in_part") + F.col("of_part")).alias("before"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                sizes, ids = read_segment(row["segment"])
                sizes = sizes.astype(np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                own = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], batch.schema.field("keys").type.value_type), pa.array(ends - sizes + row["before"], pa.int64()), pa.array(sizes), *own, pa.array(crc, pa.int64())], [key, "start", "n_tokens", *["ids"] * with_ids, "ids_crc32"])

    placed = table.select("part", "number", "keys", "segment").join(maybe_broadcast(before, 32 * small.count()), ["part", "number"])
    return placed.select("keys", "segment", "before").mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, {'ids array<int>, ' * with_ids}ids_crc32 long")
