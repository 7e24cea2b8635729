"""Hierarchical multi-length packing of tokenised documents (operator 5).

Documents go to context-size tiers: whole long windows first, then what is left of a document
to the smallest tier that holds it.  Gaps of long windows are filled from shorter tiers, whole pieces
first; what stays in a tier is poured into windows of its own length.  Every task packs its own
rows, so nothing is shuffled and a lost task can be run again alone.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoded_batches

TIERS = (1024, 512, 256, 128)
GROUP = 8
END_ID = 0


class Packer:
    """Packs pieces (row, start, ids); ``closed`` has the windows that are done as (context size, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.long = tiers, tiers[0]
        self.open: list[list] = []  # long windows with a gap: [used, pieces]
        self.waiting: dict[int, list] = {t: [] for t in tiers[1:]}
        self.closed: list[tuple[int, list]] = []

    def add(self, row, ids: np.ndarray) -> None:
        whole = len(ids) // self.long * self.long
        for start in range(0, whole, self.long):
            self.closed.append((self.long, [(row, start, ids[start : start + self.long])]))
        if rest := len(ids) - whole:
            piece = (row, whole, ids[whole:])
            fits = [t for t in self.waiting if t >= rest]
            if fits:
                self.waiting[min(fits)].append(piece)
            else:
                self.open.append([rest, [piece]])

    @staticmethod
    def _cut(piece, n: int):
        row, start, ids = piece
        return (row, start, ids[:n]), (row, start + n, ids[n:])

    def fill(self) -> None:
        """Fill gaps of long windows from shorter tiers, then pour each tier into windows of its own."""
        still = []
        for window in self.open:
            gap = self.long - window[0]
            for tier in self.tiers[1:]:
                own = self.waiting[tier]
                while own and len(own[-1][2]) <= gap:
                    gap -= len(own[-1][2])
                    window[1].append(own.pop())
            for tier in reversed(self.tiers[1:]):
                own = self.waiting[tier]
                if gap and own:  # every piece left is longer than the gap: one is cut
                    head, tail = self._cut(own.pop(), gap)
                    window[1].append(head)
                    self.waiting[min(t for t in self.waiting if t >= len(tail[2]))].append(tail)
                    gap = 0
            window[0] = self.long - gap
            if gap:
                still.append(window)
            else:
                self.closed.append((self.long, window[1]))
        self.open = still
        for tier, own in self.waiting.items():
            self.waiting[tier] = self._pour(own, tier)

    def _pour(self, pieces: list, size: int) -> list:
        """Windows of exactly ``size``; returns the pieces that fill none."""
        window, room = [], size
        for piece in pieces:
            while piece is not None and len(piece[2]) >= room:
                head, tail = self._cut(piece, room)
                self.closed.append((size, [*window, head]))
                window, room, piece = [], size, tail if len(tail[2]) else None
            if piece is not None:
                window.append(piece)
                room -= len(piece[2])
        return window

    def settle(self) -> None:
        """Copies what waits, so that a batch's arrays can go."""
        own = lambda p: (p[0], p[1], p[2].copy())
        self.open = [[used, [own(p) for p in pieces]] for used, pieces in self.open]
        self.waiting = {t: [own(p) for p in pieces] for t, pieces in self.waiting.items()}

    def finish(self) -> None:
        """Pour all that waits into the longest windows that it fills; one padded window at most stays."""
        rest = [p for _, pieces in self.open for p in pieces] + [p for pieces in self.waiting.values() for p in pieces]
        self.open, self.waiting = [], {t: [] for t in self.waiting}
        for tier in self.tiers:
            rest = self._pour(rest, tier)
        if rest:
            self.closed.append((self.long, rest))


def step_groups(closed: list[tuple[int, list]], size: int) -> list[int]:
    """A group for each window: windows of one context size, dealt to and fro by attention cost so that groups weigh alike."""
    by_tier, out, first = defaultdict(list), [0] * len(closed), 0
    for i, (tier, pieces) in enumerate(closed):
        by_tier[tier].append((sum(len(p[2]) ** 2 for p in pieces), i))
    for tier in sorted(by_tier):
        own = sorted(by_tier[tier], key=lambda x: (-x[0], x[1]))
        groups = -(-len(own) // size)
        for rank, (_, i) in enumerate(own):
            lap, at = divmod(rank, groups)
            out[i] = first + (groups - 1 - at if lap % 2 else at)
        first += groups
    return out


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, group: int = GROUP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack the ids of all documents, each followed by ``END_ID``, into windows of ``tiers``.

    A row for each piece: ``key``, start (its document's ids before it), length, ids (the piece's ids),
    ids_crc32, doc_tokens, sequence_id, offset, context_size, step_group.  Every id lies in exactly one
    piece.  A null or empty text is its end id alone; repeated rows are packed each; a null key
    stays null; an empty table gives no rows; other columns aren't read.  sequence_id and
    step_group are numbered within the task and carry its number in the upper bits.
    """
    names = [key, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context_size", "step_group"]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        packer, base, seen = Packer(tiers), TaskContext.get().partitionId() << 33, [0, 0]

        def out():
            closed, packer.closed = packer.closed, []
            if not closed:
                return
            groups = step_groups(closed, group)
            rows = []
            for (tier, pieces), g in zip(closed, groups, strict=True):
                offset = 0
                for (doc, n), start, ids in pieces:
                    rows.append((doc, start, len(ids), ids.tobytes(), n, base + seen[0], offset, tier, base + seen[1] + g))
                    offset += len(ids)
                seen[0] += 1
            seen[1] += max(groups) + 1
            doc, start, length, raw, n, seq, offset, tier, g = zip(*rows, strict=True)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.frombuffer(b"".join(raw), np.uint32).astype(np.int32)))
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(doc, own_type[0]), long(start), long(length), flat, long([zlib.crc32(x) for x in raw]), long(n), long(seq), long(offset), long(tier), long(g)], names)

        own_type = [pa.int64()]
        for rows, counts, ids in encoded_batches(batches, tokenizer, "text"):
            own_type[0] = rows.column(0).type
            ends = np.cumsum(counts + 1)
            with_end = np.full(int(ends[-1]), END_ID, np.uint32)
            kept = np.ones(len(with_end), bool)
            kept[ends - 1] = False
            with_end[kept] = ids
            for doc, n, end in zip(rows.column(0).to_pylist(), (counts + 1).tolist(), ends.tolist(), strict=True):
                packer.add((doc, n), with_end[end - n : end])
            packer.fill()
            packer.settle()
            yield from out()
        packer.finish()
        yield from out()

    schema = f"`{key}` {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context_size long, step_group long"
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, schema)
