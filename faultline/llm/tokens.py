"""Token ids and token counts of whole texts with a tokenizer file (operator 8 and the base of 2 and 5).

Byte-level BPE cuts a text by its pattern before it merges, so a text may be split wherever
that pattern always cuts: before a space that a non-space follows, between an ASCII letter
and ASCII punctuation, and around a line end between one of these and a non-space.  A batch is split
there with numpy, its distinct pieces are encoded once by the library, and the ids are laid out again
by piece.  No text is cut anywhere else.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import buffers, by_bytes, plain, strings

#: A Python worker's cache: bits of the number of its slots, the bytes of a slot's piece (the last one is its length), and all ids in it at most.
SLOT_BITS = 20
PIECE_BYTES = 24
CACHE_IDS = 4 << 20
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 3 << 20

_LETTER, _MARK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[c for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)) if c != ord("'")]] = _MARK
# After a space: ASCII white space, or a lead byte under which UTF-8 has white space.
_FOLLOWS = np.ones(256, bool)
_FOLLOWS[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False

_loaded: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of a tokenizer file, one for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


@cache
def vocabulary_size(path: str) -> int:
    """The number of ids of a tokenizer file; the driver asks for it, and keeps no encoder."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def _byte_names() -> dict[int, str]:
    """How byte-level BPE writes each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces:
    """The ids of short pieces: each has one slot by its hash, in which the latest stays; a slot holds the whole piece, so none is taken for another.

    It lasts as long as the worker, whose next task has much the same pieces.  When the ids are full, all go.  Memory is touched as it fills: 30 MB of slots and 16 MB of ids at most.
    """

    def __init__(self):
        self.kept = np.zeros((1 << SLOT_BITS, PIECE_BYTES // 8), np.uint64)
        self.start, self.size = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.uint8)
        self.ids, self.used = np.zeros(CACHE_IDS, np.uint32), 0

    @staticmethod
    def keys(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces as rows of 8 bytes each, their slots); a piece that is too long has a row of zeros."""
        size = np.diff(offsets)
        size = np.where(size < PIECE_BYTES, size, 0)
        at = np.arange(PIECE_BYTES - 1)
        rows = np.zeros((len(size), PIECE_BYTES), np.uint8)
        rows[:, :-1] = np.append(data, np.zeros(PIECE_BYTES, np.uint8))[offsets[:-1, None] + at]
        rows[:, :-1] *= at < size[:, None]
        rows[:, -1] = size
        rows = rows.view(np.uint64)
        h = rows[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        for column in rows.T[1:]:
            h = ((h ^ (h >> np.uint64(29))) + column) * np.uint64(0xBF58476D1CE4E5B9)
        return rows, (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Whether each piece is here."""
        return (self.kept[slots] == rows).all(1) & (rows[:, -1] > 0)

    def put(self, rows: np.ndarray, slots: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Keep pieces that aren't here, whose ids follow each other."""
        if self.used + len(ids) > len(self.ids):
            self.kept[:], self.used = 0, 0
        if len(ids) > len(self.ids):
            return
        self.ids[self.used : self.used + len(ids)] = ids
        starts, order = self.used + np.cumsum(sizes) - sizes, np.arange(len(slots), dtype=np.int32)
        self.used += len(ids)
        self.start[slots] = order
        own = np.flatnonzero(self.start[slots] == order)  # of several for one slot, one
        slots = slots[own]
        self.kept[slots], self.start[slots], self.size[slots] = rows[own], starts[own], sizes[own]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts, starts + 1, ... of each run of these sizes, one run after the other."""
    ends = np.cumsum(sizes)
    place = np.repeat((starts - ends + sizes).astype(np.int32), sizes)  # a batch has far fewer than 2 ** 31 ids, but for one text
    place += np.arange(len(place), dtype=np.int32)
    return place


class Encoder:
    """Encodes string arrays; ``path`` is a tokenizers .json or a sentencepiece .model file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: Pieces | None = None
        self.model = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.specials: list[str] = []
            self.splits = False
            return
        from tokenizers import Tokenizer, pre_tokenizers

        self.pieces = None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = [t.content for t in added]
        # Safe boundaries are those of the byte-level pattern, with nothing that rewrites the text before it.
        self.splits = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.pre_tokenizer.use_regex and not self.tokenizer.pre_tokenizer.add_prefix_space and self.tokenizer.normalizer is None and not any(c.isspace() for s in self.specials for c in s) and not any(t.lstrip or t.rstrip for t in added)
        if self.splits:
            self.model = self.tokenizer.model
            self.names = {ord(bytes([b]).decode("latin-1")): c for b, c in _byte_names().items()}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        if self.pieces is not None:
            return [np.array(x, np.uint32) for x in self.pieces.encode(texts, num_threads=1)]
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids in order).

        A run of Latin letters is one unit of the pattern and goes to the merges at once; the rest takes the whole way.
        """
        merge, others = self.model.tokenize, []
        out: list = [None] * len(texts)
        for i, x in enumerate(texts):
            bare = x[1:] if x[0] == " " else x
            if bare.isalpha() and (x.isascii() or max(bare) < "ɐ"):
                name = x.replace(" ", "Ġ") if x.isascii() else x.encode().decode("latin-1").translate(self.names)
                out[i] = [t.id for t in merge(name)]
            else:
                others.append(i)
        for start in range(0, len(others), 4096):
            some = others[start : start + 4096]
            for i, own in zip(some, self._whole([texts[i] for i in some]), strict=True):
                out[i] = own
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return sizes, np.fromiter(chain.from_iterable(out), np.uint32, int(sizes.sum()))

    def _pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each piece, the place of its first, ids); pieces that the cache doesn't have go to the library."""
        self.known = known = self.known or Pieces()
        rows, slots = known.keys(*buffers(distinct))
        hit = known.find(rows, slots)
        sizes = known.size[slots].astype(np.int64)
        old = known.ids[_spread(known.start[slots[hit]], sizes[hit])]
        new = np.flatnonzero(~hit)
        sizes[new], ids = self._ids_of(distinct.take(pa.array(new)).to_pylist())
        starts = np.zeros(len(sizes), np.int64)
        for some, base in ((np.flatnonzero(hit), 0), (new, len(old))):
            starts[some] = base + np.cumsum(sizes[some]) - sizes[some]
        short = rows[new, -1] > 0
        known.put(rows[new[short]], slots[new[short]], sizes[new[short]], ids[np.repeat(short, sizes[new])])
        return sizes, starts, np.concatenate([old, ids])

    def encode(self, column: pa.Array, lengths_only: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(ids of each text counted, all ids in order); a null is an empty text."""
        column = plain(column)
        if not self.splits:
            ids = self._whole(column.to_pylist()) if len(column) else []
            return np.array([len(x) for x in ids], np.int64), None if lengths_only else np.concatenate([np.zeros(0, np.uint32), *ids])
        offsets, data = buffers(column)
        if not len(data):
            return np.zeros(len(column), np.int64), None if lengths_only else np.zeros(0, np.uint32)
        cut = np.zeros(len(data) + 1, bool)
        kind = _KIND[data]
        cut[1:-1] = ((kind[:-1] == _LETTER) & (kind[1:] == _MARK)) | ((kind[:-1] == _MARK) & (kind[1:] == _LETTER))
        follows = _FOLLOWS[data[1:]]
        cut[:-2] |= (data[:-1] == 32) & follows
        line = np.flatnonzero((data[1:-1] == 10) & (kind[:-2] > 0) & follows[1:]) + 1
        cut[line] = cut[line + 1] = True
        if self.specials:
            raw = column.to_pylist()
            for i, text in enumerate(raw):
                if any(s in text for s in self.specials):  # the library looks for these in the whole text
                    cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets] = True
        at = np.flatnonzero(cut)
        coded = strings(at, data).dictionary_encode()
        index = np.asarray(coded.indices)
        sizes, starts, flat = self._pieces(coded.dictionary)
        count = sizes[index]
        ends = np.concatenate([[0], np.cumsum(count)])
        per_text = np.diff(ends[np.searchsorted(at, offsets)])
        return per_text, None if lengths_only else flat[_spread(starts[index], count)]


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids in each, all their ids), in slices of about ``BATCH_BYTES`` of text."""
    own = encoder(path)
    for batch in batches:
        column = plain(batch.column(batch.schema.get_field_index(text)))
        for start, stop in by_bytes(column, BATCH_BYTES):
            yield batch.slice(start, stop - start), *own.encode(column.slice(start, stop - start))


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """Count the tokens of every whole text; only lengths leave the Arrow function.

    Returns ``key``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), a row for each
    input row: repeated rows stay, a null or empty text has 0 and 0, a null key stays null.  Texts of any
    length are encoded whole, split only where the tokenizer itself always cuts; batches are cut by
    bytes, so that a long text doesn't share its memory with others.  Other columns aren't read.
    """

    def count(batches):
        own = encoder(tokenizer)
        for batch in batches:
            column = plain(batch.column(1))
            size = np.diff(buffers(column)[0])
            n = [own.encode(column.slice(a, b - a), lengths_only=True)[0] for a, b in by_bytes(column, BATCH_BYTES)]
            n = np.concatenate([np.zeros(0, np.int64), *n])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
