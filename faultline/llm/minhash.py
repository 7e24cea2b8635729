"""MinHash near-duplicates with min-max hashing (operator 7).

Each permutation of a document's shingles gives two values, the least and the greatest, so half as many hash
evaluations fill the signature.  Bands of it bring candidates together; a compact sketch of the signature and the sizes of the
sets drop most that can't be links; what is left is confirmed on the full sets.  Documents are classed by equal sets
first, so copies cost one representative.  In a bucket everything is tried against one member first.  What this leaves in
different components is compared inside tasks, block of a bucket against block: rows are members of blocks, never pairs, so a large
group of texts that are alike but below the threshold costs comparisons and not rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import buffers, by_bytes, hinted, maybe_broadcast, plain, scratch, small_batches, stored, strings

WORDS = 5
#: 64 bands of 6 values of six permutations: two documents at 0.75 share no band with probability (1 - 0.75 ** 6) ** 64 < 4e-6, and sets of
#: 3 of 4 shingles with 1.7e-6, of 6 of 8 with 2.4e-6 (two bands share their permutations, and a small set's minimum isn't its maximum).
BANDS, ROWS = 64, 6
PERMUTATIONS = BANDS * ROWS // 2
#: 64-bit words of a sketch: four bits of every value of the signature.
SKETCH_WORDS = BANDS * ROWS // 16
PERCENT = 75
#: Members that are confirmed beside one copy of their centre's text.
SHARE = 64
#: About the most members, and shingles, of a block of a bucket: larger buckets are dealt into several blocks.
BLOCK_MEMBERS, BLOCK_SHINGLES = 4096, 1 << 22
#: Bits of a band's key that go with a member of a block, to tell the first band that two members share.
SHORT_KEY = (1 << 31) - 1

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit values (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lower-cased, words between ASCII white space.

    A text of fewer words has its whole sequence as one shingle; one without words has none.  Words are hashed to 64 bits and
    shingles from these.
    """
    offsets, data = buffers(plain(column))
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(column)
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = word[inner]
    at = np.flatnonzero(begins)
    kept = np.cumsum(word)
    ends = np.concatenate([kept[at] - 1, kept[-1:]])
    first = np.searchsorted(at, offsets)
    if not len(at):
        return [np.zeros(0, np.uint64)] * len(column)
    coded = strings(ends, low[word]).dictionary_encode()
    values = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    hashed = _mixed(values)[np.asarray(coded.indices)]
    n = len(hashed)
    run = np.zeros(n, np.uint64)
    for k in range(words):
        m = max(0, n - k)
        run[:m] = _mixed(run[:m] * _MIX + hashed[k:])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for i in range(a, b):
                short = _mixed(short * _MIX + hashed[i : i + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation (all minima, then all maxima)."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(a), 2**32 - 1, np.uint32), np.zeros(len(a), np.uint32)
    for i in range(0, len(x), 512):
        y = x[i : i + 512, None] * a + b
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x85EBCA6B)
        np.minimum(low, y.min(0), out=low)
        np.maximum(high, y.max(0), out=high)
    return np.concatenate([low, high])


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row, key, text -> row, key, n (set size), d0, d1 (128-bit digest of the set), sketch (bits of the signature), keys (of the bands)."""
    a, b = _permutations(bands * rows // 2)

    def run(batches: Iterator[pa.RecordBatch]):
        salt = _mixed(np.arange(1, bands + 1, dtype=np.uint64))
        place = np.arange(SKETCH_WORDS * 16, dtype=np.uint64)
        for batch in batches:
            column = plain(batch.column(2))
            for start, stop in by_bytes(column, 2 << 20, 1024):  # a row has 4 KB of values
                sets = shingle_sets(column.slice(start, stop - start), words)
                size = np.array([len(s) for s in sets], np.int64)
                sigs = np.zeros((len(sets), bands * rows), np.uint64)
                digest = np.zeros((len(sets), 2), np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        sigs[i] = signature(s, a, b)
                        digest[i] = _mixed(s).sum(), _mixed(s ^ _MIX).sum()
                sigs[:, len(a) :] = np.roll(sigs[:, len(a) :], -(bands // 2), axis=1)
                # Bands take every bands-th value; the maxima are rolled by half of that, so that they are of other permutations than the minima.
                keys = np.zeros((len(sets), bands), np.uint64)
                for r in range(rows):
                    keys = _mixed(keys * _MIX + sigs[:, r * bands : (r + 1) * bands])
                keys ^= salt
                four = (_mixed(sigs[:, : len(place)] + (place << np.uint64(32))) & np.uint64(15)).astype(np.uint8)
                sketch = np.ascontiguousarray(four[:, ::2] | (four[:, 1::2] << np.uint8(4))).view(np.uint64)
                lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(start, stop - start) for j in (0, 1)), pa.array(size), *(pa.array(np.ascontiguousarray(digest[:, j]).view(np.int64)) for j in (0, 1)), lists(sketch), lists(keys)], ["row", "key", "n", "d0", "d1", "sketch", "keys"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("row", "key", "text").mapInArrow(run, f"row long, key {kind}, n long, d0 long, d1 long, sketch array<long>, keys array<long>")


def _agree(x: str, y: str) -> Column:
    """Values in whose four bits two sketches agree."""

    folded = F.zip_with(F.col(x), F.col(y), lambda a, b: a.bitwiseXOR(b))
    folded = F.transform(folded, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 1)))
    folded = F.transform(folded, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    return F.aggregate(folded, F.lit(16 * SKETCH_WORDS), lambda n, v: n - F.bit_count(v))


def _least_agreement(percent: int) -> int:
    """Values that all but a few in a million pairs at the threshold agree in: one in 16 of the others does so by chance."""
    n, p = SKETCH_WORDS * 16, percent / 100 + (1 - percent / 100) / 16
    return int(n * p - 4.5 * (n * p * (1 - p)) ** 0.5)


def _likely(x: str, y: str, percent: int) -> Column:
    """Whether two rows with columns n and sketch (under prefixes) can be a link."""
    small, large = F.least(f"{x}n", f"{y}n"), F.greatest(f"{x}n", f"{y}n")
    return (small * 100 >= large * percent) & (_agree(f"{x}sketch", f"{y}sketch") >= _least_agreement(percent))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The (x, y) of ``pairs`` whose full sets have 100 * |both| >= percent * |either|.  texts: row, text.

    Members meet one copy of their centre's text in groups of about SHARE, so neither a task nor a text copied over and
    over grows with a centre's number of members.
    """
    counts = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("members"))
    dealt = pairs.join(counts, "x").withColumn("deal", F.pmod(F.xxhash64("y"), F.ceil(F.col("members") / SHARE)))
    wanted = stored(dealt.select("x", "deal", F.col("y").alias("row"), F.lit(1).alias("is_member")).unionByName(dealt.select("x", "deal", F.col("x").alias("row"), F.lit(0).alias("is_member")).distinct()), "wanted")
    held = texts.join(wanted.hint("merge"), "row")  # grows with the texts: shuffled at every size

    def run(batches):
        centre, own = None, None
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            group = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            row, member = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            x, y = [], []
            for start, stop in by_bytes(plain(text), 2 << 20):
                for i, s in enumerate(shingle_sets(text.slice(start, stop - start), words), start):
                    if not member[i]:
                        centre, own = group[i], s
                    elif centre == group[i]:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if both and 100 * both >= percent * (len(own) + len(s) - both):
                            x.append(group[i][0])
                            y.append(row[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    ordered = held.select("x", "deal", "row", "is_member", "text").repartition("x", "deal").sortWithinPartitions("x", "deal", "is_member")
    return ordered.mapInArrow(run, "x long, y long")


def in_blocks(members: DataFrame, most: int = BLOCK_MEMBERS, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Members (band, id, n, ...) once for each pair (i, j) of blocks of their bucket that their own ``block`` is part of."""
    sizes = members.groupBy("band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("n") / shingles)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    short = F.transform("keys", lambda k: k.bitwiseAND(F.lit(SHORT_KEY)).cast("int")).alias("keys")
    return met.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *(c for c in members.columns if c not in ("band", "keys")), short)


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """The runs of rows that agree in the first ``columns`` (integers), each whole."""
    held: list[pa.RecordBatch] = []
    last = None
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        named = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(columns)], 1)
        starts = [0, *(np.flatnonzero((named[1:] != named[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(starts[:-1], starts[1:], strict=True):
            if held and (start or (named[0] != last).any()):
                yield whole()
                held = []
            held.append(batch.slice(start, stop - start))
        last = named[-1]
    if held:
        yield whole()


def _candidates(group: pa.RecordBatch, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of one pair of blocks: a row, and the rows that can be linked with it and first share this very band with it.

    Short keys take two bands for one with a probability below 1e-7; a link is then looked for in that band only.
    """
    column = lambda name: np.asarray(group.column(group.schema.get_field_index(name)))
    table = lambda name: np.asarray(group.column(group.schema.get_field_index(name)).flatten()).reshape(len(group), -1)
    band, i, j = (column(c)[0] for c in ("band", "i", "j"))
    block, component, n, sketch, keys = column("block"), column("component"), column("n"), table("sketch").view(np.uint64), table("keys")
    least, right = _least_agreement(percent), np.flatnonzero(block == j)
    for p in np.flatnonzero(block == i).tolist():
        q = right[right > p] if i == j else right
        q = q[(component[q] != component[p]) & (np.minimum(n[q], n[p]) * 100 >= np.maximum(n[q], n[p]) * percent)]
        differ = sketch[q] ^ sketch[p]
        differ |= differ >> np.uint64(1)
        differ |= differ >> np.uint64(2)
        q = q[16 * SKETCH_WORDS - np.bitwise_count(differ & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64) >= least]
        q = q[keys[p][(keys[q] == keys[p]).argmax(1)] == band & SHORT_KEY]
        if len(q):
            yield p, q


def block_links(members: DataFrame, texts: DataFrame, percent: int = PERCENT, words: int = WORDS, most: int = BLOCK_MEMBERS) -> DataFrame:
    """Links (x, y) that join all components which links within buckets join.

    members: band, id, component, n, sketch, keys; texts: row, text.  Blocks are compared by sketches first; only members with a
    candidate get their texts, and a second pass confirms candidates that aren't in one component yet on the full sets.  Each
    pair is looked at in the first band that it shares.
    """
    met = in_blocks(members, most)

    def sift(batches: Iterator[pa.RecordBatch]):
        for group in _runs(batches, 3):
            chosen = np.zeros(len(group), bool)
            for p, q in _candidates(group, percent):
                chosen[p] = chosen[q] = True
            if chosen.any():
                yield group.filter(pa.array(chosen))

    together = lambda df: df.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    open_members = stored(together(met).mapInArrow(sift, met.schema), "open-members")
    wanted = open_members.select(F.col("id").alias("row")).distinct()
    held = texts.join(maybe_broadcast(wanted, 16 * wanted.count()), "row", "left_semi").withColumnRenamed("row", "id")
    held = open_members.join(held, "id").select(*met.columns, "text")

    def confirm(batches: Iterator[pa.RecordBatch]):
        for group in _runs(batches, 3):
            text = plain(group.column(group.schema.get_field_index("text")))
            sets = [s for start, stop in by_bytes(text, 2 << 20) for s in shingle_sets(text.slice(start, stop - start), words)]
            names, parts = (np.asarray(group.column(group.schema.get_field_index(c))) for c in ("id", "component"))
            parts = parts.copy()
            x, y = [], []
            for p, q in _candidates(group, percent):
                q = q[parts[q] != parts[p]]
                if not len(q):
                    continue
                own, size = sets[p], np.array([len(sets[k]) for k in q])
                met = np.concatenate([sets[k] for k in q])
                found = own[np.minimum(np.searchsorted(own, met), len(own) - 1)] == met
                both = np.add.reduceat(found, np.cumsum(size) - size, dtype=np.int64)
                for k in q[100 * both >= percent * (len(own) + size - both)].tolist():
                    if parts[k] != parts[p]:
                        parts[parts == parts[k]] = parts[p]
                        x.append(names[p])
                        y.append(names[k])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    return together(held).mapInArrow(confirm, "x long, y long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """The component of every row under links of similarity percent / 100 or more: ``key``, n_shingles, component_id, kept.

    component_id is the smallest key of a row that can be reached by links; kept marks rows whose key that is.  Null
    and empty texts, and texts without words, have no shingles and are linked with nothing.  Rows that repeat
    a key are rows of their own; null keys come after others when the smallest is taken, and a component of null keys alone has
    a null id.  An empty table gives no rows; other columns aren't read.
    """
    with scratch():
        base = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")), "rows")  # ids are given once
        sigs = signatures(base, words, bands, rows)
        with small_batches(docs.sparkSession):
            facts = stored(sigs, "signatures", kept=True)
        # Equal sets are one class; its smallest row stands for it.
        classes = stored(facts.filter("n > 0").groupBy("n", "d0", "d1").agg(F.min("row").alias("rep"), F.min("key").alias("least"), F.min_by("sketch", "row").alias("sketch"), F.min_by("keys", "row").alias("keys")), "classes")
        reps = classes.select(F.col("rep").alias("id"), "n", "sketch")
        banded = classes.select(F.col("rep").alias("id"), F.explode("keys").alias("band"))
        shared = stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("centre")).filter("size > 1").select("band", "centre"), "bands")
        buckets = stored(banded.join(shared, "band"), "buckets")
        texts = base.select("row", "text")

        facts_of = lambda name: reps.select(F.col("id").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"))
        stars = buckets.filter("id <> centre").select(F.col("centre").alias("x"), F.col("id").alias("y")).distinct()
        stars = stars.join(facts_of("x"), "x").join(facts_of("y"), "y").filter(_likely("x_", "y_", percent))
        first = stored(stars.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), "stars")
        edges = stored(confirmed(first, texts, percent, words), "links")
        parts = stored(connected(edges), "parts")

        # What one member couldn't join: pairs of a bucket that still stand in different components.
        placed = buckets.select("band", "id").join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_bands = placed.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("band")
        rest = placed.join(open_bands, "band").join(classes.select(F.col("rep").alias("id"), "n", "sketch", "keys"), "id")
        more = stored(block_links(stored(rest, "open-buckets"), texts, percent, words, block_members), "links")
        parts = stored(connected(parts.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(more)), "parts")

        placed = classes.select("n", "d0", "d1", "rep", "least").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        named = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("n", "d0", "d1", "component_id")
        named = stored(named, "named", kept=True)
    out = facts.select("row", "key", "n", "d0", "d1").join(named.withColumnRenamed("component_id", "found"), ["n", "d0", "d1"], "left")
    component = F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("key")).alias("kept"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest key; all columns stay."""
    with scratch():
        kept = stored(near_duplicates(docs, key, text).filter("kept").select(F.col(key).alias("_kept")).distinct(), "kept", kept=True)
    return docs.join(hinted(kept), docs[key].eqNullSafe(kept["_kept"]), "left_semi")
