"""The steps of packing: tiers, gaps, windows of a tier's own length, padding and step groups."""

from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from faultline.llm import packing, shared, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def piece(n, row="r", start=0):
    return np.arange(start, start + n, dtype=np.uint32)


def sizes(packer):
    return sorted((tier, tuple(len(p[2]) for p in pieces)) for tier, pieces in packer.closed)


def test_documents_go_to_the_smallest_tier_that_holds_them():
    p = packing.Packer()
    for n in (1, 128, 129, 256, 257, 512, 513, 1023, 1024, 2048 + 130):
        p.add(n, piece(n))
    assert {t: sorted(len(x[2]) for x in own) for t, own in p.waiting.items()} == {512: [257, 512], 256: [129, 130, 256], 128: [1, 128]}
    assert sorted(used for used, _ in p.open) == [513, 1023] and sizes(p) == [(1024, (1024,))] * 3


def test_gaps_are_filled_from_shorter_tiers_whole_pieces_first():
    p = packing.Packer()
    p.add("long", piece(700))
    p.add("a", piece(200))
    p.add("b", piece(100))
    p.add("c", piece(24))
    p.fill()
    assert sizes(p) == [(1024, (700, 200, 24, 100))] or sizes(p) == [(1024, (700, 200, 100, 24))]
    p = packing.Packer()
    p.add("long", piece(1000))
    p.add("x", piece(300))
    p.fill()  # nothing fits whole: 24 ids are cut off, the rest waits in its tier
    assert sizes(p) == [(1024, (1000, 24))] and [len(x[2]) for x in p.waiting[512]] == [276] and p.waiting[512][0][1] == 24


def test_each_tier_is_poured_into_windows_of_its_own_length():
    p = packing.Packer()
    for i in range(5):
        p.add(i, piece(300))
    for i in range(7):
        p.add(10 + i, piece(100))
    p.fill()
    assert Counter(t for t, _ in p.closed) == {512: 2, 128: 5}
    assert all(sum(len(x[2]) for x in pieces) == t for t, pieces in p.closed)
    p.finish()
    held = Counter()
    for tier, pieces in p.closed:
        assert sum(len(x[2]) for x in pieces) <= tier
        for row, _, ids in pieces:
            held[row] += len(ids)
    assert held == {i: 300 for i in range(5)} | {10 + i: 100 for i in range(7)}
    assert sum(sum(len(x[2]) for x in pieces) < tier for tier, pieces in p.closed) <= 1  # one padded window at most


def test_step_groups_are_of_one_size_and_weigh_alike():
    rng = np.random.default_rng(0)
    closed = []
    for tier, n in ((1024, 61), (512, 17), (128, 8)):
        for _ in range(n):
            cuts = np.sort(rng.choice(np.arange(1, tier), int(rng.integers(0, 6)), replace=False))
            closed.append((tier, [(0, 0, x) for x in np.split(np.zeros(tier, np.uint32), cuts)]))
    groups = packing.step_groups(closed, 8)
    tiers, weight, count = {}, Counter(), Counter()
    for (tier, pieces), g in zip(closed, groups, strict=True):
        assert tiers.setdefault(g, tier) == tier
        weight[g] += sum(len(x[2]) ** 2 for x in pieces)
        count[g] += 1
    assert Counter(tiers.values()) == {1024: 8, 512: 3, 128: 1} and max(count.values()) <= 8
    for tier in (1024, 512):
        own = [g for g, t in tiers.items() if t == tier]
        assert max(count[g] for g in own) - min(count[g] for g in own) <= 1
        each = [weight[g] / count[g] for g in own]
        assert max(each) < 1.25 * min(each)
    # Dealt in their order instead, groups are further apart.
    plain = [sum(len(x[2]) ** 2 for _, own in closed[i : i + 8] for x in own) for i in range(0, 56, 8)]
    dealt = [weight[g] for g in sorted(weight) if tiers[g] == 1024 and count[g] == 8]
    assert max(dealt) - min(dealt) < max(plain) - min(plain)


def test_padding_of_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    pieces = packing.pack(docs, PATH)
    windows = pieces.groupBy("sequence_id", "context_size", "step_group").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("n")).collect()
    used, room = sum(r.used for r in windows), sum(r.context_size for r in windows)
    assert {r.context_size for r in windows} <= set(packing.TIERS) and all(r.used <= r.context_size for r in windows)
    assert len({r.sequence_id for r in windows}) == len(windows)
    assert 1 - used / room < 0.005 and sum(r.used < r.context_size for r in windows) <= 3  # one in each task
    assert used == tokens.token_counts(docs, PATH).agg(F.sum("n_tokens")).first()[0] + docs.count()
    groups = Counter((r.step_group, r.context_size) for r in windows)
    assert len(groups) == len({g for g, _ in groups}) and max(groups.values()) <= packing.GROUP


def test_repeated_and_shuffled_rows_are_packed_and_filed_each(spark, tmp_path):
    from collections import defaultdict

    from tokenizers import Tokenizer

    from faultline.llm import idfile

    lib = Tokenizer.from_file(PATH)
    texts = ["one two three " * 200, "x", "", None, "one two three " * 200, "another text " * 30]
    rows = [(i % 4 if i else None, texts[i % 6]) for i in range(60)]
    df = spark.createDataFrame([(*r, i % 7) for i, r in enumerate(rows)], "doc_id long, text string, x int").repartition(5, "x")
    ids = {t: (*lib.encode(t or "", add_special_tokens=False).ids, 0) for t in texts}
    want = Counter((k, ids[t]) for k, t in rows)
    whole = defaultdict(list)
    for r in packing.pack(df, PATH).collect():
        whole[r.doc_id, r.doc_tokens].append(r)
    for (key, n), own in whole.items():  # pieces of like rows cover each place equally often
        same = [(ids_, c) for (k, ids_), c in want.items() if k == key and len(ids_) == n]
        cover = np.zeros(n, int)
        for r in own:
            cover[r.start : r.start + r.length] += 1
        assert (cover == sum(c for _, c in same)).all()
        if len(same) == 1:
            assert all(tuple(r.ids) == same[0][0][r.start : r.start + r.length] for r in own)
    idfile.write_ids(df, PATH, f"file://{tmp_path}/ids", segment_ids=500)
    got = idfile.read_ids(spark, f"file://{tmp_path}/ids").orderBy("start").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == sorted(-1 if k is None else k for k, _ in rows)
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1]]


def test_batches_are_the_sessions_own_afterwards(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with shared.small_batches(spark):
        assert int(spark.conf.get(name)) == 1000
    assert spark.conf.get(name) == before
