"""Operators against brute force on small tables with nulls, empties, ties, repeats and long texts."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from faultline.llm import chat, components, decontaminate, exact_dedup, idfile, lm_score, minhash, ngrams, packing, quality, tokens, url_rules

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
W = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
TEXTS = [" ".join(W), " ".join(W), " ".join(W[:19]) + " changed", "a\t\n b", "a b", "", None, "  ", "short one", "It's <|endoftext|> 1,2 — é日", " ".join(W * 400), "ALPHA " + " ".join(W[1:])]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, name string")


def ids(t):
    return [*LIB.encode(t or "", add_special_tokens=False).ids, 0]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_token_counts(spark):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs(spark), PATH).collect()}
    assert got == {i: (len((t or "").encode()), len(ids(t)) - 1, len(ids(t)) - 1 > 512) for i, t in enumerate(TEXTS)}
    assert tokens.token_counts(docs(spark, []), PATH).count() == 0


def test_token_file(spark, tmp_path):
    idfile.write_ids(docs(spark), PATH, f"file://{tmp_path}/ids", segment_ids=100)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in idfile.read_ids(spark, f"file://{tmp_path}/ids").collect())
    want, start = [], 0
    for i, t in enumerate(TEXTS):
        want.append((i, start, len(ids(t)), crc(ids(t))))
        start += len(ids(t))
    assert got == want


def test_segment_round_trip():
    rng = np.random.default_rng(0)
    words = np.minimum(rng.zipf(1.3, 40_000), 50_000)
    for x in (np.zeros(0, int), np.array([5]), rng.integers(0, 65536, 9000), np.tile([1, 2, 3], 5000), rng.integers(0, 1 << 24, 700), words):
        s = idfile.write_segment(x, np.array([len(x)]), block=4096)
        lengths, got = idfile.read_segment(s)
        assert lengths.tolist() == [len(x)] and got.tolist() == x.tolist()
        blocks = idfile.read_head(s)[1]
        assert len(blocks) == -(-len(x) // 4096)
        for i in range(len(blocks) - 1, -1, -1):  # each alone, in any order, and where the bytes of the others are gone
            place, size, *rest = blocks[i]
            alone = bytes(place) + s[place : place + size]
            assert idfile.read_block(alone, place, size, *rest).tolist() == x[4096 * i : 4096 * (i + 1)].tolist()
    with pytest.raises(ValueError):
        idfile.write_segment(np.array([idfile.MOST_IDS]), np.array([1]))


def test_mixing_takes_less_than_any_order_alone():
    rng = np.random.default_rng(1)
    skewed = rng.choice(np.arange(2000), 60_000, p=(w := 1 / np.arange(1, 2001)) / w.sum())
    chain = np.cumsum(rng.choice([1, 7], 60_000, p=[0.9, 0.1])) % 997  # the last id tells most
    for x, most in ((skewed, 10.4), (chain, 2.2)):
        assert 8 * len(idfile.write_segment(x, np.array([len(x)]))) / len(x) < most


def test_damage_in_each_field():
    x = np.random.default_rng(2).zipf(1.5, 3000) % 5000
    s = idfile.write_segment(x, np.array([1000, 2000]), block=2048)
    for at in [*range(16 + 8 + 40), *range(64, len(s), 397), len(s) - 3]:  # the head's fields, then words
        bad = bytearray(s)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            idfile.read_segment(bytes(bad))
    for size in (0, 3, 20, 100, len(s) - 1):
        with pytest.raises(ValueError):
            idfile.read_segment(s[:size])


def test_packing(spark):
    rows = packing.pack(docs(spark), PATH).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(TEXTS):
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids(t) and all(r.doc_tokens == len(ids(t)) and r.ids_crc32 == crc(r.ids) for r in own)
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in own])
        assert [r.offset for r in own] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_exact_groups(spark):
    key = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    for digest in (F.xxhash64, lambda c: F.lit(1)):  # also where all blocks share a digest
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs(spark), block_bytes=64, digest=digest).collect()}
        for i, t in enumerate(TEXTS):
            same = [j for j, u in enumerate(TEXTS) if key(u) == key(t)]
            assert got[i] == (same[0], len(same), same[0] == i)


def test_near_duplicates(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark)).collect()}
    assert got[0] == (16, 0, True) and got[1] == (16, 0, False) and got[2][1] == 0 and got[11] == (16, 0, False)
    assert got[3] == (1, 3, True) and got[4] == (1, 3, False) and got[5] == (0, 5, True) and got[6] == (0, 6, True) and got[7][0] == 0
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts, base = [], [f"w{k}" for k in range(90)]
    for _ in range(120):  # alike, many of them just below or above the threshold
        own = list(base)
        for k in rng.choice(90, int(rng.integers(1, 4)), replace=False):
            own[k] = f"x{rng.integers(1000)}"
        texts.append(" ".join(own[: int(rng.integers(75, 91))]))
    texts += [texts[5].upper(), None, "w1 w2"]
    split = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    want = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    assert 3 < len(set(want)) < 100
    for block in (16,):  # so that buckets have several blocks
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, texts), block_members=block).collect()}
        assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_bands_of_small_sets(spark):
    texts = [" ".join(f"p{i}w{k}" for k in range(n)) for i in range(300) for n in (7, 8)]  # 3 of 4 shingles
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").select("row", F.col("row").alias("key"), "text")
    keys = {r.row: np.array(r["keys"]) for r in minhash.signatures(df).collect()}
    same = [keys[2 * i] == keys[2 * i + 1] for i in range(300)]
    assert abs(np.mean(same) - 0.75**6) < 0.015  # not (1 / 2) ** 3, as with minimum and maximum of one permutation


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "x long, y long")
    got = {r.node: r.component for r in components.connected(df).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_contaminated_spans(spark):
    items = spark.createDataFrame([(7, " ".join(W[3:16])), (10, "Short ONE"), (3, None), (4, "")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contaminated_spans(docs(spark), items).collect()}
    assert got[0] == (20, 13, ["7"]) and got[8] == (2, 2, ["10"]) and got[6] == (0, 0, []) and got[10] == (8000, 13 * 400, ["7"])
    assert all(r.n_hit == 0 for r in decontaminate.contaminated_spans(docs(spark), items.limit(0)).collect())


def plain_model(texts, order, size):
    """-ln p of each token of a list of ids, by interpolated modified Kneser-Ney in plain Python."""
    grams = lambda w: [tuple([None] * (order - 1) + w)[i : i + order] for i in range(len(w))]
    level = {order: Counter(g for w in texts for g in grams(w))}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    cuts = {}
    for k, n in level.items():
        c = [0, *(sum(v == i for v in n.values()) for i in (1, 2, 3, 4))]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0.5
        cuts[k] = [0, *(min(max(i - (i + 1) * y * c[i + 1] / c[i] if c[i] else 0.5 * i, 0.05), i - 0.05) for i in (1, 2, 3))]

    def p(g):
        k = len(g)
        if not k:
            return 1 / size
        same = {h: v for h, v in level[k].items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        cut = lambda v: cuts[k][min(v, 3)]
        return (max(same.get(g, 0) - cut(same.get(g, 0)), 0) + sum(map(cut, same.values())) * p(g[1:])) / sum(same.values())

    return lambda w: [-np.log(p(g)) for g in grams(w)]


SIZE = LIB.get_vocab_size(with_added_tokens=True)
SOME = np.random.default_rng(8)
SCORED = [" ".join(SOME.choice(W[:12], int(SOME.integers(1, 25)))) for _ in range(25)] + ["new words\there", "", None, " \n ", "É é 日本 alpha", W[0], W[0]]


def test_scores_against_a_plain_model(spark):
    flags = [i % 3 == 0 for i in range(len(SCORED))]
    rows_in = [(i, t, f) for i, (t, f) in enumerate(zip(SCORED, flags, strict=True))]
    rows_in += [rows_in[0], (None, SCORED[1], None)]  # a repeated row, and one without key and flag
    df = spark.createDataFrame(rows_in, "doc_id long, text string, is_target boolean")
    fold = {r.text: r.fold for r in df.select("text", lm_score.fold_of(F.col("text")).alias("fold")).collect()}
    assert {*fold.values()} == {0, 1}
    split = [ids(t)[:-1] for _, t, _ in rows_in]
    for order, none in ((1, False), (2, False), (3, False), (2, True)):
        used = df.withColumn("is_target", F.lit(None).cast("boolean")) if none else df
        background = plain_model(split, order, SIZE)
        targets = [plain_model([w for w, (_, t, f) in zip(split, rows_in, strict=True) if f and not none and fold[t] == k], order, SIZE) for k in (0, 1)]
        got = lm_score.cross_entropy_difference(used, PATH, order=order).collect()
        assert len(got) == len(rows_in)
        for r in got:
            t = SCORED[1 if r.doc_id is None else r.doc_id]
            w = ids(t)[:-1]
            assert r.n_tokens == len(w)
            if w:
                want = np.mean(targets[1 - fold[t]](w)), np.mean(background(w))  # never by the model that counted it
                assert (r.target_loss, r.background_loss, r.score) == (pytest.approx(want[0], rel=1e-9), pytest.approx(want[1], rel=1e-9), pytest.approx(want[0] - want[1], rel=1e-9, abs=1e-9))
            else:
                assert (r.target_loss, r.background_loss, r.score) == (None,) * 3
    assert lm_score.cross_entropy_difference(df.limit(0), PATH).count() == 0


def test_perplexities_against_a_plain_model(spark):
    df = docs(spark, SCORED)
    train = df.filter("doc_id < 12")
    for order in (1, 2, 3):
        model = plain_model([ids(t)[:-1] for t in SCORED[:12]], order, SIZE)
        for r in quality.perplexities(df, train, PATH, order, "doc_id").collect():
            w = ids(SCORED[r.doc_id])[:-1]
            assert r.n_tokens == len(w) and r.perplexity == (pytest.approx(np.exp(np.mean(model(w))), rel=1e-9) if w else None)
    assert all(r.perplexity is None or np.isclose(r.perplexity, SIZE) for r in quality.perplexities(df, train.limit(0), PATH, 2, "doc_id").collect())


def test_blocks_change_no_score(spark, monkeypatch):
    df = docs(spark, TEXTS * 5).withColumn("is_target", F.col("doc_id") % 2 == 0)
    score = lambda: {r.doc_id: (r.n_tokens, r.score and round(r.score, 9)) for r in lm_score.cross_entropy_difference(df, PATH).collect()}
    one = score()
    monkeypatch.setattr(ngrams.placed, "__kwdefaults__", {"block_bytes": 200})
    assert score() == one and len(one) == 5 * len(TEXTS)


def test_quality_and_scores(spark):
    good = [" ".join(W[i % 7 :] + W[: i % 5]) for i in range(60)]
    df = docs(spark, [*good, "%%% ### QXJ!! ZZ@@ 0xFF", None, ""])
    labels = spark.createDataFrame([(i, 1, None) for i in range(60)] + [(60, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.accepted for r in quality.score_documents(df, labels, PATH, quantile=1.0).collect()}
    assert sum(got[i] for i in range(60)) > 50 and not (got[60] or got[61] or got[62])  # the limit is of those that don't train
    none = quality.score_documents(df, labels.limit(0), PATH).collect()
    assert all(r.limit is None and r.accepted == (r.n_tokens > 0) for r in none) and len(none) == 63
    assert quality.score_documents(df.limit(0), labels, PATH).count() == 0
    scored = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(lm_score.with_target(df, labels), PATH).collect()}
    assert scored[60] > scored[0] and scored[61] is None


def test_limits_of_all_trusted_rows(spark):
    rng = np.random.default_rng(4)
    rare = ["".join(chr(int(c)) for c in rng.integers(0x4E00, 0x4F00, 60)) for _ in range(6)]
    texts = [(i, " ".join(W[i % 7 :] + W[: i % 5]), "en") for i in range(150)] + [(150 + i, t, "zh") for i, t in enumerate(rare)] + [(156, rare[0], "yy"), (157, W[0], None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(156)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    train = {r.doc_id for r in quality.trusted_ids(labels, 50).filter("train").collect()}
    assert 30 < len(train) <= 50
    got = {r.doc_id: r for r in quality.score_documents(df, labels, PATH, rows=50, quantile=0.9).collect()}
    for lang, own in (("en", range(150)), ("zh", range(150, 156))):  # a language of six rows has its own limit too
        limit = np.quantile([got[i].perplexity for i in own if i not in train], 0.9)
        assert all(np.isclose(got[i].limit, limit) for i in own), lang
    everything = np.quantile([got[i].perplexity for i in range(156) if i not in train], 0.9)
    assert np.isclose(got[156].limit, everything) and np.isclose(got[157].limit, everything)


def test_model_is_fitted_on_all_trusted_rows(spark):
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    train = quality.trusted_ids(labels).filter("train")
    assert 47_000 < train.count() < 49_000  # no cap
    near = spark.range(58_000, 90_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).union(spark.createDataFrame([(None, "x"), (58_000, "again")], "doc_id long, text string"))
    want = {r.doc_id for r in train.filter("doc_id >= 58000").collect()}
    got = quality.with_ids(near, train.select("doc_id"))
    assert got.columns == ["doc_id", "text"] and {r.doc_id for r in got.collect()} == want and got.count() == len(want) + (58_000 in want)
    assert quality.with_ids(near, train.select("doc_id").limit(0)).count() == 0


def test_counts_of_texts_are_added_up(spark, monkeypatch):
    from collections import Counter

    df, want = docs(spark, TEXTS * 3).repartition(3), Counter()
    for t in TEXTS * 3:
        own = ids(t)[:-1] if t else []
        want.update(zip([0, *(i + 1 for i in own)], [i + 1 for i in own], strict=False))
    for most in (1, 5, 1 << 20):
        monkeypatch.setattr(ngrams, "SUMMED", most)
        got = {(r.gram >> ngrams.BITS, r.gram & ((1 << ngrams.BITS) - 1)): r.n for r in ngrams.counts_of(df, PATH, 2, "n").collect()}
        assert got == dict(want)


def test_rotation(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, "system", "x"), (3, None, None, "q")], "conv_id long, turn long, role string, text string")
    got = chat.rotate(turns).collect()
    assert len(got) == 2 * 4 + 1
    for who in ("ann", "bob"):
        own = sorted((r for r in got if r.conv_id == 1 and r.perspective == who), key=lambda r: r.start)
        whole = "".join(r.rendered for r in own)
        assert [r.start for r in own] == list(np.cumsum([0, *(len(r.rendered) for r in own[:-1])]))
        assert [whole[r.mask_start : r.mask_end] for r in own if r.as_role == "assistant"] == (["hi<|im_end|>"] if who == "ann" else ["<|im_end|>"] * 2)


def test_url_rules(spark):
    urls = ["http://a.EXAMPLE.net/en/1?x", "http://example.net/fr/", "https://b.example.com/de/2", "http://x.org/fr/1#y", "http://spam.io/buy/1", "no url", None, "http://y.net"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labelled = spark.createDataFrame([("http://spam.io/buy/9", True)] * 5 + [("http://fine.io/read/9", False)] * 5 + [("http://z.io/", None)], "url string, bad boolean")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, labelled).collect()}
    assert got == {0: ("example.net/en/", "allow"), 1: ("net/", "block"), 2: ("example.com/de/", "block"), 3: ("org/fr/", "allow"), 4: (None, "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow")}


def test_url_rules_of_five_tokens_and_of_digits(spark):
    names = "abcde"
    five = [("http://q.io/?" + "&".join(names), True)] * 8 + [("http://q.io/?" + "&".join(names.replace(x, "")), False) for x in names] * 8
    digits = [("http://d.org/7/x", True)] * 20 + [("http://d.org/x", False)] * 40
    pages = spark.createDataFrame([(0, "http://q.io/?" + "&".join(names)), (1, "http://q.io/?a&b&c&d"), (2, "http://d.org/88/x"), (3, "http://d.org/x")], "page_id long, url string")
    labelled = spark.createDataFrame(five + digits, "url string, bad boolean")
    got = {r.page_id: (r.verdict, r.mined_rule) for r in url_rules.judge_urls(pages, labelled, rules=()).collect()}
    assert got[0] == ("block", " ".join(f"query:{x}" for x in names)) and got[2] == ("block", "path:#") and got[1][0] == got[3][0] == "allow"


def test_shingles_of_an_empty_batch():
    assert [len(x) for x in minhash.shingle_sets(pa.array(["", None, " \n"]))] == [0, 0, 0]


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    prose = [" ".join(rng.choice(W, int(rng.integers(30, 60)))) for _ in range(60)]
    texts = [*prose, prose[0], prose[1].replace(" ", "\n"), prose[2] + " more", f"{prose[3]} {' '.join(W)}", "%%% ### QXJ!! ZZ@@ 0xFF", None, ""]
    docs(spark, texts).withColumn("_hit", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(64, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(W))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    accepted = {r.doc_id for r in quality.score_documents(table("documents"), table("labels"), PATH).collect() if r.accepted}
    left = []  # exact copies, then components of near copies, then documents with a passage of the item
    split = {i: (texts[i] or "").lower().split() for i in sorted(accepted)}
    for i, w in split.items():
        if not any((texts[j] or "").split() == (texts[i] or "").split() for j in left):
            left.append(i)
    sets = {i: {tuple(split[i][k : k + 5]) for k in range(max(1, len(split[i]) - 4))} if split[i] else set() for i in left}
    part = {i: i for i in left}
    for i in left:
        for j in left:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((part[i], part[j]))
                part = {k: low if c == high else c for k, c in part.items()}
    passages = {tuple(W[k : k + 10]) for k in range(len(W) - 9)}
    left = [i for i in left if part[i] == i and not any(tuple(split[i][k : k + 10]) in passages for k in range(len(split[i]) - 9))]
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.start, list(r.ids)))
    assert sorted(got) == left and len(left) > 30 and not {60, 61, 62, 63, 64} & {*left}
    assert all([x for _, piece in sorted(got[i]) for x in piece] == ids(texts[i]) for i in left)
