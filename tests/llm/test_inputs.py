"""Odd inputs of all operators: shuffled, repeated, null, empty, clashing, tied and very long rows."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from faultline.llm import chat, decontaminate, exact_dedup, idfile, lm_score, minhash, packing, quality, shared, tokens, url_rules

PATH = public_tokenizers.path("byte_bpe_50k.json")
W = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, block int, row long, key string, _doc string, _kept int, n int, band long"
LONG = " ".join(W[i % 20] + str(i % 997) for i in range(60_000))
ROWS = [(i, t, lang, i, 7, "k", "d", 1, 2, 3) for i, t, lang in [(3, " ".join(W), "en"), (3, " ".join(W), "en"), (3, "other words here", None), (None, " ".join(W), "en"), (None, None, None), (5, "", "en"), (6, LONG, "en"), (7, LONG + " end", "en"), (8, "a\t b", "xx")]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def labels(spark, ids=(3, 5, 6)):
    return spark.createDataFrame([(i, 1, 0) for i in ids] + [(None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")


def operators(spark, df, tmp):
    """Each operator over ``df``; the number of rows it gives for each row of df."""
    idfile.write_ids(df, PATH, f"file://{tmp}/ids")
    return {
        "op1": quality.score_documents(df, labels(spark), PATH),
        "op2": idfile.read_ids(spark, f"file://{tmp}/ids"),
        "op4": lm_score.cross_entropy_difference(df.withColumn("is_target", F.col("lang") == "en"), PATH),
        "op7": minhash.near_duplicates(df),
        "op8": tokens.token_counts(df, PATH),
        "op10": exact_dedup.exact_groups(df),
    }


ITEMS = [(None, " ".join(W)), (1, " ".join(W[:10])), (1, " ".join(W[:10])), (2, None)]


@pytest.fixture(scope="module")
def usual(spark, odd, tmp_path_factory):
    """What the operators give for the odd rows, with broadcasts wherever sizes allow them."""
    found = {k: v.collect() for k, v in operators(spark, odd, tmp_path_factory.mktemp("usual")).items()}
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("h", F.lit(1)).withColumn("length", F.lit("x"))
    return found | {"op3": decontaminate.contaminated_spans(odd, items).collect()}


def test_a_row_for_each_row(usual):
    got = {k: v for k, v in usual.items() if k != "op3"}
    for name, rows in got.items():
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS), name
    assert {r.keep_id for r in got["op10"] if r.doc_id in (3, None)} == {3, 5}  # a null text is an empty one, and a null key stays only alone
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got["op7"] if r.n_shingles == 16) == [("3", 16, 3), ("3", 16, 3), ("None", 16, 3)]
    long = [r for r in got["op7"] if r.doc_id in (6, 7)]
    assert {r.component_id for r in long} == {6} and min(r.n_shingles for r in long) > 900
    assert sum(r.n_tokens for r in got["op2"]) == sum(r.n_tokens + 1 for r in got["op8"])
    assert [r.accepted for r in got["op1"] if r.doc_id == 5] == [False]


def test_packing_and_passages_of_odd_rows(odd, usual):
    pieces = packing.pack(odd, PATH).collect()
    whole = Counter()
    for r in pieces:
        whole[r.doc_id] += r.length
    count = Counter()
    for r in tokens.token_counts(odd, PATH).collect():
        count[r.doc_id] += r.n_tokens + 1
    assert whole == count
    got = usual["op3"]
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    assert sorted((r.n_hit, r["items"]) for r in got if r.n_hit) == [(20, ["1"])] * 3


def test_no_rows(spark, odd, tmp_path):
    none = odd.limit(0)
    for name, df in operators(spark, none, tmp_path).items():
        assert df.count() == 0, name
    assert packing.pack(none, PATH).count() == 0
    assert decontaminate.contaminated_spans(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    pages, labelled = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "url string, bad boolean")
    assert url_rules.judge_urls(pages, labelled).count() == 0


def test_kept_rows_have_all_their_columns(spark, odd):
    for kept in (quality.keep_accepted(odd, labels(spark), PATH), exact_dedup.drop_exact_copies(odd), minhash.drop_near_copies(odd)):
        assert kept.columns == odd.columns and kept.count() > 0


def scattered(df):
    """Rows in an order that no second evaluation needs to repeat."""
    return df.repartition(7, "x").drop("x")


def test_shuffled_input(spark):
    rng = np.random.default_rng(11)
    base = [" ".join(rng.choice(W, 30)) for _ in range(40)]
    texts = [base[int(rng.integers(40))] + (f" {W[int(rng.integers(20))]}" if i % 3 else "") for i in range(3000)]
    df = spark.createDataFrame([(f"{i:05d}" + "k" * 300, t, i % 11) for i, t in enumerate(texts)], "doc_id string, text string, x int")
    same = defaultdict(list)
    for i, t in enumerate(texts):
        same[t].append(f"{i:05d}" + "k" * 300)
    got = exact_dedup.exact_groups(scattered(df)).collect()
    assert len(got) == 3000 and all((r.keep_id, r.group_size) == (own[0], len(own)) for r in got for own in [same[texts[int(r.doc_id[:5])]]])
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in same)]
    part = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((part[i], part[j]))
                part = [low if c == high else c for c in part]
    want = {t: min(k for u, c in zip(same, part, strict=True) if c == p for k in same[u]) for t, p in zip(same, part, strict=True)}
    got = minhash.near_duplicates(scattered(df)).collect()
    assert len(got) == 3000 and all(r.component_id == want[texts[int(r.doc_id[:5])]] for r in got)
    pages = scattered(df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), F.col("x").cast("string"), F.lit(".io/"), F.substring("doc_id", 1, 5)).alias("url"), "x"))
    labelled = spark.createDataFrame([(f"http://h{i}.io/z", i % 2 == 0) for i in range(11)] * 3, "url string, bad boolean")
    for r in url_rules.judge_urls(pages, labelled).collect():
        h = re.match(r"h(\d+)\.io$", r.host)
        assert r.path == "/" + r.page_id[:5] and r.verdict == ("block" if int(h[1]) % 2 == 0 else "allow")


def test_without_broadcasts(spark, odd, usual, tmp_path, monkeypatch):
    """The way beyond the size that may be broadcast gives the same rows."""
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {k: v.collect() for k, v in operators(spark, odd, tmp_path).items()}
        got["op3"] = decontaminate.contaminated_spans(odd, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name, rows in usual.items():
        assert sorted(map(str, got[name])) == sorted(map(str, rows)), name


def plain_rules(baskets, support, confidence, least):
    """(tokens, verdict) of all rules that the limits and the pruning leave, by counting every combination."""
    seen = Counter(c for own, _ in baskets for k in range(1, len(own) + 1) for c in itertools.combinations(sorted(own), k))
    bad = Counter(c for own, is_bad in baskets if is_bad for k in range(1, len(own) + 1) for c in itertools.combinations(sorted(own), k))
    found = {}
    for c, n in seen.items():
        for verdict, hit in (("block", bad[c]), ("allow", n - bad[c])):
            base = sum(b == (verdict == "block") for _, b in baskets) / len(baskets)
            if hit >= max(least, np.ceil(support * len(baskets))) and hit / n >= confidence and hit / n > base:
                found[c, verdict] = (hit / n, hit / len(baskets))
    covered = {(c, v) for c, v in found if any(found.get((s, v), (0,))[0] >= found[c, v][0] for k in range(1, len(c)) for s in itertools.combinations(c, k))}
    return {k: x for k, x in found.items() if k not in covered}


def test_mined_rules_against_all_combinations(spark):
    rng = np.random.default_rng(5)
    names = [f"t{i}" for i in range(7)]
    baskets = []
    for _ in range(160):
        own = set(rng.choice(names, int(rng.integers(1, 6)), replace=False))
        baskets.append((own, bool(("t0" in own and "t1" in own) or rng.random() < 0.3)))
    df = spark.createDataFrame([(sorted(o), b) for o, b in baskets] + [(["t0"], None)], "tokens array<string>, bad boolean")
    sizes = []
    for support, confidence, least in ((0.05, 0.6, 1), (0.01, 0.5, 12), (0.01, 0.1, 3)):
        want = plain_rules(baskets, support, confidence, least)
        got = {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in url_rules.mine_rules(df, support, confidence, least).collect()}
        assert len(want) > 2 and got.keys() == want.keys()
        for k, x in want.items():
            assert got[k] == pytest.approx(x)
        sizes.append(len(want))
    assert len(set(sizes)) == 3


def test_rules_no_surer_than_the_base_rate_or_of_few_urls(spark):
    labelled = [("http://a.io/x", False)] * 6 + [("http://a.io/y", True)] * 3 + [("http://b.io/x", False)] * 14 + [("http://rare.io/q", True)] * 2
    df = spark.createDataFrame(labelled, "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://a.io/x"), (2, "http://rare.io/q"), (3, "http://a.io/y"), (4, "http://a.io/z")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined_rule) for r in url_rules.judge_urls(pages, df, rules=()).collect()}
    assert got[3] == ("block", "path:y") and got[2] == ("allow", None)  # two urls make no rule
    assert got[4] == ("allow", None)  # two thirds of a.io are good, fewer than of all
    assert got[1] == ("allow", "path:x")


def test_ties_of_mined_rules(spark):
    labelled = spark.createDataFrame([("http://a.io/x/y", True)] * 4 + [("http://b.io/z", False)] * 4, "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://c.io/x/y"), (1, "http://c.io/x/y"), (None, None)], "page_id long, url string")
    got = url_rules.judge_urls(pages, labelled, rules=())
    assert sorted((str(r.page_id), r.verdict, str(r.mined_rule)) for r in got.collect()) == [("1", "block", "path:x"), ("1", "block", "path:x"), ("None", "allow", "None")]  # equal rules: the least id


def test_links_near_the_threshold_are_found(spark):
    """Pairs of 75 to 80 percent: all are found (misses have a probability of some in a million)."""
    rng = np.random.default_rng(6)
    rows, n = [], 0
    while n < 400:
        size = int(rng.integers(30, 200))
        base = [f"d{n}w{i}" for i in range(size)]
        own = list(base)
        for k in rng.choice(size, max(1, size // 45), replace=False):
            own[k] = f"x{k}"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, own))
        if 75 <= 100 * len(a & b) / len(a | b) <= 80:
            rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(own))]
            n += 1
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(n)) == n


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([" ".join(W), "", None, "é 日本 <s>"])], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df, path).collect()} == {i: len(own.encode(t or "")) for i, t in enumerate([" ".join(W), "", None, "é 日本 <s>"])}


def test_rotation_of_odd_turns(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, 0, "ann", "x<|im_end|>\n<|im_start|>assistant\ny"), (1, 0, "bob", "q")]
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, perspective string, span int")
    got = chat.rotate(turns).collect()
    assert Counter((r.conv_id, r.perspective) for r in got) == {(None, "unknown"): 2, (1, "ann"): 2, (1, "bob"): 2}
    assert not [r for r in got if r.rendered.count("<|im_start|>") != 1 or r.rendered.count("<|im_end|>") != 1]
