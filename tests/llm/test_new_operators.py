"""Operators 11 to 13 against SQL, plain Python and numpy, with odd rows."""

import re
import zlib
from collections import defaultdict
from functools import lru_cache
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import queries, quality_rules, repair, whitening

D = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


# --- operator 11 ------------------------------------------------------------------------------------------------------


def plain_counts(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if x.strip(WHITE)]
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    again = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


WORDS = "the quick brown animal jumps over a lazy sleeping person and then runs to some distant river of that it is was for with on by as at from".split()
TEXTS = [
    " ".join(WORDS) + ".", None, "", " \n\t ", "one two", "a " * 8, "a " * 9, "a " * 30, " ".join(WORDS * 2), " ".join(WORDS[:12] + ["x"] + WORDS[3:11] + ["y"] + WORDS),
    "é日本 😀 # * $ | < > % &", "line\nline\n\n \nline \nother\nline", "- a\n* b\n1. c\n" + " ".join(WORDS), " ".join(WORDS) + "\n" + "more of the same...\n" * 3,
    " ".join(f"w{i % 701}" for i in range(40_000)), " ".join(f"v{i}" for i in range(5000)) + " " + " ".join(f"v{i}" for i in range(100, 108)), " nbsp isn't white neither", "\r\nx\x0b\x0cy\x1fz",
]


def test_counts_against_plain_python(spark):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[0]), (None, TEXTS[0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, of string, n_words int, kept int")
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judged(df).collect()), key=str)
    want = sorted(((k, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]) for k, t in rows for c in [plain_counts(t)]), key=str)
    assert got == want
    assert quality_rules.judged(df.limit(0)).count() == 0
    kept = {r.doc_id for r in quality_rules.judged(df).filter("kept").collect()}
    good = quality_rules.keep_good(df)
    assert good.columns == df.columns and {r.doc_id for r in good.collect()} == kept and {0, None} <= kept


def test_each_rule_of_the_table(spark):
    good = " ".join(WORDS)
    broken = {
        "word_length": " ".join(["incomprehensibilities", "the", "of"] * 3 + [f"extraordinarilylong{i}" for i in range(20)]), "symbols": good + " # | $ & *", "lettered_words": good + " 1 2 3 4 5 6 7 8 9", "stop_words": " ".join(f"word{i}" for i in range(30)),
        "repeated_lines": good + "\nyes.\nyes.\nyes.\nyes.\nyes.", "listed_lines": "\n".join(f"- {w} together with another" for w in WORDS), "cut_lines": good + "...\nand so on...",
    }
    df = spark.createDataFrame([*broken.items(), ("none", good)], "doc_id string, text string")
    got = {r.doc_id: (r.base_failed, r.kept, r.broken_rules) for r in quality_rules.judged(df).collect()}
    assert got == {k: (False, False, [k]) for k in broken} | {"none": (False, True, [])}
    free = quality_rules.judged(df, rules=())
    assert all(r.kept for r in free.collect())


def test_rules_equal_sql_and_leave_good_documents(spark):
    c = duckdb.connect()
    c.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept broken_rules".split()
    want = c.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op11_quality_rules']}) ORDER BY doc_id").fetchall()
    made = queries.op11_quality_rules(spark, "/root/testdata/sf0.01")
    assert made.columns == names and [tuple(r) for r in made.orderBy("doc_id").collect()] == want
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = made.join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in judged}
    assert share[1] == 1.0 and share[0] < 0.1
    nodes = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in nodes and "Python" not in nodes


# --- operator 12 ------------------------------------------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(turns):
    """(cost, audit, turns) of the ASCII-least cheapest edits, by trying every edit at every place."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    @lru_cache(None)
    def go(i, state, inserted):
        found = [(0, "", ())] if i == len(turns) and state in (0, 3) else []
        due = "assistant" if state == 2 else "user"
        if inserted < 3:
            cost, audit, rest = go(i, after[state], inserted + 1)
            found.append((cost + 5, "I" + audit, ((due, ""), *rest)))
        if i < len(turns):
            role, text, fault = turns[i]
            cost, audit, rest = go(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, rest))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], state))
                if to is not None:
                    cost, audit, rest = go(i + 1, to, 0)
                    found.append((cost + more, "K" + audit, ((role, text), *rest)))
                cost, audit, rest = go(i + 1, after[state], 0)
                found.append((cost + more + 1, "R" + audit, ((due, text), *rest)))
        return min(found, key=lambda x: x[:2], default=(10**9, "", ()))

    for i in range(len(turns), 0, -1):  # from the end, so that no call is deep
        for state in range(4):
            go(i, state, 0)
    return go(0, 0, 0)


def plain_repair(rows):
    by = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        by[r[0]].append(r)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, turns = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(WHITE)
            turns.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        at = [t for _, t, _, _ in own if t is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, kept = cheapest(tuple(turns))
        faults = [sum(f == k for _, _, f in turns) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (max(at) - min(at) + 1 - len(set(at)) if at else 0, *faults, illegal, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def some_dialogues(seed):
    rng = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", None, ""], ["Hi.", "ok", "Yes!", "", None, " \t", "é? ", "x y z.", "a", "b?\r\n"]
    pick = lambda x: x[int(rng.integers(len(x)))]
    rows = [(c if c else None, t if rng.random() > 0.03 else None, pick(roles), pick(texts)) for c in range(150) for t in range(int(rng.integers(0, 14))) if rng.random() > 0.1]
    long = [(9999, t, pick(roles[:5]), f"t{t}{pick(['.', '!', '', '. '])}") for t in range(300)]
    return [*rows, *rows[5:9], *long, (77777, 1, "user", "x" * 200_000 + "."), (77777, 2, "assistant", "y" * 200_000)]


@pytest.mark.parametrize(("seed", "bits", "step"), [(1, 12, 64), (2, 3, 2)])
def test_repair_against_every_edit(spark, monkeypatch, seed, bits, step):
    """With segments of 8 turns a dialogue of 300 has many, so vectors and states pass from one to the next."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    monkeypatch.setattr(repair, "STEP", step)
    rows = some_dialogues(seed)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, at int").repartition(3)
    got = repair.damaged_and_repaired(df).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == plain_repair(rows)
    assert repair.damaged_and_repaired(df.limit(0)).count() == 0


def test_walks_equal_without_checkpoints():
    rng = np.random.default_rng(4)
    for n in (1, 63, 64, 65, 500):
        codes = "".join(rng.choice(list("sua-SUA_x"), n))
        state, audit, roles = repair.walk(codes, repair.AT_END, 0, True)
        left = re.sub("[- ]", "", roles)
        assert state in repair.ENDS and re.fullmatch("(s?(ua)+)?", left) and len(audit.split()) == n
        turns = [("x" if c in "x-_" else c.lower(), "", "blank" if c == "x" else "truncated" if c.isupper() or c == "_" else "") for c in codes]
        if n <= 65:
            cost, want, _ = cheapest(tuple(turns))
            assert audit.replace(" ", "") == want and repair.costs_from(codes, repair.AT_END)[0] == cost


def test_a_dialogue_of_all_dropped_turns(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.damaged_and_repaired(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]


# --- operator 13 ------------------------------------------------------------------------------------------------------


def plain_whitening(vectors):
    """(n, S, eigenvalues, directions, trace) of the distinct vectors, in numpy."""
    x = np.floor(np.array([v for v in vectors], float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    values, directions = np.linalg.eigh(c.T @ c / n)
    return x, n, s, values[::-1], directions[:, ::-1], values.sum()


def same_whitening(got, keys, vectors, components):
    x, n, s, values, directions, trace = plain_whitening(vectors)
    assert len(got) == len(keys) * components
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
        assert r.n == n and r.identity_error <= 1e-9
    deviation = {k: sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for k, row in zip(keys, x, strict=True)}
    for k, rows in by.items():
        e, v = values[k - 1], directions[:, k - 1]
        want = {key: (row - s / n) @ v / np.sqrt(e) for key, row in zip(keys, x, strict=True)}
        sign = np.sign(sum(want[r.vec_id] * r.whitened for r in rows))
        for r in rows:
            assert r.deviation == deviation[r.vec_id] and r.explained == pytest.approx(e / trace, rel=1e-9) and r.whitened == pytest.approx(sign * want[r.vec_id], abs=1e-7)


def test_whitening_against_numpy(spark):
    df = queries.op13_embedding_whitening(spark, D)
    assert df.columns == "vec_id component n deviation whitened explained identity_error".split()
    rows = spark.read.parquet(f"{D}/embeddings.parquet").collect()
    same_whitening(df.collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 4)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(7)
    good = rng.normal(size=(300, 6)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(good)] + [(1000 + i, [float(c) for c in good[5]]) for i in range(50)]  # many copies of one
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, [1.0, 2.0]), (2006, [-float("inf")] * 6)]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows + odd], "vec_id long, embedding array<float>, x string, component int").repartition(5)
    same_whitening(whitening.whiten(df).collect(), [k for k, _ in rows], [v for _, v in rows], 4)
    alike = spark.createDataFrame([(i, [1.5, -0.0, 0.0]) for i in range(9)] + [(None, [1.5, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(alike).count() == 0 and whitening.whiten(df.limit(0)).count() == 0
    two = spark.createDataFrame([(None, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (1, [0.0, 1.0, 0.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(two).collect()
    assert len(got) == 3 and all(r.component == 1 and r.explained == pytest.approx(1) and abs(r.whitened) == pytest.approx(1) and r.n == 2 for r in got)
    far = spark.createDataFrame([(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [5e12, 1.0])], "vec_id long, embedding array<double>")
    assert all(r.deviation is None for r in whitening.whiten(far).collect() if r.vec_id < 2)


def test_triangles_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(500, 5)) * [9, 5, 3, 2, 1]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    same_whitening(whitening.whiten(df.repartition(23), components=5).collect(), list(range(500)), v, 5)


def shapes():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    close = np.linalg.qr(rng.normal(size=(100, 30)))[0] * ([5, 5 * (1 + 1e-12), 5 * (1 - 1e-13), 4] + [1] * 26) @ q
    holes = rng.normal(size=(50, 20))
    holes[:, [0, 7, 19]] = 0
    yield from (rng.normal(size=(300, 64)), rng.normal(size=(3, 40)), rng.normal(size=(400, 90)) * np.logspace(0, -9, 90), np.ones((9, 5)), 3 * np.eye(8), close, holes, rng.normal(size=(40, 1)), np.diag(np.ones(30)) + np.diag(np.ones(29), 1))


def test_solver_against_lapack():
    for a in shapes():
        d = a.shape[1]
        r = np.linalg.qr(a, mode="r")
        values, vectors = whitening.principal(np.vstack([r, np.zeros((d - len(r), d))]), 6)
        want = np.linalg.svd(a, compute_uv=False) ** 2
        k = len(values)
        assert k == min(6, int((want > want[0] * (d * whitening.EPS) ** 2).sum()))
        assert values == pytest.approx(want[:k], rel=1e-11)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(a.T @ (a @ vectors) - vectors * values).max() < 1e-11 * want[0]
    assert len(whitening.principal(np.zeros((4, 4)), 4)[0]) == 0
    # Small values of a graded matrix to full relative accuracy, which squaring would lose.
    a, b = np.logspace(0, -12, 20), 0.3 * np.logspace(0, -12, 20)[:-1]
    exact = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2
    assert whitening.squared_singular_values(a, b)[:12] == pytest.approx(exact[:12], rel=1e-9)
