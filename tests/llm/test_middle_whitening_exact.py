"""Fill-in-middle, whitening and exact duplicates against plain Python, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lagweave.llm import eigen, exact, fuse, middle, whitening
from lagweave.llm.common import new_path

NAMES = ["h1", "c", "form", "n", "output", "digest", "batch", "place", "home", "keep", "hits", "x", "whitened", "bucket"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, rows):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame([(k, t, *NAMES) for k, t in rows], schema).repartition(3)


def texts():
    rng = random.Random(2)
    some = ["".join(rng.choice(["ab", "é", "日本", " ", "\n", "\r\n", "x" * 50, " "]) for _ in range(rng.choice([1, 5, 200]))) for _ in range(80)]
    return [*some, None, "", "\n", "\n\n\n", "one", "with <P> in it\nand more", "a\n<M>", "<S", "<\nP>\n", "line\n" * 200_000, "y" * 300_000, "no end\n" * 3 + "z"]


def cut(doc, text, rate=100, spm=50):
    t = text or ""
    h = [int(sha(f"7:{'' if doc is None else doc}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rows = [*enumerate(texts()), (None, "no id\nhere\n"), (3, texts()[3])]
    for rate, spm in ((100, 50), (60, 0)):
        out = middle.fill_in_middle(documents(spark, rows), rate, spm).withColumn("back", middle.restored(F.col("output"), F.col("form")))
        got = sorted(map(tuple, out.collect()), key=repr)
        assert got == sorted([(k, *cut(k, t, rate, spm), t or "") for k, t in rows], key=repr)
    assert middle.fill_in_middle(documents(spark, rows[:0])).count() == 0


def test_fill_in_middle_stays_in_its_task(spark):
    plan = middle.fill_in_middle(documents(spark, [(1, "a\nb")]).coalesce(1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and "Aggregate" not in plan


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a\n\r é<", max_size=30), st.integers(0, 2**32), st.integers(0, 2**32))
def test_cuts(text, first, second):
    import regex

    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, a, b = middle.cuts(text, first, second, regex.compile(f"({middle.LINE})*+"))
    want = sorted(len("".join(units[: h % (len(units) + 1)])) for h in (first, second))
    assert (n, a, b) == (len(units), *want)


def matrices():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 40, 90):
        b, q = rng.normal(size=(n, n + 3)), np.linalg.qr(rng.normal(size=(n, n)))[0]
        yield b @ b.T
        yield np.eye(n)
        yield np.ones((n, n))
        yield (q * np.repeat([3.0, 1], n)[:: 2][:n]) @ q.T
        yield (q * np.geomspace(1, 1e-13, n)) @ q.T
        yield np.diag(rng.integers(0, 3, n).astype("f8")) * 1e-9
    w = np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield w
    yield np.kron(np.eye(2), w) * 1e12  # pairs of equal eigenvalues


def test_leading_eigenpairs():
    for a in matrices():
        values, vectors = eigen.leading(a, 16)
        want = np.linalg.eigvalsh(a)[::-1][:16]
        size = np.abs(a).max() * len(a)
        assert np.abs(values - want).max() <= 1e-14 * size and np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-14 * size
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13
    assert eigen.leading(np.zeros((3, 3)), 2)[0].tolist() == [0, 0] and len(eigen.leading(np.zeros((0, 0)), 2)[0]) == 0


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, label int, x string").repartition(3)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) / 9
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)]
    rows += [(400 + k, rows[7][1]) for k in range(50)] + [(None, rows[8][1]), (9, rows[9][1])]  # copies count once
    odd = [(900, None), (901, [1.0, None] + [0.0] * 18), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (904, []), (905, [1e30] * 20)]
    model = whitening.fit(vectors(spark, rows + odd))
    got = whitening.components(vectors(spark, rows + odd), model).collect()
    x = np.floor(64 * np.array([v for _, v in rows], "f4").astype("f8")).astype("i8") + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    v = (u - s / n).T @ (u - s / n) / n
    w, q = (a[..., ::-1] for a in np.linalg.eigh(v))
    white = (x - s / n) @ q[:, :16] / np.sqrt(w[:16])
    assert len(got) == 16 * len(rows) and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by_id = defaultdict(set)
    for k, (i, _) in enumerate(rows):
        by_id[i].add(k)
    signs = {c: np.sign(next(r["whitened"] for r in got if r["vec_id"] == 0 and r["component"] == c) * white[0, c - 1]) for c in range(1, 17)}
    for r in got:
        k = min(by_id[r["vec_id"]])
        assert r["deviation"] == ((n * x[k] - s) ** 2).sum() and abs(r["explained"] / (w[r["component"] - 1] / np.trace(v)) - 1) < 1e-9
        assert abs(r["whitened"] - white[k, r["component"] - 1] * signs[r["component"]]) < 1e-7


def test_whitening_of_little(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 2.0]), (2, [0.5, 2.0])]):
        df = vectors(spark, rows)
        assert whitening.components(df, whitening.fit(df)).count() == 0
    line = vectors(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)])  # one dimension of three varies
    got = whitening.components(line, whitening.fit(line)).collect()
    assert {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    with pytest.raises(ValueError, match="whitened together"):
        whitening.fit(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitening(3 * 10**9, np.array([0, 0]), np.ones(1), np.eye(2)[:1], 1.0)
    assert model.deviation(np.array([[1, 0], [2, 2], [1, 1]])) == [9 * 10**18, None, None]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_fuse_filter_denies_no_key(keys):
    f = fuse.build(np.array(sorted(keys), "i8"))
    assert f.may_hold(np.array(sorted(keys), "i8")).all() and all(k in f for k in list(keys)[:5])


def test_fuse_filter_affirms_few_others():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 40_000)
    f = fuse.build(np.concatenate([keys, keys[:100]]))
    assert f.may_hold(keys).all() and f.may_hold(keys + 1).mean() < 0.006 and len(f.cells) < 1.3 * len(keys)


def duplicates(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    out = []
    for t, ids in groups.items():
        known = [k for k in ids if k is not None]
        keep, left = max(known, default=None), 1
        for k in ids:
            out.append((k, keep, len(ids), k == keep and left == 1, sha(t)))
            left -= k == keep
    return sorted(out, key=repr)


def test_exact_duplicates(spark):
    rng = random.Random(4)
    pool = [f"text {k}" for k in range(60)] + ["long " * 30_000, "long " * 30_000 + "er", "é", "é", " a", "a "]
    rows = [(k, rng.choice(pool)) for k in range(400)] + [(k, "hot") for k in range(400, 600)] + [(700, None), (701, ""), (None, "text 1"), (None, "only null"), (None, "only null"), (5, "text 2"), (9, "twice"), (9, "twice")]
    docs = documents(spark, rows)
    weak = lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 1)  # noqa: E731 - one byte: most digests have several texts
    for options in ({}, {"batches": 1, "buckets": 3}, {"batches": 4, "buckets": 3}, {"digest": weak, "buckets": 4}):
        assert sorted(map(tuple, exact.exact_duplicates(docs, **options).collect()), key=repr) == duplicates(rows), options
    assert exact.exact_duplicates(documents(spark, [])).count() == 0
    folded = exact.exact_duplicates(documents(spark, [(1, "A b"), (2, "a B"), (3, None)]), normal=F.lower, batches=2, buckets=4).collect()
    assert sorted((r["doc_id"], r["keep_id"]) for r in folded) == [(1, 2), (2, 2), (3, 3)]


def test_store_keeps_its_snapshots(spark):
    store = exact.Store(spark, new_path(spark, "store"), 8)
    groups = lambda words: spark.createDataFrame([(w,) for w in words], "w string").select(F.pmod(F.xxhash64(exact.sha256(F.col("w"))), F.lit(8)).alias("bucket"), exact.sha256(F.col("w")).alias("digest"), "w")
    one = store.add(groups(f"w{k}" for k in range(100))).collect()
    two = store.add(groups(f"w{k}" for k in range(50, 150))).collect()
    three = store.add(groups(f"w{k}" for k in range(200))).collect()
    assert {r["home"] for r in one} == {0}
    assert {r["w"]: r["home"] for r in two} == {f"w{k}": int(k >= 100) for k in range(50, 150)}
    assert {r["w"]: r["home"] for r in three} == {f"w{k}": 0 if k < 100 else 1 if k < 150 else 2 for k in range(200)}
    assert [store.read("exact").where(F.col("snapshot") == k).count() for k in range(3)] == [100, 50, 50]
    asked = store.screened(groups(f"n{k}" for k in range(600)))
    assert asked.where(F.size("hits") > 0).count() < 40  # of 600 unknown ones, three filters each
