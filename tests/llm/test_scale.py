"""Repeated rows, null ids, clashing columns and very long texts: what could gather in one task or fill its memory."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lagweave.llm import ann, bpe, classifier, mixing, packing, pii, rules, simhash, token_files, warc, wordpiece
from lagweave.llm.common import in_slices, lookup, new_path, one_task_each, written

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def documents(spark, rows):
    """With columns named as the operators' own."""
    names = ["probability", "place", "row", "fp", "n_tokens", "root", "n", "first", "tie", "ids", "_salt", "_salts", "_ratio", "quality", "_group", "topic"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    return spark.createDataFrame([(k, t, "en", "s", 1, *names) for k, t in rows], schema)


def test_clashing_columns(spark):
    rows = [(k, f"some words here {k % 5} x@y.zz") for k in range(40)] + [(None, None), (3, ""), (3, "")]
    docs = documents(spark, rows)
    model, field = classifier.Model(np.zeros(1 << classifier.BITS), 1.0), pii.fit(pii.augmented(pii.table_runs()))
    for out in (mixing.sampled_documents(docs), simhash.one_of_each(docs), pii.redact(docs, field), classifier.good_documents(docs, model)):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r["probability"] == "probability" and r["row"] == "row" and r["first"] == "first" for r in got)
    for out in (mixing.mix(docs), simhash.near_duplicates(docs), pii.find_personal_data(docs, field), classifier.score_quality(docs, model), rules.apply_rules(docs, None, 1.0), wordpiece.count_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))):
        assert out.count() == len(rows)
    assert packing.pack(docs, public_tokenizers.path(WORD)).count() == len(rows)


def test_clashing_columns_of_vectors_and_pages(spark):
    """Extra columns with the names that the searches and the archives use themselves change nothing."""
    rows = [(k, [float(k % 7), float(k % 5), float(k // 7 + 1)]) for k in range(60)]
    names = ["shard", "width", "block", "path", "query_id", "score", "rank", "e", "x"]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    with_more = vectors.select("*", *[F.lit(c).alias(c) for c in names])
    found = [sorted(map(tuple, ann.nearest(v, v.where("vec_id % 10 = 0"), 3, shard=20, block=4).collect())) for v in (vectors, with_more)]
    assert found[0] == found[1] and len(found[0]) == 18
    pages = spark.createDataFrame([(k, f"http://a/{k}", "z" * (900 + 100 * (k % 3))) for k in range(12)] + [(None, None, None)], "page_id long, url string, html string")
    more = pages.select("*", *[F.lit(c).alias(c) for c in ("digest", "bytes", "payload_digest", "refers_to", "record_type", "n", "last", "file", "offset", "length")])
    kept = [sorted(map(tuple, warc.archive(spark, p).collect()), key=repr) for p in (pages, more)]
    assert kept[0] == kept[1] and len(kept[0]) == 13


def test_keys_of_fingerprints_are_not_broadcast(spark):
    """26 keys a fingerprint are more than Spark takes them for, which is the fingerprints' own size."""
    rng = random.Random(5)
    groups = written(spark.createDataFrame([(rng.getrandbits(63),) for _ in range(3000)], "fp long"), "groups")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # above the fingerprints, below the counts of their cells
    try:
        found = simhash.links(groups)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.fixture
def small_parts(spark):
    """Spark would otherwise put the small parts of a test together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_are_dealt_out(spark, small_parts):
    docs = documents(spark, [(7, "the same text")] * 6000).repartition(3)
    packed = packing.pack(docs, public_tokenizers.path(WORD), group=500)
    sizes = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 24)).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 700
    for row in ((7, "the same text"), (None, "the same text")):
        docs = documents(spark, [row] * 6000).repartition(3)
        parts = token_files.write_token_files(docs, new_path(spark, "t"), public_tokenizers.path(BYTE))
        assert len(parts) > 1 and max(p["n_docs"] for p in parts) < 4000
        got = token_files.read_token_files(spark, parts).orderBy("start").collect()
        assert [r["start"] for r in got] == [k * got[0]["n_tokens"] for k in range(6000)] and {r["doc_id"] for r in got} == {row[0]}
    rows = spark.range(0, 5000, 1, 3).select(F.lit("hot").alias("k"), F.lit(1).alias("a"))
    found = lookup(rows, spark.createDataFrame([("hot", 5000, "v")], "k string, n long, v string"), "k", "n")
    salts = found._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" in salts and found.where("v = 'v'").count() == 5000


def test_one_row_of_each_component(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(5, long), (None, long), (None, "another text all by itself"), (7, "three equal rows"), (7, "three equal rows"), (7, "three equal rows"), (9, "three equal rows"), (None, "null id twice"), (None, "null id twice"), (4, None), (None, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(documents(spark, rows)).collect()), key=repr)
    assert got == sorted([(5, long), (None, "another text all by itself"), (7, "three equal rows"), (None, "null id twice"), (4, None)], key=repr)
    assert simhash.one_of_each(documents(spark, rows[:0])).count() == 0


def test_one_task_for_each_row(spark):
    df = one_task_each(spark, [(f"f{k}",) for k in range(23)], "file string")
    assert sorted((r["t"], r["file"]) for r in df.select(F.spark_partition_id().alias("t"), "file").collect()) == sorted((k, f"f{k}") for k in range(23))
    assert one_task_each(spark, [], "file string").count() == 0


def test_slices_have_few_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (10, 5000, 20000, 3, 3, 3)]})
    parts = list(in_slices([batch], 4, 6000))
    assert [t for p in parts for t in p["text"].to_pylist()] == batch["text"].to_pylist()
    assert all(p.num_rows <= 4 and (p.num_rows == 1 or p.nbytes <= 6000) for p in parts)


def test_long_texts(spark):
    """4 MB of words, and 20 MB without a blank, each in one text, through every operator of texts."""
    n = 120_000
    words, solid = "some words, 12 of them@a.bc 1.2.3.4 " * n, "abcdefgh" * 2_500_000
    docs = documents(spark, [(1, words), (2, solid), (3, "short")])
    began = time.time()
    model, field = classifier.fit(["good words here", "bad ones there"], [1, 0]), pii.fit(pii.augmented(pii.table_runs()))
    score = {r["doc_id"]: r["score"] for r in classifier.score_quality(docs, model).collect()}
    once = model.score([words[:36_000]])[0]
    assert abs(score[1] - once) < 1e-3 and 0 < score[2] < 1
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs, field).collect()}
    assert found[1]["n_email"] == found[1]["n_ip"] == n and found[2]["n_spans"] == 0
    counts = {r["doc_id"]: r for r in rules.apply_rules(docs, None, 1.0).collect()}
    assert counts[1]["n_words"] == n * 6 and counts[2]["word_chars"] == len(solid)
    pieces = {r["doc_id"]: r for r in wordpiece.count_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert pieces[1]["n_words"] == n * 6 and pieces[2]["n_tokens"] > 1_000_000
    assert simhash.near_duplicates(docs).count() == 3
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.mix(docs).collect()} == {1: n * 6, 2: 1, 3: 1}
    packed = packing.pack(docs, public_tokenizers.path(WORD)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert all(r["n"] == r["d"] for r in packed) and len(packed) == 3
    parts = token_files.write_token_files(docs, new_path(spark, "t"), public_tokenizers.path(BYTE))
    assert token_files.read_token_files(spark, parts).agg(F.sum("n_tokens")).first()[0] == sum(p["n_tokens"] for p in parts)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {r["page_id"]: r["payload_bytes"] for r in warc.archive(spark, pages).collect()} == {1: len(words), 2: len(solid), 3: 5}
    assert time.time() - began < 400


@pytest.mark.parametrize("name, lower", [(BYTE, False), (WORD, True)])
def test_ids_are_the_library_s(name, lower):
    """Texts of all characters below U+0100, of special tokens, and of other scripts cut at blanks."""
    rng, library, mine = random.Random(1), Tokenizer.from_file(public_tokenizers.path(name)), bpe.Encoder(public_tokenizers.path(name), lower)
    kinds = [
        [chr(c) for c in range(256)],
        ["a", "the", " ", "  ", "\n", "'s", "'S", "é", "12", "!", "\xa0", "\x85", "\x1c", "ß", "´", "º", "²"],
        ["a", "the", " ", "  ", "\n", "'s", "日", "本", "\u0301", "Σ", "İ", "ς", "\u3000", "ﬁ", "\u200d", "x "],
        ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "a", " b", "日"],
    ]
    for k in range(4000):
        text = "".join(rng.choice(kinds[k % 4]) for _ in range(rng.randint(0, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == want, text
        if k % 4 == 2:
            assert np.frombuffer(mine.by_library(bpe.chunks(text, 20)), "<u4").tolist() == want, text


def plain_features(text):
    """Words, pairs of neighbours and runs of 3 and 4 characters, one by one."""
    mask, mix = (1 << 64) - 1, int(classifier.MIX)
    bucket = lambda h: (((h ^ (h >> 29)) * mix) & mask) >> (64 - classifier.BITS)
    line = " " + re.sub("[\t-\r]", " ", text) + " "
    words = [sum((ord(c) + 1) * (((k + 1) * mix & mask) | 1) for k, c in enumerate(w)) & mask for w in line.split(" ") if w]
    found = [bucket(w) for w in words] + [bucket(((a ^ b) + 7) & mask) for a, b in zip(words, words[1:], strict=False)]
    for n in (3, 4):
        for k in range(len(line) - n + 1):
            part = line[k : k + n]
            if " " not in part[1:-1]:
                h = ord(part[0]) ^ (mix >> n)
                for c in part[1:]:
                    h = (h * int(classifier.STEP) + ord(c)) & mask
                found.append(bucket(h))
    return sorted(found)


def test_classifier_features_one_by_one():
    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choice(["a", "bb", " ", "  ", "\n", "é", "日", "xyz", "\t"]) for _ in range(rng.randint(0, 40)))
        assert sorted(classifier.features([text])[0].tolist()) == plain_features(text)
        parts = np.concatenate(list(classifier.long_features(text, rng.randint(1, 12))))
        assert sorted(parts.tolist()) == plain_features(text)


def test_classifier_training_is_the_plain_one(monkeypatch):
    """Gradient descent with one number at a time, and the score as a softmax of the averaged vectors."""
    for name, value in (("BITS", 7), ("SIZE", 3), ("EPOCHS", 2)):
        monkeypatch.setattr(classifier, name, value)
    texts, y = ["old house by the sea", "BUY NOW!!! NOW", "", "the sea is old", "now now BUY"], [1, 0, 1, 1, 0]
    rng = np.random.default_rng(classifier.SEED)
    v = rng.uniform(-1 / 3, 1 / 3, (1 << 7, 3))
    out, bias, done = np.zeros((3, 2)), np.zeros(2), 0
    for _ in range(2):
        for k in rng.permutation(5):
            rate = classifier.RATE * (1 - done / 10)
            done += 1
            f = plain_features(texts[k])
            share = {b: f.count(b) / len(f) for b in sorted(set(f))}
            hidden = [sum(s * v[b][d] for b, s in share.items()) for d in range(3)]
            z = [sum(hidden[d] * out[d][c] for d in range(3)) + bias[c] for c in range(2)]
            e = np.exp(np.array(z) - max(z))
            p = e / e.sum()
            p[y[k]] -= 1
            back = [sum(out[d][c] * p[c] for c in range(2)) for d in range(3)]
            for d in range(3):
                for c in range(2):
                    out[d][c] -= rate * hidden[d] * p[c]
            bias -= rate * 0.1 * p
            for b, s in share.items():
                for d in range(3):
                    v[b][d] -= rate * 50 * s * back[d]
    model = classifier.fit(texts, y)
    for text, score in zip(texts, model.score(texts), strict=True):
        f = plain_features(text)
        hidden = np.mean([v[b] for b in f], 0) if f else np.zeros(3)
        z = hidden @ out + bias
        assert abs(score - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-4


def test_labelled_rows_are_bounded(spark):
    """A doc_id that occurs often is learned from once."""
    docs = documents(spark, [(1, f"text {k}") for k in range(500)] + [(2, "other"), (3, "x" * (classifier.LONGEST + 1))])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in classifier.labelled(docs, labels).orderBy("doc_id").collect()]
    assert got == [(k, t, q) for k, t, q in ((1, "text 99", 1), (2, "other", 0)) if k in {r[0] for r in got}] and got


def test_forest_path_lengths_one_by_one():
    rng = np.random.default_rng(2)
    points = rng.uniform(size=(300, 4))
    forest = rules.Forest(points, trees=7, sample=64)

    def path(tree, row):
        feature, split, child, length = tree
        node = 0
        while split[node] != np.inf:
            node = child[node] + (row[feature[node]] >= split[node])
        return length[node]

    for row, score in zip(points[:50], forest.score(points[:50]), strict=True):
        mean = sum(path(t, row) for t in forest.trees) / 7
        assert abs(score - 2 ** (-mean / rules.usual_depth(64))) < 1e-12


def test_quality_rules_keep_a_score_on_the_threshold(spark):
    docs = documents(spark, [(k, " ".join(f"w{k}x{j}" for j in range(60))) for k in range(6)])
    forest = rules.Forest(np.random.default_rng(1).uniform(size=(50, 6)))
    scores = sorted(r["anomaly"] for r in rules.apply_rules(docs, forest, 1.0).collect())
    assert rules.apply_rules(docs, forest, scores[2]).where("kept").count() == sum(s <= scores[2] for s in scores)


def test_neighbours_with_ties(spark):
    """Equal vectors in many shards: ties go to the smaller vec_id."""
    df = spark.createDataFrame([(k, [1.0, float(k % 2)]) for k in range(300)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id in (0, 7, 299)"), shard=20, block=2).orderBy("query_id", "rank").collect()
    for q in (0, 7, 299):
        assert [r["vec_id"] for r in got if r["query_id"] == q] == [k for k in range(300) if k % 2 == q % 2 and k != q][:10]
