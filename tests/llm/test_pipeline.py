"""The pipeline's stages against the operators' own results."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lagweave.llm import pii


def write(spark, folder):
    rng = random.Random(1)
    line = lambda: " ".join(rng.choice(["the", "old", "house", "is", "quiet,", "and"]) + rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(90))
    good = [line() for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in line().split()) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(good + bad + good[:10])] + [(400, line() + " mail me at ab.c@mail.example now"), (401, None), (402, "")]
    docs = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < 120), 0) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict(rows)


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    texts = write(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        seen.append({r["doc_id"] for r in docs.collect()})
        if name == "pii":
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert "[EMAIL]" in kept[400] and all(kept[i] == texts[i] for i in kept if i != 400 and not pii.base_spans(texts[i] or ""))
    quality, dedup, personal, mixed, packed = seen
    assert set(range(120)) <= quality and not quality & set(range(120, 160))
    assert set(range(120)) <= dedup and not dedup & set(range(160, 170)) and personal == dedup
    assert mixed <= personal and len(mixed) > 20 and packed == mixed
    again = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in again.collect()} == packed


NAMES = ["probability", "place", "row", "fp", "n_tokens", "first", "ids", "_salt", "quality", "score", "start", "sequence_id", "topic"]


def odd(spark, folder, rows, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES)
    full = [(k, t, lang, source, len(t or ""), *NAMES) for k, t, lang, source in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return full


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated doc_ids, equal rows, null, empty and very long texts, null sources and extra columns with the operators' own names."""
    rng, sf = random.Random(2), str(tmp_path)
    line = lambda n=60: " ".join(rng.choice(["the", "old", "house", "is", "quiet"]) + rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n))
    good, long = [line() for _ in range(60)], line(60_000)
    rows = [(k, t, "en", f"s{k % 2}") for k, t in enumerate(good)] + [(100 + k, line().upper().replace(" ", "!! "), "de", "s0") for k in range(20)]
    rows += [(None, line(), None, None), (None, None, "en", None), (5, line(), "en", "s1"), rows[7], rows[7], (300, long, "en", "s0"), (301, long, "en", "s0"), (302, None, None, "s0"), (303, "", "en", "s1"), (304, " \n", "en", "s1")]
    given = odd(spark, sf, rows, [(k, int(k < 100), 0) for k in (*range(60), *range(100, 120))])
    before = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, before, sf)
        assert after.columns == before.columns, name
        after.write.parquet(f"{sf}/stage{k}")
        after = spark.read.parquet(f"{sf}/stage{k}")
        had, has = ([tuple(r) for r in x.collect()] for x in (before, after))
        if name == "pii":
            had = [r if r[1] is not None else r[:4] + (None,) + r[5:] for r in had]  # a null text has no length
            assert sorted(has, key=repr) == sorted(had, key=repr)  # there is no personal data here
        else:
            assert set(has) <= set(had) and all(has.count(r) <= had.count(r) for r in set(has)), name
        if name == "simhash near-dedup":
            assert sum(r[1] == long for r in has) == 1 and sum(r[0] == 7 for r in has) == 1 and sum(not (r[1] or "").split() for r in has) <= 1
        assert all(r[5:] == tuple(NAMES) for r in has), name
        before = after
    left = before.collect()
    assert set(given) >= {tuple(r) for r in left} and len(left) > 20 and all((r["text"] or "").split() for r in left)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(library.encode(r["text"], add_special_tokens=False).ids) + 1) for r in left)
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
    assert sum(p["length"] for p in pieces) == sum(n for *_, n in want)
    assert sorted((p["doc_id"] is None, p["doc_id"] or 0, p["doc_tokens"]) for p in pieces if p["start"] == 0) == want
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((p["doc_id"] is None, p["doc_id"] or 0, p["start"], p["ids_crc32"]) for p in whole) == sorted((p["doc_id"] is None, p["doc_id"] or 0, p["start"], p["ids_crc32"]) for p in pieces)


def test_empty_tables(spark, tmp_path):
    odd(spark, str(tmp_path), [], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
