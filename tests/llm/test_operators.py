"""Operators against plain Python on small fixtures with nulls, empty and long texts, ties, repeats and extra columns."""

import functools
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lagweave.llm import ann, classifier, mixing, packing, pii, rules, simhash, token_files, warc, wordpiece
from lagweave.llm.common import lookup, new_path

WORDS = "the of tion ing and with Straße été ça here anon; x1 don't 12,5 ###".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, sequence_id string, start string, fp string, h string, score string"


def texts():
    rng = random.Random(4)
    some = [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "\n", "  "]) for _ in range(rng.choice([1, 3, 40, 300]))) for _ in range(60)]
    odd = [None, "", " ", "\n\n", "a", "a b", "İstanbul ΣΑΣ", "\x1c\x85\xa0x", "don't 'S I'LL", "<|endoftext|> <|startoftext|>", "word " * 9000, "x" * 30000, "日本語 のテキスト　です"]
    return some + odd + some[:5] + [some[0]] * 3


def table(spark, rows=None):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "no id here"), (3, texts()[3])] if rows is None else rows
    return spark.createDataFrame([(k, t, None if k and k % 5 == 0 else "en", f"s{(k or 0) % 3}", 1, 7, "x", "y", "z", "q", "w") for k, t in rows], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library_ids(name, text):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark)
    got = packing.pack(docs, path, with_ids=True, group=16).collect()
    found, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"]))
        found[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in enumerate(texts()):
        if k != 3:
            pieces = sorted(found[k], key=lambda r: r["start"])
            assert [i for r in pieces for i in r["ids"]] == [*library_ids("word_bpe_49k.json", t), 1]
            assert all(r["doc_tokens"] == sum(x["length"] for x in pieces) for r in pieces)
    for parts in seqs.values():
        ends = 0
        for at, n in sorted(parts):
            assert at == ends
            ends += n
        assert ends <= 2048
    assert len(found[3]) == 2 * len({r["start"] for r in found[3]}) and len(found[None]) == 1
    assert packing.pack(empty(spark), path).count() == 0


def test_first_fit_decreasing_is_the_plain_one():
    rng = random.Random(1)
    for n in (0, 1, 2, 50):
        sizes = [rng.randint(1, 100) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room = []
        for k in sorted(range(n), key=lambda k: -sizes[k]):
            at = next((b for b, r in enumerate(room) if r >= sizes[k]), len(room))
            room += [100] * (at == len(room))
            assert (bins[k], offsets[k]) == (at, 100 - room[at])
            room[at] -= sizes[k]


def brute_spans(text):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    return [(k, *m.span()) for k, p in kinds.items() for m in re.finditer(p, text) if k == "email" or pii.is_kind(k, m[0])]


def test_personal_data(spark):
    rng = random.Random(2)
    parts = ["a.b@c.de", "x@y", "@", "p@q.r@s.t", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111111111111111", "4111111111111112", "+1 (722) 555-8977", "+12", "7", ".", " ", "\n", "é", "a_b@c.d_e@f.g", "+49 30 1234567 12", "-", "00000000000000"]
    rows = ["".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    for t in rows:
        assert pii.base_spans(t) == brute_spans(t)
    docs = table(spark, [*enumerate(rows), (None, None), (9000, ""), (9001, "mail x@y.zz " * 3000)])
    field = pii.train(docs, 300)
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs, field).collect()}
    assert len(got) == len(rows) + 3
    for k, t in [*enumerate(rows), (None, ""), (9001, "mail x@y.zz " * 3000)]:
        base = ",".join(f"{a}:{b}:{c}" for a, b, c in brute_spans(t))
        assert got[k]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(s[0] == x for s in brute_spans(t)) for x in pii.KINDS]
        assert set(filter(None, base.split(","))) <= set(got[k]["spans"].split(","))
    assert pii.find_personal_data(empty(spark), field).count() == 0
    assert pii.train(empty(spark)).cues
    clean = {r["doc_id"]: r for r in pii.redact(docs, field).collect()}
    assert "@y.zz" not in clean[9001]["text"] and clean[9001]["n_chars"] == len(clean[9001]["text"]) and clean[None]["text"] is None


def test_field_finds_what_patterns_drop():
    field = pii.fit(pii.augmented(pii.table_runs()), {"call", "phone"})
    card, ip = "4929000000006", "71.129.171.132"
    text = f"see {ip} {card} there"
    assert pii.base_spans(text) == [("ip", 4, 4 + len(ip))]
    assert ("card", 5 + len(ip), 5 + len(ip) + len(card)) in pii.find_spans([text], field)[0][1]
    assert pii.find_spans(["plain words 12 and 2020 only", "call 2020"], field) == [([], []), ([], [])]


def test_field_uses_the_words_around():
    """One shape of number is a phone number after a cue and none after another."""
    rows = [(pii.runs(f"{w} {100000000 + 7919 * k} x")[0], [pii.TAGS.index("B-phone") if w == "call" else 0]) for k in range(40) for w in ("call", "order")]
    found = [s for _, s in pii.find_spans(["call 123450009 now", "order 123450009 now"], pii.fit(rows, {"call", "order"}))]
    assert found == [[("phone", 5, 14)], []]
    assert pii.fit([]) is None


def test_labelled_table():
    rows = pii.pii_table.rows()
    assert len(rows) > 50 and not any("[[" in t for t, _ in rows)
    for text, spans in rows:
        assert all((pii.is_phone(text[a:b], True) or (k, a, b) in pii.base_spans(text) if k == "phone" else pii.is_kind(k, text[a:b])) and pii.trim(text, a, b) == (a, b) for k, a, b in spans), text


def test_field_on_rows_it_has_not_seen():
    """Each fourth of the table is held out once: precision and recall of all spans and of phone numbers."""
    rows, held, found = pii.pii_table.rows(), [], []
    for fold in range(4):
        learnt = [(run, pii.tagged(run, pii.Overlaps(spans))) for k, (text, spans) in enumerate(rows) if k % 4 != fold for run in pii.runs(text)]
        field = pii.fit(pii.augmented(learnt), {w for run, _ in learnt for w in (run.before, run.after) if w})
        held += [set(s) for _, s in rows[fold::4]]
        found += [set(every) for _, every in pii.find_spans([t for t, _ in rows[fold::4]], field)]
    for kind, precision, recall in ((None, 0.95, 0.8), ("phone", 0.95, 0.65)):
        want, got = ([{x for x in s if kind in (None, x[0])} for s in sets] for sets in (held, found))
        true = sum(len(a & b) for a, b in zip(want, got, strict=True))
        assert true >= recall * sum(map(len, want)) and true >= precision * sum(map(len, got)), kind


def test_amounts_and_years_are_no_phone_numbers():
    table = pii.table_runs()
    field = pii.fit(pii.augmented(table), {w for run, _ in table for w in (run.before, run.after) if w})
    plain = ["Total 1 234 567 890 euros", "Population 83200000 (2021)", "sum of 12 345 678 901 yen", "Umsatz 987.654.321 Euro", "call 2020", "years 2019 2020 2021", "parcel 00340434161094042557", "order 123450009 now"]
    assert all(not every for _, every in pii.find_spans(plain, field))
    for text, number in (("0049 30 1234567 rufen", "0049 30 1234567"), ("Tel 030/123456789", "030/123456789"), ("call 555 0147 now", "555 0147")):
        assert [text[a:b] for _, a, b in pii.find_spans([text], field)[0][1]] == [number]


def test_vocabulary_without_a_byte_is_an_error():
    with pytest.raises(ValueError, match="single bytes"):
        wordpiece.Automaton([bytes([k]) for k in range(255)] + [b"ab"])


def all_paths(scores, move):
    """Value of each tag path of a run, by enumeration."""
    from itertools import product

    n = len(scores)
    return {p: move[-1, p[0]] + sum(scores[t][p[t]] for t in range(n)) + sum(move[a, b] for a, b in zip(p, p[1:])) + move[p[-1], -1] for p in product(range(len(pii.TAGS)), repeat=n)}  # noqa: B905


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    field = pii.Field({}, np.zeros((0, len(pii.TAGS))), rng.normal(size=(len(pii.TAGS) + 1,) * 2))
    field.scores = lambda run: np.array([[float(w) * ((k * 7 + len(w)) % 5) for k in range(len(pii.TAGS))] for w in run.words])
    for words in (["0.3"], ["0.5", "-1.25"], ["1", "-0.5", "0.25"]):
        run = pii.Run(words, [])
        paths = all_paths(field.scores(run), field.move)
        assert tuple(field.decode([run])[0]) == max(paths, key=paths.get)


def test_gradient_is_the_plain_one():
    """What is there less what is expected, over all tag paths of a run of three."""
    rng, n = np.random.default_rng(6), len(pii.TAGS)
    scores, move, tags = rng.normal(size=(3, n)), rng.normal(size=(n + 1, n + 1)), [2, 0, 5]
    paths = all_paths(scores, move)
    z = sum(np.exp(v) for v in paths.values())
    g, pair = np.zeros((3, n)), np.zeros((n + 1, n + 1))
    for path, share in [(tuple(tags), 1.0), *((p, -np.exp(v) / z) for p, v in paths.items())]:
        for t, k in enumerate(path):
            g[t, k] += share
        for a, b in zip([n, *path], [*path, n], strict=True):
            pair[a, b] += share
    mine = pii.gradient(scores, move, tags)
    assert np.allclose(mine[0], g) and np.allclose(mine[1], pair)


@pytest.mark.parametrize("factor", [1.0, 1.4])
def test_neighbours(spark, factor):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8)).round(1)
    rows = [(k, [float(x) for x in (base[k % 30] + (k % 4) * 0.1)]) for k in range(400)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] + [1.0] * 7), (1004, [float("inf")] * 8), (None, [1.0] * 8), (5, rows[5][1])]
    df = spark.createDataFrame([(k, v, 1, 2.0) for k, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 10, factor, shard=100, block=7).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {k: np.array(v, "f4").astype("f8") for k, v in rows[:400]}
    hits = 0
    for q in range(0, 400, 20):
        want = sorted((float(np.sqrt(((good[k] - good[q]) ** 2).sum())), k) for k in good if k != q)[:10]
        mine = sorted(got[q])
        hits += len({k for _, k, _ in mine} & {k for _, k in want})
        if factor == 1.0:
            assert [k for _, k, _ in mine] == [k for _, k in want] and np.allclose([s for *_, s in mine], [s for s, _ in want])
    assert set(got) == set(range(0, 400, 20)) and hits >= 180
    assert ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_rule_counts():
    for t in texts():
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        got = rules.counts(t)
        assert got[:5] == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside))


def labelled_table(spark):
    rng = random.Random(7)
    good = [" ".join(rng.choice(["the", "house", "is", "old", "and", "quiet,"]) + rng.choice("abcdefg") for _ in range(80)) for _ in range(150)]
    bad = [" ".join(rng.choice(["THE!!", "HOUSE###", "IS$$$"]) + rng.choice("ABCD") for _ in range(80)) for _ in range(50)]
    rows = [(t, q) for q, ts in ((1, good), (0, bad)) for t in ts]
    docs = table(spark, [*((k, t) for k, (t, _) in enumerate(rows)), (500, None), (501, ""), (None, "text")])
    labels = spark.createDataFrame([*((k, q, 0) for k, (_, q) in enumerate(rows)), (500, 0, 0), (700, 1, 1), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, dict(enumerate(q for _, q in rows))


def test_rules_and_classifier(spark):
    docs, labels, truth = labelled_table(spark)
    got = {r["doc_id"]: r for r in rules.apply_rules(docs, *rules.train(docs, labels)).collect()}
    assert len(got) == 203 and got[500]["base_failed"] and not got[None]["kept"]
    assert all(got[k]["kept"] == bool(q) for k, q in truth.items())
    model = classifier.train(docs, labels)
    got = {r["doc_id"]: r for r in classifier.score_quality(docs, model).collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] == (k in held) for k in truth)
    assert all(got[k]["predicted"] == truth[k] for k in held) and 0 < got[500]["score"] < 1 and got[501]["score"] == got[500]["score"]
    kept = {r["doc_id"] for r in classifier.good_documents(docs, model).collect()}
    assert kept == {k for k, r in got.items() if r["predicted"]}
    for f in (classifier.score_quality(empty(spark), model), rules.apply_rules(empty(spark), None, 1.0)):
        assert f.count() == 0
    nothing = classifier.train(docs, labels.where("false"))
    assert classifier.score_quality(docs, nothing).where("predicted = 0").count() == 0
    assert rules.apply_rules(docs, *rules.train(docs, labels.where("false"))).where("kept = base_failed").count() == 0


def test_rules_see_each_statistic(spark):
    """Kinds of bad text that no labelled row shows."""
    docs, labels, _ = labelled_table(spark)
    forest, threshold = rules.train(docs, labels)
    plain = docs.where("doc_id = 3").first()["text"]
    kinds = {"capitals": plain.upper(), "next": plain + " same" * 40, "lines": plain + "\nline" * 60, "long": plain.replace(" ", "abcdefghijklmno "), "plain": plain}
    odd = table(spark, list(enumerate(kinds.values())))
    kept = {r["doc_id"]: r["kept"] or r["base_failed"] for r in rules.apply_rules(odd, forest, threshold).collect()}
    assert dict(zip(kinds, map(kept.get, range(5)), strict=True)) == dict.fromkeys(kinds, False) | {"plain": True}


def test_rules_threshold_counts_all_labelled_rows(spark, monkeypatch):
    """Bad rows that are all longer than what the trees may grow from still set the threshold."""
    monkeypatch.setattr(classifier, "LONGEST", 500)
    docs, labels, truth = labelled_table(spark)
    assert {truth[r["doc_id"]] for r in classifier.labelled(docs, labels).collect() if r["doc_id"] in truth} == {1}
    forest, threshold = rules.train(docs, labels)
    assert threshold < 1 and not any(truth.get(r["doc_id"]) == 0 for r in rules.apply_rules(docs, forest, threshold).where("kept").collect())


def test_classifier_features_do_not_depend_on_the_slice():
    some = texts()
    together, of = classifier.features(some)
    for k, t in enumerate(some):
        assert sorted(together[of == k].tolist()) == sorted(classifier.features([t])[0].tolist())


def test_warc(spark):
    long, other = "é" * 600, "z" * 999
    rows = [(1, "http://a/ b\r\nX: y", long), (2, None, long), (9, "u", long), (3, "u", other), (4, "u", other), (5, "u", None), (6, "u", ""), (None, "u", "q" * 1000), (7, "u", "WARC/1.1\r\n\r\n" * 200), (9, "u", long), (8, "u", "x\r\n\r\n" * 40000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted((tuple(r) for r in warc.archive(spark, pages).collect()), key=repr)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        refers = 9 if html == long and page != 9 else None
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(want, key=repr)
    assert warc.archive(spark, pages.where("false")).count() == 0


def test_monolithic_stream_in_any_chunks():
    records = [warc.record(k, "u", b"p" * k, "d", None) for k in (0, 1, 50)]
    whole = b"".join(records)
    for step in (1, 7, 10_000):
        assert list(warc.split_records(whole[k : k + step] for k in range(0, len(whole), step))) == records
    with pytest.raises(ValueError):
        list(warc.split_records([whole[:-9]]))


def test_token_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark)
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, token_files.write_token_files(docs, new_path(spark, "t"), path)).collect()), key=lambda r: r[1])
    rows = sorted(((None, "no id here"), *enumerate(texts()), (3, texts()[3])), key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for k, t in rows:
        ids = [*library_ids("byte_bpe_50k.json", t), 2]
        want.append((k, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
    assert token_files.read_token_files(spark, token_files.write_token_files(empty(spark), new_path(spark, "t"), path)).count() == 0


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    label = {f: f for f in fps}
    root = lambda x: x if label[x] == x else root(label[x])
    some = sorted(label)
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                label[root(a)] = root(b)
    return {f: root(f) for f in some}


def test_simhash(spark):
    rows = [(k + 10, t) for k, t in enumerate(texts())] + [(None, "no id here"), (13, texts()[3]), (7, "")]
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table(spark, rows)).collect()), key=repr)
    fps = [(k, plain_fingerprint(t)) for k, t in rows]
    comp, least = plain_components({f for _, f in fps}), {}
    for k, f in fps:
        if k is not None:
            least[comp[f]] = min(k, least.get(comp[f], k))
    assert got == sorted(((k, f"{f:016x}", least.get(comp[f])) for k, f in fps), key=repr)
    kept = sorted((r["doc_id"] for r in simhash.one_of_each(table(spark, rows)).collect()), key=repr)
    assert kept == sorted((least.get(c) for c in set(comp.values())), key=repr)
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).columns == empty(spark).columns


@pytest.mark.parametrize("spread", [2, 64])
def test_links_lose_no_component(spark, spread, monkeypatch):
    """Dense balls of fingerprints, cut into many blocks, and chains of three bits a step."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(spread)
    fps = {rng.getrandbits(64) for _ in range(100)} | {0, 2**64 - 1, 1 << 63}
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(40):
            for _ in range(rng.randint(1, 3)):
                at ^= 1 << rng.randrange(spread)
            fps.add(at)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    groups = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r["node"] % 2**64: r["root"] for r in simhash.components(simhash.links(groups)).collect()}
    want, sizes = plain_components(fps), Counter(plain_components(fps).values())
    assert {f for f in fps if sizes[want[f]] > 1} == set(found)
    assert len({(want[f], r) for f, r in found.items()}) == len({want[f] for f in found}) == len(set(found.values()))


@pytest.mark.parametrize("chains", [False, True])
def test_components_of_raw_links(spark, chains):
    """Stars whose centre is the largest node, where no root is a child from the start; and chains of random nodes."""
    nodes = random.Random(3).sample(range(1000, 9000), 300)
    shapes = [list(zip(p, p[1:], strict=False)) for p in (nodes[k : k + 10] for k in range(0, 300, 10))] if chains else [[(10, 90), (20, 90)], [(-5, 99), (3, 99), (7, 99)], [(200, 201)]]
    edges = spark.createDataFrame([e for shape in shapes for e in shape], "a long, b long").repartition(3)
    got = sorted(tuple(r) for r in simhash.components(edges).collect())
    assert got == sorted((n, min(min(e) for e in shape)) for shape in shapes for n in {n for e in shape for n in e})


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = set(wordpiece.read_pieces(path))
    most = max(map(len, pieces))

    def greedy(word):
        n = at = 0
        while at < len(word):
            at += next(k for k in range(min(most, len(word) - at), 0, -1) if word[at : at + k] in pieces)
            n += 1
        return n

    greedy = functools.cache(greedy)

    rows = [*enumerate(texts()), (None, "x"), (0, texts()[0])]
    got = sorted(tuple(r) for r in wordpiece.count_pieces(table(spark, [(r[0] or 10**6, r[1]) for r in rows]), path).collect())
    want = []
    for k, t in rows:
        words = (t or "").encode().split()
        want.append((k or 10**6, len(words), sum(greedy(b" " + w) for w in words)))
    assert got == sorted(want)
    assert wordpiece.count_pieces(empty(spark), path).count() == 0


def test_automaton_on_a_small_vocabulary():
    a = wordpiece.Automaton([b"a", b"b", b"ab", b"abab", b"bba", b"abbabb"], b"ab")
    assert a.counts([b"", b"a", b"abbab", b"ababb", b"abbabb", b"bbabba"]).tolist() == [0, 1, 3, 2, 1, 2]


def test_mixing(spark):
    rows = [(k, "word " * (k % 7) + ("license" if k % 9 == 0 else "")) for k in range(400)]
    docs = table(spark, [*rows, (None, None), (900, ""), (5, rows[5][1])])
    got = mixing.mix(docs).collect()
    assert len(got) == 403 and all(r["probability"] == 0 and not r["sampled"] for r in got if r["n_tokens"] == 0)
    cells = Counter()
    for r in got:
        if r["n_tokens"]:
            cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    weight = {c: float(n) for c, n in cells.items()}
    share = lambda w, d: {v: sum(x for c, x in w.items() if c[d] == v) for v in {c[d] for c in w}}
    goals = []
    for d, p in enumerate(mixing.POWERS.values()):
        raised = {v: x**p for v, x in share(cells, d).items()}
        goals.append({v: x / sum(raised.values()) for v, x in raised.items()})
    for _ in range(mixing.ROUNDS):
        for d in range(3):
            now = share(weight, d)
            weight = {c: x * goals[d][c[d]] / now[c[d]] for c, x in weight.items()}
    most = max(weight[c] / cells[c] for c in cells)
    for r in got:
        if r["n_tokens"]:
            c = r["source"], r["lang"], r["topic"]
            assert abs(r["probability"] - weight[c] / cells[c] / most) < 1e-9
    kept = mixing.sampled_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["sampled"])
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_in_many_tasks_and_its_marginals(spark, monkeypatch):
    docs = table(spark, [(k, "word " * (k % 7 + 1)) for k in range(200)])
    one = sorted(tuple(r) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing.rake, "__defaults__", (mixing.ROUNDS, 0))
    many = sorted(tuple(r) for r in mixing.mix(docs).collect())
    assert [r[:5] + r[6:] for r in one] == [r[:5] + r[6:] for r in many] and all(abs(a[5] - b[5]) < 1e-12 for a, b in zip(one, many, strict=True))
    counted = mixing.mix(docs).where("n_tokens > 0").groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    goals, dims = mixing.targets(counted, mixing.POWERS), list(mixing.POWERS)
    left = mixing.marginals(mixing.rake(counted, goals, dims), goals, dims).collect()
    assert len(left) > 4 and all(abs(r["target"] - r["share"]) < 1e-3 for r in left)


def test_mixing_to_given_goals(spark):
    docs = table(spark, [(k, "word " * 5) for k in range(300)])
    given = lambda *rows: {"source": spark.createDataFrame(list(rows), "source string, _target double")}
    mixed = mixing.mix(docs, goals=given(("s0", 6.0), ("s1", 3.0), ("s2", 1.0), ("absent", 5.0)))
    p = {r["source"]: r["p"] for r in mixed.groupBy("source").agg(F.avg("probability").alias("p")).collect()}
    assert abs(p["s0"] / p["s1"] - 2) < 0.05 and abs(p["s1"] / p["s2"] - 3) < 0.05
    with pytest.raises(ValueError, match="s2"):
        mixing.mix(docs, goals=given(("s0", 0.5), ("s1", 0.5)))


def test_lookup_of_a_hot_key(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else (None if k % 2 else f"k{k}")) for k in range(3000)], "id long, key string")
    values = spark.createDataFrame([("hot", 2000, "v"), ("k6", 1, "w")], "key string, n long, value string")
    got = {r["id"]: r["value"] for r in lookup(rows, values, "key", "n").collect()}
    assert len(got) == 3000 and all(got[k] == ("v" if k % 3 else "w" if k == 6 else None) for k in got)
