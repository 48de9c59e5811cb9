"""Time-series, join, sampling and text operators on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lagweave.functions.dates import compose_datetime
from lagweave.functions.text import chunk_lines
from lagweave.operators import aggregate, clean, cohort, joins, metrics, ranges, routing, sampling, series
from lagweave.sources import readers


def test_interpolation_edges(spark):
    rows = [(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, None), (1, 4, 8.0), (1, 5, None), (2, 0, None), (2, 1, None)]
    df = spark.createDataFrame(rows, "s long, i long, v double")
    got = [(r["s"], r["i"], r["v"]) for r in series.interpolate_linear(df, ["s"], "i", ["v"]).orderBy("s", "i").collect()]
    assert [v for s, _, v in got if s == 1] == [2, 2, 4, 6, 8, 8] and [v for s, _, v in got if s == 2] == [None, None]


def test_interval_join(spark):
    ts = "timestamp'2024-01-01 {}:00:00'"
    events = spark.sql(" union all ".join(f"select {k}L as event, {s}L as subject, {ts.format(h)} as t" for k, s, h in ((1, 1, "00"), (2, 1, "05"), (3, 1, "12"), (4, 1, "23"), (5, 2, "05"))))
    spans = spark.sql(" union all ".join(f"select {k}L as stay, 1L as subject, {ts.format(a)} as a, {ts.format(b)} as b" for k, a, b in ((7, "00", "12"), (8, "05", "12"), (6, "05", "06"))))
    joined = joins.interval_join_first(events, spans, ["subject"], "event", "t", "stay", "a", "b")
    assert {r["event"]: r["stay"] for r in joined.collect()} == {1: 7, 2: 7, 3: 7, 4: None, 5: None}
    assert "BroadcastNestedLoopJoin" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("n", "size", "step"), [(10, 4, 2), (3, 4, 2), (9, 3, 5), (7, 7, 1), (20, 5, 1)])
def test_sliding_windows(spark, n, size, step):
    df = series.series_index(spark.range(n).select(F.lit(1).alias("s"), F.col("id").alias("ts")), ["s"], ["ts"])
    got = sorted((r["w"], r["i"], r["pos"]) for r in series.sliding_windows(df, ["s"], size, step).collect())
    assert got == [(w, w * step + k, k) for w in range(max(0, (n - size) // step + 1)) for k in range(size)]


def test_window_label_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([(2,), (1,), (1,), (2,)], "y long")
    assert df.agg(F.mode("y", True)).first()[0] == 1


def test_truncate_pad(spark):
    row = spark.sql("select array(1.0d, 2.0d, 3.0d) as a").select(*[series.truncate_pad(F.col("a"), n, F.lit(0.0), last).alias(f"{n}{last}") for n in (2, 5) for last in (False, True)]).first()
    assert list(row) == [[1, 2], [2, 3], [1, 2, 3, 0, 0], [1, 2, 3, 0, 0]]


def test_timelines(spark):
    lags = spark.createDataFrame([(k, float(k)) for k in range(3)], "k int, v double")
    assert [r["v"] for r in series.timeline_segments(lags, 8, 3).orderBy("t").collect()] == [0, 0, 1, 1, 2, 2, 2, 2]
    knots = spark.createDataFrame([("p", 2, 1.0), ("p", 4, 3.0), ("p", 99, 9.0)], "m string, lag long, value double")
    assert [r["value"] for r in series.timeline_interp(knots, ["m"], 7).orderBy("t").collect()] == [1, 1, 1, 2, 3, 6, 9]


def test_dominance_worked_by_hand(spark):
    rows = [("a", 0, .5, .2, .2, .1, 1.0), ("a", 1, .6, .2, .1, .1, 1.0), ("a", 2, 9., 0., 0., 0., 1e-12), ("a", 3, 1., 0., 0., 0., float("nan")), ("b", 0, .4, .3, .2, .1, 1.0), ("c", 0, .1, .45, .45, 0., 1.0)]
    df = spark.createDataFrame(rows, "pair string, lag int, R double, U1 double, U2 double, S double, MI double")
    got = aggregate.dominant_terms(df, ["pair"])
    assert {r["pair"]: r["dominant"] for r in got.collect()} == {"a": "R", "b": None, "c": "U1"}
    assert {r["term"]: r["pairs"] for r in aggregate.dominance_summary(got).collect()} == {"R": 1, "U1": 1, "U2": 0, "S": 0}
    assert {r["pair"]: r["lags"] for r in aggregate.average_over_lags(df, ["pair"]).collect()}["a"] == 2


def test_datetimes(spark):
    rows = [("20240229", "93015.5"), ("20230229", "120000"), ("20240101", None), (None, "1"), ("20240101", "250000")]
    df = spark.createDataFrame(rows, "d string, t string")
    assert [str(r[0]) for r in df.select(compose_datetime(F.col("d"), F.col("t"))).collect()] == ["2024-02-29 09:30:15", "None", "2024-01-01 00:00:00", "None", "None"]


def test_chunks(spark):
    df = spark.createDataFrame([("a b\nc d\ne",), ("a b c d e f",), ("",), ("\n \n",), (None,), ("a b c d\ne",)], "t string")
    got = [r[0] and [tuple(c) for c in r[0]] for r in df.select(chunk_lines(F.col("t"), 4)).collect()]
    assert got == [[("a b c d", 4), ("e", 1)], [("a b c d e f", 6)], [], [], None, [("a b c d", 4), ("e", 1)]]


def test_chunks_in_any_blocks(spark):
    """Blocks of chunks, full ones, a part and none, give the chunks of one pass in Python."""
    rng = random.Random(4)
    texts = ["\n".join(" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 6))) for _ in range(n)) for n in (0, 1, 2, 3, 9, 40, 200)]

    def plain(text):
        out, held = [], []
        for line in (x for x in text.split("\n") if x.split()):
            if held and len(" ".join([*held, line]).split()) > 5:
                out, held = [*out, " ".join(held)], []
            held.append(line)
        return [*out, " ".join(held)] if held else out

    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for block in (1, 2, 3, 256):
        got = df.select(chunk_lines(F.col("t"), 5, block=block).alias("c"), "k").orderBy("k").collect()
        assert [[c["chunk"] for c in r["c"]] for r in got] == [plain(t) for t in texts], block


def test_ranked_is_the_whole_order(spark):
    got = sampling.ranked(spark.range(500), "id", 3).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(500))
    want = spark.range(500).orderBy(sampling.hash_order(F.col("id"), 3)).collect()
    assert [r["id"] for r in got] == [r["id"] for r in want]
    sizes = {r["split"]: r["count"] for r in sampling.split_random(spark.range(101), "id", 1).groupBy("split").count().collect()}
    assert sizes == {"train": 70, "val": 15, "test": 16}


def test_metrics_edges(spark):
    one = spark.createDataFrame([(1, .2), (1, .4)], "y long, score double")
    assert metrics.roc_auc(one, "y", "score").first()["auc"] == 0
    two = spark.createDataFrame([(1, .5), (0, .5), (1, .9), (0, .1)], "y long, score double")
    assert metrics.roc_auc(two, "y", "score").first()["auc"] == 0.875
    assert metrics.best_epoch(spark.createDataFrame([(1, .5), (2, .7), (3, .7)], "epoch long, m double"), "epoch", "m").first()["epoch"] == 2


def test_cleaning_edges(spark):
    assert clean.parse_id_list("1,3-5") == [1, 3, 4, 5] and series.lag_grid(12, 4) == [0, 3, 6, 9]
    with pytest.raises(ValueError):
        series.lag_grid(10, 4)
    with pytest.raises(ValueError):
        clean.assert_same_features(spark.range(1).selectExpr("id", "1 as a"), spark.range(1).selectExpr("id", "1 as b"), ["id"])
    flat = spark.createDataFrame([(1.0, 5.0), (1.0, None), (1.0, 7.0)], "c double, v double")
    assert {r["column"]: (r["mean"], r["std"]) for r in aggregate.fit_standardizer(flat, ["c", "v"]).collect()} == {"c": (1, 1), "v": (6, 1)}


def test_sensor_files_and_assets(spark, tmp_path):
    (tmp_path / "subject7.dat").write_text("1.5 2  NaN\n  3 x 4 \n")
    rows = readers.read_sensor_text(spark, str(tmp_path / "*.dat"), ["a", "b", "c"]).collect()
    assert [tuple(r) for r in rows] == [(7, 1.5, 2, None), (7, 3, None, 4)]
    folder = tmp_path / "files/p10/p10001/s3"
    folder.mkdir(parents=True)
    (folder / "x.jpg").write_bytes(b"1")
    asked = spark.createDataFrame([(10001, 3, "x"), (10001, 3, "y")], "subject long, study long, name string").withColumn("path", readers.asset_path(F.col("subject"), F.col("study"), F.col("name")))
    assert [r["name"] for r in readers.existing_assets(spark, asked, str(tmp_path / "files"), "path").collect()] == ["x"]


def test_interval_join_over_period_borders(spark):
    """Long, short, reversed and touching intervals, one subject with most rows, against plain Python."""
    spans = [(1, 10, 0, 400), (1, 11, 30, 40), (1, 12, 47, 48), (2, 13, 50, 20), (1, 14, 0, 400), (3, 15, 5, None), (2, 16, 24, 24)]
    events = [(k, 1 if k % 5 else 2, k) for k in range(300)] + [(900, 3, 6), (901, 1, None), (902, 1, 401)]
    hour = lambda c: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, {c})")
    s = spark.createDataFrame(spans, "subject long, span long, a int, b int").select("subject", "span", hour("a").alias("start"), hour("b").alias("end"))
    e = spark.createDataFrame(events, "event long, subject long, a int").select("event", "subject", hour("a").alias("at"))
    want = {ev: min(((a, sp) for su, sp, a, b in spans if su == sub and None not in (b, at) and a <= at <= b), default=(None, None))[1] for ev, sub, at in events}
    for days in (1, 3):
        got = joins.interval_join_first(e, s, ["subject"], "event", "at", "span", "start", "end", days).collect()
        assert len(got) == len(events) and {r["event"]: r["span"] for r in got} == want


def test_align_vectors(spark):
    rows = spark.createDataFrame([(1, 1.2, [1.0, 2.0]), (1, 1.9, [3.0, 2.0]), (1, 3.0, [6.0, 0.0]), (1, 9.0, [9.0, 9.0]), (1, -1.0, [9.0, 9.0]), (3, 0.0, [1.0, 1.0])], "k long, h double, v array<double>")
    steps = spark.createDataFrame([(1, 5), (2, 2), (3, 0)], "k long, n long")
    got = lambda line: {(r["k"], r["t"]): (r["v"], r["mask"]) for r in series.align_vectors(rows, steps, "k", "h", "v", 2, 1.0, line).collect()}
    none = ([0.0, 0.0], False)
    assert got(False) == {(1, 0): none, (1, 1): ([2.0, 2.0], True), (1, 2): none, (1, 3): ([6.0, 0.0], True), (1, 4): none, (2, 0): none, (2, 1): none}
    assert got(True) == {(1, 0): ([2.0, 2.0], True), (1, 1): ([2.0, 2.0], True), (1, 2): ([4.0, 1.0], True), (1, 3): ([6.0, 0.0], True), (1, 4): ([6.0, 0.0], True), (2, 0): none, (2, 1): none}


def test_sequence_dataset(spark):
    steps = spark.createDataFrame([(1, "b", 1, [2.0], True), (1, "b", 0, [1.0], True), (1, "b", 2, [3.0], False), (2, "a", 0, [5.0, 6.0], True)], "k long, m string, t long, v array<double>, mask boolean")
    got = {r["k"]: r for r in cohort.sequence_dataset(steps, "k", "m", 2, {"b": 1, "a": 2}).collect()}
    assert list(got[1].asDict()) == ["k", "a", "b"]
    assert [tuple(x) for x in got[1]["a"]] == [([0.0, 0.0], False)] * 2 and [tuple(x) for x in got[1]["b"]] == [([1.0], True), ([2.0], True)]
    assert [tuple(x) for x in got[2]["a"]] == [([5.0, 6.0], True), ([0.0, 0.0], False)] and [tuple(x) for x in got[2]["b"]] == [([0.0], False)] * 2
    last = cohort.sequence_dataset(steps, "k", "m", 2, {"b": 1, "a": 2}, True).where("k = 1").first()
    assert [tuple(x) for x in last["b"]] == [([2.0], True), ([3.0], False)]


def test_task_window_and_stays(spark):
    stays = spark.sql("select s as stay_id, timestamp'2024-01-01' as intime, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, h) as outtime from values (1L, 48), (2L, 47), (3L, 48) as x(s, h)")
    series_rows = spark.createDataFrame([(1, 0.0), (1, 48.0), (1, 48.5), (1, -0.1), (2, 1.0), (3, 2.0)], "stay_id long, t double")
    notes = spark.createDataFrame([(1, 1.0), (1, 2.0), (3, 3.0), (3, 99.0)], "stay_id long, t double")
    cut = cohort.task_window({"a": series_rows, "b": notes}, {"a": "t", "b": "t"}, stays, "stay_id", 48, 2, 2, ["b"])
    assert sorted(map(tuple, cut["a"].collect())) == [(1, 0.0), (1, 48.0), (3, 2.0)] and sorted(map(tuple, cut["b"].collect())) == [(1, 1.0), (1, 2.0)]
    assert [r[0] for r in cohort.task_stays(cut, "stay_id").collect()] == [1]
    assert sorted(r[0] for r in cohort.task_stays(cut, "stay_id", True).collect()) == [1, 3]


def test_interval_pairs_of_a_busy_subject(spark):
    """A subject with all rows: intervals meet events of their periods only, and both ends count."""
    at = lambda h: F.timestamp_seconds(F.lit(1_700_000_000) + h * 3600)
    events = spark.range(3000).select(F.lit(1).alias("s"), F.col("id").alias("e"), at(F.col("id")).alias("time"))
    spans = spark.range(0, 3000, 50).select(F.lit(1).alias("s"), F.col("id").alias("span"), at(F.col("id")).alias("start"), at(F.col("id") + 30).alias("end"))
    got = joins.interval_pairs(events, spans, ["s"], "time", "start", "end", 2)
    assert {(r["e"], r["span"]) for r in got.collect()} == {(e, k) for k in range(0, 3000, 50) for e in range(k, min(k + 31, 3000))}
    met = events.withColumn("_d", F.floor(F.unix_date(F.to_date("time")) / 2)).groupBy("_d").count().agg(F.max("count")).first()[0]
    assert met <= 48 and "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_imputed_beginning_is_the_whole_series_beginning(spark):
    rows = [(1, 0.5, 1.0), (1, 3.2, 4.0), (1, 60.0, 10.0), (2, 70.0, 5.0), (3, 2.0, None), (4, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "k long, h double, v double")
    keep = df.where("k <> 4")
    whole = series.impute(df, ["k"], "h", ["v"])
    cut = series.impute(df, ["k"], "h", ["v"], upto=48, keep=keep)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.where("t <= 48 and k <> 4").collect()))
    assert cut.where("k = 2").count() == 49 and {r["v"] for r in cut.where("k = 3").collect()} == {5.4}


@pytest.mark.parametrize("block", [7, 50])
def test_ranges_of_one_long_series(spark, block):
    """One series of 400 rows and a short one in ranges: the rows of the window forms, and ranges no longer than told."""
    rows = [(1, k * 100, k, None if k % 3 or 100 < k < 180 or k < 20 else float(k % 17), k % 5 if k % 11 else None) for k in range(400)] + [(2, 5, 1, None, 0), (2, 6, 2, None, 1)]
    df = spark.createDataFrame(rows, "s long, ts long, e long, x double, y long")
    whole = series.series_index(df, ["s"], ["ts", "e"])
    cut = ranges.series_index(df, ["s"], ["ts", "e"], F.floor(F.col("ts") / 3000))
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)
    assert same(whole, cut)
    assert same(series.lag_align(whole, ["s"], ["x"], "y", 12, others=["e"]), ranges.lag_align(whole, ["s"], ["x"], "y", 12, block, others=["e"]))
    assert same(series.interpolate_linear(whole, ["s"], "i", ["x"]), ranges.interpolate_linear(whole, ["s"], "i", ["x"], block))
    plan = ranges.lag_align(whole, ["s"], ["x"], "y", 12, block)._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and "NestedLoop" not in plan


def test_gated_losses(spark):
    """Three pairs at two times by hand: one that counts for all terms, one with one modality's share too low, one without terms."""
    p, q = [0.5, 0.25, 0.25], [0.25, 0.25, 0.5]
    pairs = spark.createDataFrame([(0, "a", "b", p, q), (0, "a", "c", p, p), (1, "a", "b", p, q)], "step int, m1 string, m2 string, p1 array<double>, p2 array<double>")
    unique = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.4), (0, "c", 0.1)], "step int, m string, u double")
    shared = spark.createDataFrame([(0, "a", "b", 0.3, 0.3), (0, "a", "c", 0.3, 0.1)], "step int, m1 string, m2 string, r double, s double")
    rows = routing.gate(pairs, unique, shared, ["step"])
    far = 0.5 * math.log(0.5 / 0.375) + 0.25 * math.log(0.25 / 0.375)  # both halves of the divergence are equal here
    got = {r["term"]: (r["n"], r["loss"]) for r in routing.gated_losses(rows, {"U": 0.2, "R": 0.2, "S": 0.2}, [2], {"S": 2.0}).collect()}
    assert got["U"] == (1, pytest.approx(-far)) and got["R"] == (2, pytest.approx(far / 2)) and got["S"] == (1, pytest.approx(2 * (1 - 0.375)))
    one = routing.divergence_where(rows, routing.counts_for("U", 0.2), -1.0).first()
    assert (one["n"], one["loss"]) == (1, pytest.approx(-far))
    none = routing.divergence_where(rows, routing.counts_for("R", 0.9)).first()
    assert (none["n"], none["loss"]) == (0, 0.0)


def test_long_tables_are_imputed_in_more_parts(spark, monkeypatch):
    """Parts follow the steps, not the session's number of parts; the values don't change."""
    rows = spark.range(600).select((F.col("id") % 60).alias("k"), ((F.col("id") * 7) % 40).cast("double").alias("at"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("v"))
    want = sorted(map(tuple, series.impute(rows, ["k"], "at", ["v"]).collect()))
    dealt = series.spread
    monkeypatch.setattr(series, "spread", lambda df, keys, n: dealt(df, keys, n, 100))
    got = series.impute(rows, ["k"], "at", ["v"])
    assert got.rdd.getNumPartitions() > 4 and sorted(map(tuple, got.collect())) == want


def test_an_encoder_gets_short_lists(spark):
    def load():
        def encode(values):
            return [[float(len(values)), float(len(v or ""))] for v in values]

        return encode

    rows = readers.batch_map(spark.range(700).repartition(1).select("id", F.when(F.col("id") != 3, F.repeat(F.lit("a"), F.col("id").cast("int"))).alias("t")), "t", "v", load).collect()
    assert max(r["v"][0] for r in rows) == readers.BATCH and all(r["v"][1] == len(r["t"] or "") for r in rows) and len(rows) == 700
