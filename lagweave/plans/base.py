"""Registration of queries with their SQL, and the fixture views both sides read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.operators import series as S
from lagweave.operators.clean import label_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, d: str) -> DataFrame:
    """Sensor series: one subject a user, two signals and a label in time order."""
    events = table(spark, d, "events")
    rows = events.select("event_id", F.col("user_id").alias("subject"), "ts", F.col("value").alias("x1"), F.get_json_object("props", "$.k").cast("double").alias("x2"), "event_type")
    return S.series_index(S.spread(label_index(rows, "event_type", "y"), ["subject"], events.count()), ["subject"], ["ts", "event_id"])


SERIES = """WITH lab AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS y FROM (SELECT DISTINCT event_type FROM events)),
series AS (SELECT event_id, user_id AS subject, ts, value AS x1, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x2, event_type, y,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n
  FROM events JOIN lab USING (event_type))"""


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """The series with every seventh first signal missing."""
    return series(spark, d).withColumn("x1", F.when(F.col("event_id") % 7 != 0, F.col("x1")))


GAPS = SERIES + ", gaps AS (SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN x1 END AS x1) FROM series)"


def stays(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'signup'")
    return e.select(F.col("event_id").alias("stay_id"), F.col("user_id").alias("subject"), F.col("ts").alias("intime"), (F.col("ts") + F.expr("interval 24 hours")).alias("outtime"))


def admissions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = e.where("event_type = 'purchase'").select(F.col("event_id").alias("hadm_id"), F.col("user_id").alias("subject"), F.col("ts").alias("admittime"), (F.col("ts") + F.expr("interval 5 days")).alias("dischtime"))
    return a


STAYS = "stays AS (SELECT event_id AS stay_id, user_id AS subject, ts AS intime, ts + INTERVAL 24 HOUR AS outtime FROM events WHERE event_type = 'signup')"
ADMISSIONS = "admissions AS (SELECT event_id AS hadm_id, user_id AS subject, ts AS admittime, ts + INTERVAL 5 DAY AS dischtime FROM events WHERE event_type = 'purchase')"


def measures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("subject"), F.col("ts").alias("charttime"), F.col("event_type").alias("event"), F.col("value").alias("valuenum"))


MEASURES = "measures AS (SELECT event_id, user_id AS subject, ts AS charttime, event_type AS event, value AS valuenum FROM events)"


def halves(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of two modalities, the first and the second half of the numbers, grouped as masked sequences."""
    v = table(spark, d, "embeddings").where("embedding is not null and size(embedding) = 64")
    e = F.col("embedding").cast("array<double>")
    return v.select("vec_id", F.floor(F.col("vec_id") / 10).cast("long").alias("seq"), (F.col("vec_id") % 10).alias("t"), F.slice(e, 1, 32).alias("a"), F.slice(e, 33, 32).alias("b"), F.col("label").cast("long").alias("y"), (F.col("vec_id") % 3 != 0).alias("mask"))


HALVES = "halves AS (SELECT vec_id, CAST(floor(vec_id / 10.0) AS BIGINT) AS seq, vec_id % 10 AS t, CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:64] AS DOUBLE[]) AS b, CAST(label AS BIGINT) AS y, vec_id % 3 <> 0 AS mask FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64)"


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Predictions: quality is the truth, the score a function of the length."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", F.col("quality").cast("long").alias("y"), ((F.col("n_chars") % 97) / 97.0).alias("score"))


SCORES = "WITH scores AS (SELECT doc_id, CAST(quality AS BIGINT) AS y, (n_chars % 97) / 97.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


def routing(spark: SparkSession, d: str) -> DataFrame:
    """A routing log: each event a token of a sample (user) and modality (event type) with eight logits."""
    rows = series(spark, d)
    logits = F.array(*[F.conv(F.substring(F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.lit(str(k)))), 1, 6), 16, 10).cast("double") / 4194304.0 for k in range(8)])
    return rows.select(F.col("subject").alias("sample"), F.col("event_type").alias("modality"), "event_id", F.col("i").alias("t"), logits.alias("logits"))


ROUTING = SERIES + ", routing AS (SELECT subject AS sample, event_type AS modality, event_id, i AS t, [" + ", ".join(f"CAST(CAST(concat('0x', substr(md5(concat(CAST(event_id AS VARCHAR), ':{k}')), 1, 6)) AS BIGINT) AS DOUBLE) / 4194304.0::DOUBLE" for k in range(8)) + "] AS logits FROM series)"
