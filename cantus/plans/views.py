"""Music-like views of the driver's tables, for Spark and as SQL.

signal: a user's event values in order of time. spectrogram: the magnitudes of a label's vectors. activation: a kind of
event's share of its busiest hour, hour by hour. symbols: the kinds of a user's events in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(keys: str, *order: str):
    return (F.row_number().over(Window.partitionBy(keys).orderBy(*order)) - 1).cast("bigint")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return events.select(F.col("user_id").alias("track"), _place("user_id", "ts", "event_id").alias("n"), F.col("value").alias("x"))


SIGNAL = "sig AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value AS x FROM events)"


def spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("track"), _place("label", "vec_id").alias("frame"), "embedding")
    rows = vectors.select("track", "frame", F.posexplode("embedding").alias("bin", "e"))
    return rows.select("track", "frame", F.col("bin").cast("bigint").alias("bin"), F.abs(F.col("e").cast("double")).alias("mag"))


SPECTROGRAM = (
    "vec AS (SELECT label::BIGINT AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings), "
    "spec AS (SELECT track, frame, b - 1 AS bin, abs(embedding[b]::DOUBLE) AS mag FROM vec, range(1, 65) t(b))"
)


def activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("track"), F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("h"))
    counts = events.groupBy("track", "h").agg(F.count("*").alias("c"))
    span = counts.groupBy("track").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("c").alias("mx"))
    hours = span.select("track", "lo", "mx", F.explode(F.sequence("lo", "hi")).alias("h"))
    return hours.join(counts, ["track", "h"], "left").select("track", (F.col("h") - F.col("lo")).alias("frame"), (F.coalesce("c", F.lit(0)) / F.col("mx")).alias("a"))


ACTIVATION = (
    "cnt AS (SELECT event_type AS track, date_diff('hour', TIMESTAMP '1970-01-01 00:00:00', ts) AS h, count(*) AS c FROM events GROUP BY 1, 2), "
    "span AS (SELECT track, min(h) AS lo, max(h) AS hi, max(c) AS mx FROM cnt GROUP BY track), "
    "hrs AS (SELECT track, lo, mx, unnest(range(lo, hi + 1)) AS h FROM span), "
    "act AS (SELECT hrs.track, hrs.h - lo AS frame, coalesce(c, 0)::DOUBLE / mx AS a FROM hrs LEFT JOIN cnt ON cnt.track = hrs.track AND cnt.h = hrs.h)"
)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    code = F.length("event_type") % 4
    return events.select(F.col("user_id").alias("track"), _place("user_id", "ts", "event_id").alias("frame"), code.cast("int").alias("symbol"))


SYMBOLS = "obs AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, (length(event_type) % 4)::INTEGER AS symbol FROM events)"


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times of a user in days from the first one."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("s")).distinct()
    first = F.min("s").over(Window.partitionBy("track"))
    return events.select("track", ((F.col("s") - first) / 86400.0).alias("t"))


ONSETS = (
    "secs AS (SELECT DISTINCT user_id AS track, floor(epoch(ts))::BIGINT AS s FROM events), "
    "ons AS (SELECT track, (s - min(s) OVER (PARTITION BY track)) / 86400.0 AS t FROM secs)"
)


# --- what the data holds at each place of a table that parameters fix --------------------------------------------------

#: By kind: SQL of (k, seen), to be formatted with the family names.
SEEN = {
    "spectrum": f"WITH {SPECTROGRAM} SELECT bin AS k, floor(sum(mag) * 1e6 + 0.5) / 1e6 AS seen FROM spec GROUP BY 1",
    "activation": f"WITH {ACTIVATION} SELECT frame AS k, floor(sum(a) * 1e6 + 0.5) / 1e6 AS seen FROM act GROUP BY 1",
    "values": "SELECT floor(value)::BIGINT AS k, count(*)::DOUBLE AS seen FROM events GROUP BY 1",
}


def seen(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(k, seen): the magnitude of each bin, the activation of each frame, or the events of each whole value."""
    if kind == "values":
        return table(spark, sf_dir, "events").groupBy(F.floor("value").cast("bigint").alias("k")).agg(F.count("*").cast("double").alias("seen"))
    rows, key, value = (spectrogram(spark, sf_dir), "bin", "mag") if kind == "spectrum" else (activation(spark, sf_dir), "frame", "a")
    return rows.groupBy(F.col(key).alias("k")).agg((F.floor(F.sum(value) * 1e6 + 0.5) / 1e6).alias("seen"))
