"""Chord segments, key labels and note onsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .onsets import pick_onsets

# Pitch classes in the order of the models' outputs.
PITCHES = ("A", "A#", "B", "C", "C#", "D", "D#", "E", "F", "F#", "G", "G#")


# Keys in the order of the models' outputs.
KEYS = (
    "A major", "Bb major", "B major", "C major", "Db major", "D major", "Eb major", "E major", "F major", "F# major", "G major", "Ab major",
    "A minor", "Bb minor", "B minor", "C minor", "C# minor", "D minor", "D# minor", "E minor", "F minor", "F# minor", "G minor", "G# minor",
)


def _pick(names: tuple[str, ...], state: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(state, F.lit(len(names))) + 1).cast("int"))


def chord_label(state: Column) -> Column:
    """0-11 major, 12-23 minor, 24 no chord."""
    return F.when(state == 24, F.lit("N")).otherwise(F.concat(_pick(PITCHES, state), F.when(state < 12, F.lit(":maj")).otherwise(F.lit(":min"))))


def key_label(state: Column) -> Column:
    return _pick(KEYS, state)


def chord_segments(targets: DataFrame, fps: float) -> DataFrame:
    """Runs of equal states (track, frame, state): (track, start, end, label) in seconds."""
    order = Window.partitionBy("track").orderBy("frame")
    change = F.when(F.col("state") == F.lag("state").over(order), 0).otherwise(1)
    runs = targets.withColumn("_c", change).withColumn("_run", F.sum("_c").over(order))
    spans = runs.groupBy("track", "_run").agg((F.min("frame") / fps).alias("start"), ((F.max("frame") + 1) / fps).alias("end"), F.first("state").alias("state"))
    return spans.select("track", "start", "end", chord_label(F.col("state")).alias("label"))


def key_labels(scores: DataFrame) -> DataFrame:
    """Best of 24 states (track, state, p), the first of equals: (track, label)."""
    best = scores.groupBy("track").agg(F.max_by("state", F.struct("p", -F.col("state"))).alias("state"))
    return best.select("track", key_label(F.col("state")).alias("label"))


def note_onsets(acts: DataFrame, fps: float, threshold: float, **spans: float) -> DataFrame:
    """Onsets (track, pitch, t) per pitch of activations (track, pitch, frame, a)."""
    return pick_onsets(acts, fps, threshold, keys=("track", "pitch"), **spans)
