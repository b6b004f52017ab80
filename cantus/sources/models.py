"""The table of model families and their weight files.

Weights come from a local or shared folder; nothing is downloaded. A registry is a TOML file with a schema version, a
base URL and per family its files with SHA-256 digests; weights are arrays in .npz files and never pickled objects.
"""

from __future__ import annotations

import io
import re
import tomllib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGEST = re.compile("[0-9a-f]{64}")
SCHEMA = "family string, license string, relpath string, sha256 string, url string"

# The model families by name, the task that each serves and how many files it has.
FAMILIES = {
    "beats_blstm": ("beats", 8),
    "beats_lstm": ("beats", 8),
    "chords_cfcrf": ("chords", 1),
    "chords_cnn_feat": ("chords", 1),
    "chords_dccrf": ("chords", 1),
    "chroma_dnn": ("chroma", 1),
    "downbeats_bgru_harmonic": ("downbeats", 6),
    "downbeats_bgru_rhythmic": ("downbeats", 6),
    "downbeats_blstm": ("downbeats", 8),
    "key_cnn": ("key", 1),
    "notes_brnn": ("notes", 1),
    "notes_cnn": ("notes", 1),
    "onsets_brnn": ("onsets", 8),
    "onsets_cnn": ("onsets", 1),
    "onsets_rnn": ("onsets", 8),
    "patterns_ballroom": ("patterns", 2),
}


def parse_registry(text: str) -> list[tuple[str, str, str, str, str]]:
    """Rows (family, license, relpath, sha256, url) of a registry; anything out of order raises."""
    data = tomllib.loads(text)
    if data.get("schema", {}).get("version") != 1:
        raise ValueError("the registry's schema version must be 1")
    rows = []
    for family, spec in data.get("models", {}).items():
        base = spec.get("base_url", data.get("base_url", ""))
        if not str(base).startswith("https://"):
            raise ValueError(f"{family}: the base URL must be https")
        if not spec.get("files"):
            raise ValueError(f"{family} has no files")
        for file in spec["files"]:
            path, digest = file["path"], file["sha256"]
            if path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"{family}: {path} is not a relative path")
            if not _DIGEST.fullmatch(digest):
                raise ValueError(f"{family}: {path} has no SHA-256 digest")
            rows.append((family, spec.get("license", ""), path, digest, f"{base.rstrip('/')}/{path}"))
    return rows


def checkpoint_catalog(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_registry(text), SCHEMA)


def families(spark: SparkSession) -> DataFrame:
    """The known families: (family, task, files)."""
    return spark.createDataFrame([(name, *of) for name, of in FAMILIES.items()], "family string, task string, files bigint")


def listed(catalog: DataFrame) -> DataFrame:
    """Known families against a registry: (family, task, files due, listed files, whole)."""
    counts = catalog.groupBy("family").agg(F.count("*").alias("listed"))
    due = families(catalog.sparkSession).join(F.broadcast(counts), "family", "left").withColumn("listed", F.coalesce("listed", F.lit(0).cast("bigint")))
    return due.withColumn("whole", F.col("listed") == F.col("files"))


def family(catalog: DataFrame, name: str) -> DataFrame:
    found = catalog.filter(F.col("family") == name)
    if found.isEmpty():
        raise KeyError(name)
    return found


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(relpath, found): digests of the files below a folder, computed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split(":")[-1].lstrip("/")
    return files.select(F.regexp_extract("path", re.escape(root) + "/(.*)$", 1).alias("relpath"), F.sha2("content", 256).alias("found"))


def cache_info(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Per family: its files, how many exist and are verified, and whether it is complete."""
    joined = catalog.join(files, "relpath", "left")
    good = F.col("found").eqNullSafe(F.col("sha256"))
    return joined.groupBy("family").agg(
        F.count("*").alias("files"), F.count("found").alias("exist"), F.sum(good.cast("bigint")).alias("verified"), F.bool_and(good).alias("complete")
    )


def load_weights(spark: SparkSession, path: str, sha256: str | None = None) -> dict[str, np.ndarray]:
    """Arrays of one .npz file; a wrong digest raises. A model file has a fixed size and is read on the driver."""
    row = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("digest")).first()
    if sha256 and row["digest"] != sha256:
        raise ValueError(f"{path} has digest {row['digest']}")
    with np.load(io.BytesIO(row["content"]), allow_pickle=False) as arrays:
        return {k: arrays[k] for k in arrays.files}
