"""Queries on the registry of models.

The documents stand for model files: a document's number names its family, its text is the file, and a label tells that
the file is there, as it should be where the quality is 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import models
from .registry import query
from .views import table

NAMES = list(models.FAMILIES)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod("doc_id", F.lit(len(NAMES))) + 1).cast("int"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    path = F.concat(family, F.lit("/"), F.col("doc_id"), F.lit(".npz"))
    url = F.concat(F.lit("https://example.org/models/"), path)
    return table(spark, sf_dir, "documents").select(family.alias("family"), F.lit("CC0").alias("license"), path.alias("relpath"), digest.alias("sha256"), url.alias("url"), "doc_id")


def _registry(rows: DataFrame) -> str:
    """The registry text of a bounded table of (family, relpath, sha256)."""
    parts = ['base_url = "https://example.org/models"', "[schema]", "version = 1"]
    of: dict[str, list] = {}
    for r in rows.collect():
        of.setdefault(r["family"], []).append(r)
    for name, files in of.items():
        parts += [f"[models.{name}]", 'license = "CC0"']
        for r in files:
            parts += [f"[[models.{name}.files]]", f'path = "{r["relpath"]}"', f'sha256 = "{r["sha256"]}"']
    return "\n".join(parts)


_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_CATALOG = f"cat AS (SELECT {_NAMES}[1 + doc_id % {len(NAMES)}] AS family, {_NAMES}[1 + doc_id % {len(NAMES)}] || '/' || doc_id || '.npz' AS relpath, sha256(coalesce(text, '')) AS sha256, doc_id FROM documents)"
_FAMILIES = "fam(family, task, files) AS (VALUES " + ", ".join(f"('{n}', '{t}', {k}::BIGINT)" for n, (t, k) in models.FAMILIES.items()) + ")"


@query("model_families", f"WITH {_FAMILIES}, {_CATALOG}, c AS (SELECT family, count(*) AS listed FROM cat GROUP BY 1) SELECT family, task, files, coalesce(listed, 0) AS listed, coalesce(listed, 0) = files AS whole FROM fam LEFT JOIN c USING (family)")
def _(spark, sf):
    return models.listed(_catalog(spark, sf))


@query("checkpoint_catalog", f"WITH {_CATALOG} SELECT family, 'CC0' AS license, min(relpath) AS relpath, min_by(sha256, relpath) AS sha256, 'https://example.org/models/' || min(relpath) AS url FROM cat GROUP BY family")
def _(spark, sf):
    firsts = _catalog(spark, sf).groupBy("family").agg(F.min("relpath").alias("relpath"), F.min_by("sha256", "relpath").alias("sha256"))  # one file per family
    return models.checkpoint_catalog(spark, _registry(firsts))


@query(
    "cache_info",
    f"WITH {_CATALOG}, held AS (SELECT doc_id, CASE WHEN l.quality = 1 THEN sha256 ELSE sha256(sha256) END AS found FROM cat JOIN labels l USING (doc_id)), j AS (SELECT family, sha256, found FROM cat LEFT JOIN held USING (doc_id)) "
    "SELECT family, count(*) AS files, count(found) AS exist, count(*) FILTER (found IS NOT DISTINCT FROM sha256) AS verified, bool_and(found IS NOT DISTINCT FROM sha256) AS complete FROM j GROUP BY 1",
)
def _(spark, sf):
    catalog = _catalog(spark, sf)
    found = F.when(F.col("quality") == 1, F.col("sha256")).otherwise(F.sha2(F.col("sha256").cast("binary"), 256))
    files = catalog.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select("relpath", found.alias("found"))
    return models.cache_info(catalog.drop("doc_id"), files)


@query("model_family", f"WITH {_CATALOG} SELECT relpath FROM cat WHERE family = 'beats_lstm'")
def _(spark, sf):
    return models.family(_catalog(spark, sf), "beats_lstm").select("relpath")
