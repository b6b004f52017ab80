"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first (compatibility forms, accents, homoglyphs, digit and sign substitutions). Weights are log odds
of a word in toxic against other labelled documents; the score is a logistic function of the matched weight, of that
weight by text length, and of their presence. Matches inside exception phrases don't count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, text_of, written

#: The classifier is fitted on at most so many labelled rows, those of the least hash; the lexicon holds at most so many words.
TRAIN_ROWS, LEXICON_WORDS = 20_000, 2_000
#: A document is predicted toxic from this score on.
THRESHOLD = 0.7

# Letters that look like Latin ones, and what stands for letters inside words.
_LOOKALIKES = "абвгдезіјкмнорсѕтухьԁԛԝһαβεζηικμνορτυχω"
_LATIN = "aбbгdeзijkmhopcstyxьdqwhabezhikmvoptuxw"
HOMOGLYPHS = {ord(a): b for a, b in zip(_LOOKALIKES, _LATIN) if b.isascii()} | {ord("в"): "b", ord("ı"): "i", ord("ø"): "o", ord("ł"): "l", ord("đ"): "d"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Words known beforehand; labelled rows correct their weights.
SEEDS = ("idiot", "idiots", "moron", "morons", "imbecile", "stupid", "dumb", "dumbass", "loser", "losers", "scum", "scumbag", "trash", "garbage", "pathetic", "disgusting", "worthless", "clown", "jerk", "bastard", "bitch", "asshole", "shit", "fuck", "fucking", "retard", "retarded", "whore", "slut", "vermin", "subhuman")
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "trash bags", "trash bin", "clown fish", "garbage collection", "garbage collector", "garbage truck", "dumb terminal", "dumb waiter")

_MARKS = re.compile("[̀-ͯ​-‏⁠﻿­]+")
_INSIDE = re.compile(r"(?<=[a-z])[0-9@$!]+(?=[a-z])|(?<![a-z0-9@$!])[0-9@$!]{1,2}(?=[a-z])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().translate(HOMOGLYPHS)
    return _INSIDE.sub(lambda m: "".join([SUBSTITUTES.get(c, c) for c in m[0]]), text)


class Matcher:
    """An automaton over folded terms and exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            self.automaton.add_word(fold(phrase), (len(fold(phrase)), None))
        self.automaton.make_automaton()

    def spans(self, folded: str) -> list[tuple[int, int, float]]:
        """Whole-word matches outside exception phrases: start, end, weight."""
        found, excused, n = [], [], len(folded)
        for last, (length, weight) in self.automaton.iter(folded):
            lo, hi = last + 1 - length, last + 1
            if (lo and folded[lo - 1].isalpha()) or (hi < n and folded[hi].isalpha()):
                continue
            (excused.append((lo, hi)) if weight is None else found.append((lo, hi, weight)))
        return [x for x in found if not any(a <= x[0] and x[1] <= b for a, b in excused)] if excused else found

    def features(self, text: str) -> tuple[float, float, float]:
        """Presence, log of the matched weight, and matched weight by the root of the word count."""
        folded = fold(text)
        weight = sum(w for _, _, w in self.spans(folded))
        if weight <= 0:
            return 0.0, 0.0, 0.0
        return 1.0, math.log1p(weight), weight / math.sqrt(1 + folded.count(" "))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights of [1, x] by Newton's method; the ridge spares the constant."""
    z = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-3] + [ridge] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _distinct_words(batches):
    """Distinct folded words of each text, and the least hash of its five-word shingles, by which near copies meet."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part, words, prints = batch.slice(lo, 500), [], []
            for text in part.column("text").to_pylist():
                found = _WORD.findall(fold(text))
                prints.append(min(xxhash.xxh64_intdigest(" ".join(found[i : i + 5])) for i in range(max(1, len(found) - 4))) >> 1)
                words.append(list(dict.fromkeys(w for w in found if 2 < len(w) <= 40)))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(prints, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["toxic", "print", "words"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], list[float]]:
    """Lexicon weights and logistic weights from labelled rows that aren't held out.

    At most ``train_rows`` rows are used, a fixed draw by hash of the id. Near copies count once in the lexicon. Rows
    with a null id or label are no labels; if an id has several, the largest holds.
    """
    spark = docs.sparkSession
    drawn = (
        labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna().filter(~held_out("id"))
        .groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    )
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    train = written(texts.join(F.broadcast(drawn), "id").select("text", "toxic"), "train")
    words = train.mapInArrow(_distinct_words, "toxic int, print bigint, words array<string>").groupBy("print").agg(F.max_by(F.struct("toxic", "words"), F.size("words")).alias("row")).select("row.*")
    words = words.select("toxic", F.explode_outer(F.array_append("words", F.lit(""))).alias("word"))  # "" counts the documents
    counted = words.groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    totals = counted.filter("word = ''").first()
    n1, n0 = (totals["a"], totals["b"]) if totals else (0.0, 0.0)
    least = max(5.0, 0.005 * n1)
    rows = counted.filter(F.col("word") != "").filter((F.col("a") >= least) & (F.col("a") >= 2 * F.col("b"))).orderBy(F.desc(F.col("a") - F.col("b")), "word").limit(LEXICON_WORDS).collect()
    known = {r["word"]: (r["a"], r["b"]) for r in rows}
    seeds = counted.filter(F.col("word").isin(*SEEDS)).collect()
    known |= {r["word"]: (r["a"] + 4, r["b"]) for r in seeds} | {w: (4.0, 0.0) for w in SEEDS if w not in {r["word"] for r in seeds}}
    odds = lambda a, b: math.log((a + 0.5) / (n1 + 4)) - math.log((b + 0.5) / (n0 + 4))
    weights = {w: round(odds(a, b), 6) for w, (a, b) in known.items()}
    weights = {w: v for w, v in weights.items() if v > 0.5} or {w: 1.0 for w in SEEDS}
    shared = Shared(spark, weights)

    def measure(batches):
        matcher = _matcher(shared)
        for batch in batches:
            x = [matcher.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array([r[k] for r in x], pa.float64()) for k in range(3))], names=["toxic", "x0", "x1", "x2"])

    table = train.mapInArrow(measure, "toxic int, x0 double, x1 double, x2 double").toPandas()  # train_rows at most
    # a weak prior, so that a table without labels still scores matches high
    x = np.vstack([table[["x0", "x1", "x2"]].to_numpy(float).reshape(-1, 3), [[0.0, 0.0, 0.0]] * 4, [[1.0, 1.5, 0.5]] * 4])
    y = np.concatenate([table["toxic"].to_numpy(float), [0.0] * 4, [1.0] * 4])
    return weights, fit_logistic(x, y).tolist()


_MATCHERS: dict[str, Matcher] = {}


def _matcher(shared: Shared) -> Matcher:
    if shared.id not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[shared.id] = Matcher(shared.value)
    return _MATCHERS[shared.id]


def score_of(spark: SparkSession, weights: dict[str, float], logistic: list[float], text_col: str = "text") -> Column:
    """The score of a text column, a vectorised function: only the texts go to Python. A null text counts as empty."""
    shared, w = Shared(spark, weights), np.asarray(logistic)

    def score(parts):
        matcher = _matcher(shared)
        for texts in parts:
            x = np.array([(1.0, *matcher.features(t)) for t in texts]).reshape(-1, 4)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(text_of(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score all documents with a model fitted on the labels that aren't held out.

    Returns per row: ``id_col``, held_out, score, predicted. Null texts count as empty and get the score of no match;
    a null id is not held out; repeated rows are scored alike; other columns are ignored. Without labels the seed
    words alone decide. An empty table gives no rows.
    """
    weights, logistic = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col), score_of(docs.sparkSession, weights, logistic, text_col).alias("score"))
    return rows.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
