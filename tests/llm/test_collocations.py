"""Collocations against counting every phrase."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("cantus.llm")

from cantus.llm import collocations as co  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, phrase string, f bigint, words int, rank string"


def plain(rows, least, depth, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, depth + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in counts.items():
        found = {p: f for p, f in c.items() if len(p) > 1 and f >= least}
        inside = {q[i : i + m] for q, f in found.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if f >= c[q[i : i + m]]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]], k))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -score, k) for i, (score, a, p, left, right, k) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "cat", "été", "日本", "a\x01b", "a", "a-b", "x y", "Straße", "z" * 300]
    rows = []
    for _ in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "\r\n", ".", " \x0b"]) for w in words)
        rows.append((text + "New York City never sleeps" * rng.randrange(3), rng.choice(["en", "fr", None])))
    return [*rows, (None, "en"), ("", None), (" . ,", "de"), ("one", "xx"), *[("out of the blue sky today; ok", "en")] * 300, ("ab cd " * 5000, "yy"), ("ab cd. " * 5000, "yy")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, "r") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("least, depth, top, run, share", [(5, 5, 2000, 16 << 20, 8 << 20), (3, 3, 7, 500, 1000), (100, 5, 2000, 2000, 100000), (1, 2, 50, 1 << 20, 3000)])
def test_collocations(spark, monkeypatch, least, depth, top, run, share):
    monkeypatch.setattr(co.runs_of_text, "__defaults__", (run,))
    monkeypatch.setattr(co, "MERGED_TEXT", share)  # from one part a range to dozens
    monkeypatch.setattr(co, "HELD_BYTES", share)
    monkeypatch.setattr(co, "RANGES", 5)
    rows = texts(least)
    got = co.collocations(frame(spark, rows), least, depth, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, depth, top)


def test_full_cells_drop_nothing(spark, monkeypatch):
    rows = texts(9)
    monkeypatch.setattr(co, "frequent_cells", lambda texts, least: (b"\xff" * (1 << (co.CELL_BITS - 3)), []))
    assert sorted(tuple(r) for r in co.collocations(frame(spark, rows), 4).collect()) == plain(rows, 4, 5, 2000)


def test_nothing_frequent(spark):
    for rows in ([], [(None, None)], [("a b c", "en")]):
        assert co.collocations(frame(spark, rows)).collect() == []


def test_products_beyond_64_bits(spark):
    counts = [("en", 0, "", 9 * 10**15), ("en", 1, "a", 3 * 10**12), ("en", 1, "b", 7 * 10**11), ("en", 2, "a b", 6 * 10**11)]
    monkey = pytest.MonkeyPatch()
    monkey.setattr(co, "phrase_counts", lambda *a: spark.createDataFrame(counts, "lang string, words int, phrase string, f bigint"))
    try:
        (row,) = co.collocations(spark.createDataFrame([], SCHEMA)).collect()
    finally:
        monkey.undo()
    assert row.score == 1000 * 6 * 10**11 * 9 * 10**15 // (3 * 10**12 * 7 * 10**11)


def test_long_texts_are_cut_between_pieces():
    text = ("some words here, " * 100).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([text, b"", b"x" * 1000]), pa.array(["a", "b", "c"])], names=["text", "lang"])
    runs = list(co.runs_of_text(iter([batch.slice(0, 2), batch.slice(2)]), 200))
    assert b"".join(d.tobytes() for d, _, _ in runs) == text + b"x" * 1000
    assert all(d.tobytes().endswith(b",") for d, _, langs in runs if langs == ["a"] and len(d) >= 200)
    assert max(len(d) for d, _, _ in runs[:-1]) < 420


def test_levels_are_sorted():
    words = co.Words(np.frombuffer(b"b a b a c, a b A b", np.uint8), np.array([0]), ["en"])
    bits = np.full(1 << (co.CELL_BITS - 3), 255, np.uint8)
    for level, _, phrases, counts in co.trie_levels(words, bits, 3):
        keys = [p.split(b" ") for p in phrases.to_pylist()]
        assert keys == sorted(keys) and all(len(k) == level for k in keys) and counts.sum() == {1: 9, 2: 7, 3: 5}[level]
