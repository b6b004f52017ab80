"""Sharding against draws made one at a time, on small tables with awkward rows."""

import collections
import hashlib
import math
import zlib

import pytest

pytest.importorskip("cantus.llm")

from pyspark.sql import functions as F  # noqa: E402

from cantus.llm import sharding  # noqa: E402
from cantus.llm.sharding import Shard  # noqa: E402

SCHEMA = "doc_id bigint, text string, shard int, slot string, n bigint, h bigint"
LONG = "lorem ipsum dolor " * 4000


def plain_shard(key, tree):
    """Descend by the definition: weights of the shards below, least of -ln(u) / weight."""
    below, at = list(tree), ""
    for part in ("region", "rack", "number"):
        weights = collections.defaultdict(float)
        for s in below:
            weights[getattr(s, part)] += s.weight
        names = {v: f"{at}/{v}".lstrip("/") for v, w in weights.items() if w > 0}
        draw = {v: -math.log((int(hashlib.md5(f"{name}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weights[v] for v, name in names.items()}
        chosen = min(draw, key=draw.get)
        below, at = [s for s in below if getattr(s, part) == chosen], names[chosen]
    return below[0].number


UNEVEN = (Shard(0, "a", "x", 3.0), Shard(1, "a", "x"), Shard(2, "a", "y", 2.0), Shard(3, "b", "x"), Shard(4, "b", "x", 0.0), Shard(5, "c", "x", 0.5))


@pytest.mark.parametrize("tree", [sharding.balanced_tree(2, 2, 2), UNEVEN, (Shard(7, "only", "one"),)])
def test_rows_descend_by_their_draws(spark, tree):
    got = spark.range(300).select("id", sharding.shard_of(F.col("id").cast("string"), tree).alias("s")).collect()
    assert [r.s for r in got] == [plain_shard(str(r.id), tree) for r in got]


def test_shares_follow_the_weights(spark):
    got = spark.range(20000).groupBy(sharding.shard_of(F.col("id").cast("string"), UNEVEN).alias("s")).count().collect()
    whole = sum(s.weight for s in UNEVEN)
    share = {r.s: r["count"] / 20000 for r in got}
    assert set(share) == {0, 1, 2, 3, 5}
    assert all(abs(share[s.number] - s.weight / whole) < 0.015 for s in UNEVEN if s.weight)


def test_movement_stays_within_changed_subtrees(spark):
    changed = tuple(Shard(s.number, s.region, s.rack, 4.0) if s.number == 2 else s for s in UNEVEN)
    place = {s.number: s for s in UNEVEN}
    rows = spark.range(5000).select(*(sharding.shard_of(F.col("id").cast("string"), t).alias(n) for t, n in ((UNEVEN, "old"), (changed, "new")))).collect()
    moved = [(place[r.old], place[r.new]) for r in rows if r.old != r.new]
    assert moved
    for old, new in moved:  # weights grow on the path a, a/y, a/y/2 only
        assert new.region == "a"
        if old.region == "a":
            assert (old.rack, new.rack) == ("x", "y")


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = sharding.balanced_tree(2, 2, 2)
    for _ in range(3):
        more = sharding.grown(tree)
        rows = spark.range(3000).select(*(sharding.shard_of(F.col("id").cast("string"), t).alias(n) for t, n in ((tree, "old"), (more, "new")))).collect()
        moved = [r for r in rows if r.old != r.new]
        assert moved and all(r.new == len(tree) for r in moved)
        tree = more


ROWS = [(1, "same"), (2, "same"), (3, None), (4, ""), (5, "Same"), (5, "Same"), (5, "other"), (6, LONG), (7, LONG), (8, "É日本"), (None, "no id"), (None, None), *[(9, "hot")] * 10000]


@pytest.mark.parametrize("numbered", [1 << 18, 100])
def test_place(spark, monkeypatch, numbered):
    monkeypatch.setattr(sharding, "NUMBERED", numbered)
    tree = sharding.balanced_tree(2, 2, 2)
    docs = spark.createDataFrame([(i, t, 3, "x", 1, 2) for i, t in ROWS], SCHEMA)
    got = sharding.place(docs, tree).collect()
    key = lambda i: "" if i is None else str(i)
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_shard(key(i), tree), plain_shard(key(i), sharding.grown(tree))) for i, t in ROWS)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_place_of_an_empty_table(spark):
    assert sharding.place(spark.createDataFrame([], SCHEMA), sharding.balanced_tree(1, 1, 3)).collect() == []


def test_trees_are_checked():
    for tree in ((), (Shard(0, "a", "x", 0.0),), (Shard(0, "a", "x"), Shard(0, "b", "x")), (Shard(0, "a", "x", -1.0),)):
        with pytest.raises(ValueError):
            sharding._children(tree)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "x", 1, "x", 1, 1)], SCHEMA)
    plan = sharding.place(docs, sharding.balanced_tree(2, 2, 2))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
