"""Near-duplicate classes by ProbMinHash, banding and verification.

Texts are sets of five-word shingles weighted by the damped number of their occurrences. Each shingle is a Poisson
process over the registers, whose rate is its weight; a register keeps the shingle that arrives first, and a shingle's
arrivals end as soon as they come later than every register's. Two signatures agree in a register with the probability
Jaccard of the weighted sets. A second signature, of the sets without weights, agrees with their plain Jaccard; it is
the same one for a text that repeats no shingle, and is then left out. Documents that agree in a band of registers of
either signature share a bucket, and what shares a bucket is compared exactly, shingle by shingle, unless links found
before connect it already. Classes are the connected components of the links.

Documents with the same words are one representative from the start, and buckets with the same members are one bucket.
Every representative is first compared inside its largest bucket. Of the buckets that hold several components after
that, the members outside the bucket's largest component meet all members, once, in cells of bounded size. A task holds
one cell and gives links between components, at most one less than there are, so no list of pairs is ever made.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .components import components

#: Words of a shingle, and the similarity of a link.
SHINGLE, SIMILAR = 5, 0.8
#: Registers of a signature and of a band: a link at 0.8 is missed by all bands in 3 of a million cases.
REGISTERS, BAND = 96, 4
#: Representatives and shingles on a side of a cell, about: a bucket is dealt out by hash to keep to both.
CELL_ROWS, CELL_SHINGLES = 2048, 1 << 20

_WORD = re.compile(r"\w+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = value
        return value


_HASHES = WordHashes()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of the runs of five words; a shorter text has one shingle of all its words, an empty one none."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for i in range(size):
        h = _mix(h + w[i : i + len(h)] + _U((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return h


def weighted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    elements, counts = np.unique(h, return_counts=True)
    return elements, 1 + np.log(counts)


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (owners x registers) of weighted sets given as rows (element, weight, owner)."""
    first = np.full(owners * registers, np.inf)
    signature = np.zeros(owners * registers, np.uint64)
    at, worst, i = np.zeros(len(elements)), np.full(owners, np.inf), 0
    while len(elements):
        i += 1
        draw = _mix(elements + _U((i * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        at = at - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) / 2.0**53) / weights
        alive = at < worst[owner]  # arrivals only come later: the rest of the process is void
        elements, weights, owner, at, draw = elements[alive], weights[alive], owner[alive], at[alive], draw[alive]
        register = owner * registers + (_mix(draw ^ _U(0xD6E8FEB86659FD93)) % _U(registers)).astype(np.int64)
        np.minimum.at(first, register, at)
        won = first[register] == at
        signature[register[won]] = elements[won]
        some = np.unique(owner)
        worst[some] = first.reshape(owners, registers)[some].max(1)
    return signature.reshape(owners, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted elements, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i], b[1][j]
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    # elements of a only come first in the order of y / x, those of b only last
    below = a[1].sum() - x.sum() + np.cumsum(x)
    above = b[1].sum() - np.cumsum(y)
    return float((1 / (below / x + above / y)).sum())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The larger of probability Jaccard (damped weights) and plain Jaccard of two arrays of shingle hashes."""
    x, y = weighted(a), weighted(b)
    both = len(np.intersect1d(x[0], y[0], assume_unique=True))
    union = len(x[0]) + len(y[0]) - both
    return max(both / union if union else 0.0, probability_jaccard(x, y))


def _sign(batches):
    """Per row: digest of its words, signatures (null without words), number of different shingles, the packed text."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    names = ["doc_id", "salt", "print", "sig", "shingles", "packed"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            given = part.column("text").to_pylist()
            lists = [words_of(t) for t in given]
            prints = [hashlib.md5(" ".join(w).encode()).digest() for w in lists]
            parts = [shingles(w) for w in lists]
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))) if len(h) else np.zeros(0, np.int64)
            weights = 1 + np.log(np.diff(np.concatenate((head, [len(h)]))))
            signatures = _mix(prob_min_hash(h[head], weights, owner[head], len(parts))).astype("<u4")
            signed = [s.tobytes() if w else None for s, w in zip(signatures, lists)]
            # the signature without weights, of texts that repeat a shingle
            repeats = np.unique(owner[head][weights > 1])
            of = np.flatnonzero(np.isin(owner[head], repeats))
            plain = _mix(prob_min_hash(h[head][of], np.ones(len(of)), np.searchsorted(repeats, owner[head][of]), len(repeats))).astype("<u4")
            for i, s in zip(repeats.tolist(), plain):
                signed[i] += s.tobytes()
            sizes = np.bincount(owner[head], minlength=len(parts))
            packed = pa.array([pack(t.encode("utf-8", "replace")) for t in given], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("salt"), pa.array(prints, pa.binary()), pa.array(signed, pa.binary()), pa.array(sizes, pa.int64()), packed], names=names)
    _HASHES.clear()


def _sets(batches):
    """Shingle hashes of each text, sorted, and their numbers where one occurs more than once."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            elements, numbers = [], []
            for packed in part.column("packed").to_pylist():
                e, n = np.unique(shingles(words_of(unpack(packed).decode())), return_counts=True)
                elements.append(e.astype("<u8").tobytes())
                numbers.append(n.astype("<u4").tobytes() if n.max(initial=0) > 1 else None)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(elements, pa.binary()), pa.array(numbers, pa.binary())], names=["id", "elements", "numbers"])
    _HASHES.clear()


#: Sides of a cell that a row stands on.
_LEFT, _RIGHT = 1, 2


def _joined(heads: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of several stretches (first place, length) one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(heads - (ends - lengths), lengths)


def links_of_cell(comps: list[int], sides: list[int], sets: list[tuple[np.ndarray, np.ndarray | None]]) -> list[tuple[int, int]]:
    """Links between components: every right row meets the left rows that may be similar and that nothing connects it with yet.

    A set is its sorted shingle hashes and their numbers (None: all 1). The links form no cycle. Shingles are ordered by
    their number of sets in the cell. The first one that two similar sets share lies so near the beginning of both that
    what follows it could hold 0.8 of either (of its shingles, or of its mass where some occur more than once); so only
    sets that share a shingle of these beginnings are compared, and without repetitions only those of sizes within 0.8
    that have enough shingles from the first shared one on. No test leaves out a link.
    """
    names, comp = np.unique(np.asarray(comps, np.int64), return_inverse=True)
    roots, side = np.arange(len(names)), np.asarray(sides)
    left, right = np.flatnonzero(side & _LEFT), np.flatnonzero(side & _RIGHT)
    if len(names) < 2 or not len(left) or not len(right):
        return []
    right = right[np.argsort(comp[right], kind="stable")]
    sizes = np.asarray([len(s[0]) for s in sets])
    heads, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sets)), sizes)
    _, codes, frequency = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True, return_counts=True)
    rank = np.empty(len(frequency), np.int64)
    rank[np.argsort(frequency, kind="stable")] = np.arange(len(frequency))
    repeats = np.asarray([s[1] is not None for s in sets])
    order = np.argsort(owner * len(rank) + rank[codes], kind="stable")
    codes = rank[codes][order]  # of each set, the rarest first
    begins = sizes - np.ceil(SIMILAR * sizes - 1e-9).astype(np.int64) + 1
    place = np.arange(len(codes)) - heads[owner]
    shares = None
    if repeats.any():
        weights = np.concatenate([np.ones(len(s[0])) if s[1] is None else 1 + np.log(s[1]) for s in sets])[order]
        shares = weights / np.add.reduceat(weights, heads)[owner]
        passed = np.cumsum(shares)
        left_over = 1 - (passed - shares - (passed - shares)[heads][owner])  # of the mass, this shingle's included
        begins = np.maximum(begins, np.add.reduceat((left_over >= SIMILAR - 1e-6).astype(np.int64), heads))
    early = np.flatnonzero((place < begins[owner]) & ((side & _LEFT) > 0)[owner])
    early = early[np.argsort(codes[early], kind="stable")]
    sharing, there, starts = owner[early], place[early], np.searchsorted(codes[early], np.arange(len(rank) + 1))
    mine, mass = np.zeros(len(rank), np.int32), np.zeros(len(rank) if shares is not None else 0)
    out, found, at_own, at_other = [], np.zeros(len(sets), bool), np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    for f in right.tolist():
        own = codes[heads[f] : heads[f] + sizes[f]]
        first = own[: begins[f]]
        lengths = starts[first + 1] - starts[first]
        met = _joined(starts[first], lengths)[::-1]  # the first shared shingle is noted last
        others = sharing[met]
        found[others], at_own[others], at_other[others] = True, np.repeat(np.arange(len(first)), lengths)[::-1], there[met]
        near = np.flatnonzero(found)
        found[near] = False
        near = near[roots[comp[near]] != roots[comp[f]]]
        sized = np.minimum(sizes[near], sizes[f]) >= SIMILAR * np.maximum(sizes[near], sizes[f]) - 1e-9
        sized &= np.minimum(sizes[f] - at_own[near], sizes[near] - at_other[near]) >= SIMILAR / (1 + SIMILAR) * (sizes[f] + sizes[near]) - 1e-9
        near = near[sized | repeats[near] | repeats[f]]
        if not len(near):
            continue
        at = _joined(heads[near], sizes[near])
        ends = np.cumsum(sizes[near]) - sizes[near]
        mine[own] = 1
        both = np.add.reduceat(mine[codes[at]], ends)
        mine[own] = 0
        linked = both / (sizes[f] + sizes[near] - both) >= SIMILAR
        if shares is not None and (repeats[f] or repeats[near].any()):
            # probability Jaccard is at most the common mass of the two distributions
            mass[own] = shares[heads[f] : heads[f] + sizes[f]]
            common = np.add.reduceat(np.minimum(mass[codes[at]], shares[at]), ends)
            mass[own] = 0
            for k in np.flatnonzero((common >= SIMILAR - 1e-9) & ~linked & (repeats[near] | repeats[f])).tolist():
                linked[k] = probability_jaccard(_weighted_set(sets[f]), _weighted_set(sets[near[k]])) >= SIMILAR
        for other in np.unique(comp[near[linked]]).tolist():
            a, b = roots[comp[f]], roots[other]
            if a != b:
                out.append((int(names[comp[f]]), int(names[other])))
                roots[roots == b] = a
    return out


def _weighted_set(of: tuple[np.ndarray, np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    return of[0], np.ones(len(of[0])) if of[1] is None else 1 + np.log(of[1])


def _cells(batches):
    """Links of cell after cell; the rows of a cell follow each other."""
    current, rows = None, []
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            for key, i, j, comp, side, elements, numbers in zip(*(part.column(c).to_pylist() for c in ("key", "i", "j", "comp", "side", "elements", "numbers"))):
                if (key, i, j) != current:
                    yield from _cell(rows)
                    current, rows = (key, i, j), []
                rows.append((comp, side, (np.frombuffer(elements, "<u8"), None if numbers is None else np.frombuffer(numbers, "<u4"))))
    yield from _cell(rows)


def _cell(rows: list):
    links = links_of_cell(*map(list, zip(*rows))) if len(rows) > 1 else []
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])


def _cuts(rows: str, shingles_: str):
    """Number of parts that keeps both measures within a cell's bounds."""
    return F.greatest(F.ceil(F.col(rows) / CELL_ROWS), F.ceil(F.col(shingles_) / CELL_SHINGLES), F.lit(1)).cast("int")


def _compare(rows: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """Links (a, b) between the components of each cell (key, i, j)."""
    full = rows.join(sets.hint("merge"), "id").select("key", "i", "j", "comp", "side", "elements", "numbers")
    return written(full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_cells, "a bigint, b bigint"), label)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near duplicates: ``id_col``, class_id, class_size, kept, one row per input row.

    The row with the least id of a class stays; class_id is that id. Texts without words are classes of their own
    and all stay, as do rows without an id (class_id is null). Rows that agree in the id are judged by their texts: of
    those in one class, one stays at most, and unrelated ones are in classes of their own, each with a row that stays.
    Null texts count as empty; other columns are ignored; an empty table gives no rows.
    """
    return near_rows(docs, id_col, text_col).drop("salt")


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` with a salt (hash of the text), which tells rows apart that agree in the id."""
    content = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(content.cast("binary")).alias("salt"), content.alias("text"))
    signed = rows.mapInArrow(_sign, "doc_id bigint, salt bigint, print binary, sig binary, shingles bigint, packed binary")
    signed = written(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    some = signed.filter("sig IS NOT NULL AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "salt", "row")).alias("first")
    reps = some.groupBy("print").agg(first, F.min("sig").alias("sig"), F.min("shingles").alias("shingles"), F.count("*").alias("rows"))
    reps = written(reps.withColumn("id", F.col("first.row")), "representatives")

    in_band = lambda i: i % (REGISTERS // BAND)
    bands = F.transform(
        F.sequence(F.lit(0), (F.octet_length("sig") / (4 * BAND)).cast("int") - 1),
        lambda i: F.struct(F.xxhash64(in_band(i), F.expr("sig").substr(i * (4 * BAND) + 1, F.lit(4 * BAND))).alias("key")),
    )
    keyed = reps.select("id", "shingles", F.inline(F.array_distinct(bands)))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("who")).filter("n > 1")
    buckets = buckets.groupBy("n", "who").agg(F.min("key").alias("key"))
    members = written(keyed.join(buckets.select("key", "n").hint("merge"), "key"), "members")
    wanted = members.select("id").distinct()
    sets = signed.select(F.col("row").alias("id"), "packed").hint("merge").join(wanted, "id").mapInArrow(_sets, "id bigint, elements binary, numbers binary")
    sets = written(sets, "sets")

    # each one inside its largest bucket; one row of the bucket is in all of its parts
    chosen = members.groupBy("id").agg(F.max(F.struct("n", "key")).alias("to"), F.min("shingles").alias("shingles")).select("id", "shingles", "to.key")
    parts = chosen.groupBy("key").agg(F.count("*").alias("m"), F.sum("shingles").alias("s"), F.min("id").alias("pivot")).filter("m > 1").withColumn("parts", _cuts("m", "s"))
    dealt = chosen.join(parts.hint("merge"), "key")
    part = F.when(F.col("id") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "key"), "parts").cast("int")))
    dealt = dealt.select("key", "id", F.explode(part).alias("i"), F.lit(0).alias("j"), F.col("id").alias("comp"), F.lit(_LEFT | _RIGHT).alias("side"))
    labels = components(_compare(dealt, sets, "links"))

    # what different components of a bucket have left to compare
    placed = members.join(labels, "id", "left").select("key", "id", "shingles", F.coalesce("comp", "id").alias("comp"))
    by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("shingles").alias("s"))
    largest = by_comp.groupBy("key").agg(F.count("*").alias("comps"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.max(F.struct("m", "s", "comp")).alias("top")).filter("comps > 1")
    largest = largest.withColumn("rest_m", F.col("m") - F.col("top.m")).withColumn("rest_s", F.col("s") - F.col("top.s"))
    largest = largest.select("key", F.col("top.comp").alias("top"), _cuts("m", "s").alias("lefts"), _cuts("rest_m", "rest_s").alias("rights"))
    mixed = placed.join(largest.hint("merge"), "key")
    at = F.pmod(F.xxhash64("id", "key"), "lefts").cast("int")
    right_at = F.pmod(F.xxhash64("key", "id"), "rights").cast("int")
    outside = F.col("comp") != F.col("top")
    lefts = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: F.struct(at.alias("i"), j.alias("j"), F.when(outside & (j == right_at), _LEFT | _RIGHT).otherwise(_LEFT).alias("side")))
    rights = F.transform(F.filter(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: outside & (i != at)), lambda i: F.struct(i.alias("i"), right_at.alias("j"), F.lit(_RIGHT).alias("side")))
    dealt = mixed.select("key", "id", "comp", F.inline(F.concat(lefts, rights)))
    joined = components(_compare(dealt, sets, "links"))

    placed = reps.join(labels, "id", "left").select("print", "first", "rows", F.coalesce("comp", "id").alias("part"))
    placed = placed.join(joined.select(F.col("id").alias("part"), F.col("comp").alias("whole")), "part", "left").select("print", "first", "rows", F.coalesce("whole", "part").alias("comp"))
    heads = placed.groupBy("comp").agg(F.min("first").alias("head"), F.sum("rows").alias("class_size"))
    classes = placed.select("print", "comp").hint("merge").join(heads, "comp").select("print", "head", "class_size")
    alone = F.col("sig").isNull() | F.col("doc_id").isNull()
    rows = signed.select("doc_id", "salt", "row", "print", alone.alias("alone"))
    kept = rows.filter("NOT alone").hint("merge").join(written(classes, "classes"), "print")
    kept = kept.select("doc_id", "salt", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("kept"))
    singles = rows.filter("alone").select("doc_id", "salt", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("kept"))
    return kept.unionByName(singles).withColumnRenamed("doc_id", id_col)


def expected_miss(similarity: float = SIMILAR) -> float:
    """Share of pairs of that similarity that no band brings together, at most."""
    return math.pow(1 - similarity**BAND, REGISTERS // BAND)
