"""Phrase collocations from depth-limited count tries.

A task builds, for each run of texts, a count trie of words up to five deep: level by level, where a node is its parent
and a word. It is serialised in byte order of its phrases, cut into ranges of prefixes whose bounds come from a sample
of all texts' phrases, and where a range is still large into parts by hash. The sorted pieces of a range and part are
merged k ways, which gives exact counts over all texts. Of a frequent phrase, parents up the trie are the left parts of
its cuts, and suffix links (the phrase without its first word, which is frequent too) lead to the right parts.

A phrase is as rare as its rarest pair of words. So a first pass counts words and pairs in a fixed number of hashed
cells, which never count too little; tries only grow along pairs whose cell is frequent. This drops no frequent phrase
and, whatever the input, takes a broadcast of 8 MB.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, text_of, written

#: Hashed cells, and the ranges of them that are summed up apart.
CELL_BITS, RANGE_BITS = 26, 8
#: Bytes of text that one trie covers; a longer piece is not cut.
TRIE_BYTES = 8 << 20
#: Ranges of prefixes at most, and phrases of the sample that each range of cells keeps for their bounds.
RANGES, SAMPLED = 64, 64
#: Bytes of text whose tries a merging task reads on average, and of serialised pieces that it holds before it merges them.
MERGED_TEXT, HELD_BYTES = 8 << 20, 16 << 20
#: Best phrases are chosen in parts of so many candidates.
RANKED = 1 << 18

_BLANK, _BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)] = 1
_KIND[list(_BREAK)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def runs_of_text(batches: Iterator[pa.RecordBatch], most: int = TRIE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(bytes, starts of texts, languages) of about ``most`` bytes each; a long text is cut where a piece ends."""
    held, langs, size = [], [], 0

    def out():
        lengths = [len(h) for h in held]
        return np.concatenate(held), np.cumsum([0, *lengths[:-1]]), list(langs)

    for batch in batches:
        column = batch.column("text")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        for lang, lo, hi in zip(batch.column("lang").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
            while lo < hi:
                cut = hi
                if hi - lo > most:
                    ends = np.flatnonzero(_KIND[data[lo + most : hi]] == 2)
                    cut = lo + most + int(ends[0]) + 1 if len(ends) else hi
                held.append(data[lo:cut])
                langs.append(lang)
                size += cut - lo
                lo = cut
                if size >= most:
                    yield out()
                    held, langs, size = [], [], 0
    if held:
        yield out()


class Words:
    """The words of a run of texts: numbered in byte order, with the language and the piece of each occurrence."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, langs: list) -> None:
        kind = _KIND[data]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[starts] |= inside[starts]
        before = starts[starts > 0] - 1
        last[before] |= inside[before]
        begins = np.flatnonzero(first)
        offsets = np.zeros(len(begins) + 1, np.int32)
        np.cumsum(np.flatnonzero(last) + 1 - begins, out=offsets[1:])
        compact = _LOWER[data[inside]]
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(compact)]).dictionary_encode()
        order = pc.sort_indices(words.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        self.names: pa.Array = words.dictionary.take(order)
        self.word = rank[words.indices.to_numpy()]
        piece = np.searchsorted(np.flatnonzero(kind == 2), begins)
        text = np.searchsorted(starts, begins, "right") - 1
        self.follows = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])  # the next word is in the same piece
        self.langs = sorted(set(langs))
        code = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.asarray([code[x] for x in langs], np.int64)[text]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the words and of the pairs, both by position; the last word begins no pair."""
        digest = xxhash.xxh3_64_intdigest
        names = np.asarray([digest(w) for w in self.names.to_pylist()], np.uint64)
        langs = np.asarray([digest(x) for x in self.langs], np.uint64)
        odd, other, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - CELL_BITS)
        single = (names[self.word] ^ langs[self.lang]) * odd
        pair = ((single[:-1] ^ (single[:-1] >> np.uint64(29))) * other + names[self.word[1:]]) * odd
        return (single >> shift).astype(np.int64), (pair >> shift).astype(np.int64)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed counts of a run of texts, in ranges of cells, each with a phrase for the sample; counts stop at what 16 bits hold."""
    ranges = 1 << RANGE_BITS
    for run in runs_of_text(batches):
        words = Words(*run)
        if not len(words.word):
            continue
        single, pair = words.hashes()
        cells, counts = np.unique(np.concatenate([single, pair[words.follows]]), return_counts=True)
        edges = np.searchsorted(cells, np.arange(ranges + 1) << (CELL_BITS - RANGE_BITS))
        cells, counts = cells.astype(np.uint32), np.minimum(counts, 65535).astype(np.uint16)
        at = np.linspace(0, max(0, len(words.word) - 2), ranges).astype(np.int64)
        first, second = (words.names.take(pa.array(words.word[np.minimum(at + i, len(words.word) - 1)])) for i in (0, 1))
        phrases = pc.binary_join_element_wise(first, second, b" ").to_pylist()
        rows = [(k, cells[lo:hi].tobytes(), counts[lo:hi].tobytes(), phrases[k]) for k, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "cells", "counts", "phrase"])


def _frequent_cells(least: int):
    def run(batches):
        width = 1 << (CELL_BITS - RANGE_BITS)
        sums: dict[int, np.ndarray] = {}
        sample: dict[int, list] = {}
        for batch in batches:
            for part, cells, counts, phrase in zip(*(batch.column(c).to_pylist() for c in ("part", "cells", "counts", "phrase"))):
                if part not in sums:
                    sums[part], sample[part] = np.zeros(width, np.int64), []
                sums[part][np.frombuffer(cells, np.uint32) & (width - 1)] += np.frombuffer(counts, np.uint16)  # a run has a cell once
                sample[part].append((xxhash.xxh3_64_intdigest(phrase, len(sample[part])), phrase))
                if len(sample[part]) > 4 * SAMPLED:
                    sample[part] = heapq.nsmallest(SAMPLED, sample[part])
        bits = [np.packbits(s >= least, bitorder="little").tobytes() for s in sums.values()]
        kept = [b"\n".join(p for _, p in heapq.nsmallest(SAMPLED, sample[part])) for part in sums]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary()), pa.array(kept, pa.binary())], names=["part", "bits", "sample"])

    return run


def frequent_cells(texts: DataFrame, least: int) -> tuple[bytes, list[bytes]]:
    """A bit per cell, whether it counted ``least`` or more, and a sorted sample of pairs of words. The size of both is fixed."""
    hashed = texts.mapInArrow(_cells, "part int, cells binary, counts binary, phrase binary").repartition(1 << RANGE_BITS, "part")
    bits, sample = bytearray(1 << (CELL_BITS - 3)), []
    for row in hashed.mapInArrow(_frequent_cells(min(least, 65535)), "part int, bits binary, sample binary").collect():  # one row per range
        at = row.part << (CELL_BITS - RANGE_BITS - 3)
        bits[at : at + len(row.bits)] = row.bits
        sample += bytes(row.sample).split(b"\n")
    return bytes(bits), sorted(sample)


def trie_levels(words: Words, bits: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """(level, language codes, phrases, counts) of the trie of a run, each level in the order of its phrases' words.

    Nodes whose words or pairs lie in rare cells are left out.
    """
    single, pair = words.hashes()
    held = lambda cells: (bits[cells >> 3] >> (cells & 7)) & 1 == 1
    size = len(words.names)
    at = np.flatnonzero(held(single))  # positions where a phrase of the level begins
    grows = np.append(held(pair) & words.follows, False)
    keys, node, counts = np.unique(words.lang[at] * size + words.word[at], return_inverse=True, return_counts=True)
    lang, phrases = keys // size, words.names.take(pa.array(keys % size))
    yield 1, lang, phrases, counts
    for level in range(2, depth + 1):
        on = grows[at + (level - 2)]
        at, node = at[on], node[on]
        if not len(at):
            return
        keys, node, counts = np.unique(node * size + words.word[at + (level - 1)], return_inverse=True, return_counts=True)
        parent = keys // size
        lang, phrases = lang[parent], pc.binary_join_element_wise(phrases.take(pa.array(parent)), words.names.take(pa.array(keys % size)), b" ")
        yield level, lang, phrases, counts


def serialised(words: Words, bits: np.ndarray, depth: int, bounds: list[bytes], parts: int) -> Iterator[tuple[int, int, str, bytes, bytes]]:
    """The trie of a run as (range, part, language, sorted phrases, counts); the empty phrase counts a language's words."""
    held: dict[int, list] = {}
    for _, lang, phrases, counts in trie_levels(words, bits, depth):
        edges = np.searchsorted(lang, np.arange(len(words.langs) + 1))
        for code, (lo, hi) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            if hi > lo:
                held.setdefault(code, []).append((phrases.slice(lo, hi - lo), counts[lo:hi]))
    for code, total in enumerate(np.bincount(words.lang, minlength=len(words.langs)).tolist()):
        levels = [(pa.array([b""], pa.binary()), np.asarray([total])), *held.get(code, [])]
        phrases, counts = pa.concat_arrays([p for p, _ in levels]), np.concatenate([c for _, c in levels]).astype(np.int64)
        order = pc.sort_indices(phrases)
        phrases, counts = phrases.take(order).to_pylist(), counts[order.to_numpy()]
        edges = [0, *(bisect.bisect_left(phrases, b) for b in bounds), len(phrases)]
        for number, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if parts == 1:
                cut = [(0, phrases[lo:hi], counts[lo:hi])] if hi > lo else []
            else:
                part = np.asarray([zlib.crc32(p) % parts for p in phrases[lo:hi]], np.int64)
                of = np.argsort(part, kind="stable")
                starts = np.flatnonzero(np.diff(part[of], prepend=-1))
                cut = [(int(part[i[0]]), [phrases[lo + j] for j in i], counts[lo + i]) for i in np.split(of, starts[1:])] if hi > lo else []
            for part_, names, n in cut:
                yield number, part_, words.langs[code], b"\n".join(names), n.tobytes()  # a word holds no line break


def _tries(shared, depth: int, parts: int):
    def run(batches):
        bits, bounds = shared.value
        for texts in runs_of_text(batches):
            words = Words(*texts)
            if len(words.word):
                columns = zip(*serialised(words, np.frombuffer(bits, np.uint8), depth, bounds, parts))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["range", "part", "lang", "phrases", "counts"])

    return run


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[bytes], list[int]]:
    """One sorted run of several, with the counts of equal phrases added up."""
    if len(runs) == 1:
        return runs[0]
    phrases, counts, last = [], [], None
    for phrase, n in heapq.merge(*(zip(*r) for r in runs)):
        if phrase == last:
            counts[-1] += n
        else:
            phrases.append(phrase)
            counts.append(n)
            last = phrase
    return phrases, counts


def _merging(least: int):
    """Rows (range, part, lang, phrases, counts) in order of their keys to exact counts of frequent phrases."""

    def groups(batches):
        current, runs, size = None, [], 0
        for batch in batches:
            for *key, phrases, counts in zip(*(batch.column(c).to_pylist() for c in ("range", "part", "lang", "phrases", "counts"))):
                if key != current:
                    if runs:
                        yield current[2], *merged(runs)
                    current, runs, size = key, [], 0
                runs.append((phrases.split(b"\n"), np.frombuffer(counts, np.int64).tolist()))
                size += len(phrases)
                if size > HELD_BYTES and len(runs) > 1:
                    runs = [merged(runs)]
                    size = 0
        if runs:
            yield current[2], *merged(runs)

    def run(batches):
        for lang, phrases, counts in groups(batches):
            kept = [(p, n) for p, n in zip(phrases, counts) if n >= least or not p]
            if kept:
                names, n = zip(*kept)
                levels = [p.count(b" ") + 1 if p else 0 for p in names]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(levels, pa.int32()), pa.array(names, pa.binary()), pa.array(n, pa.int64())], names=["lang", "words", "phrase", "f"])

    return run


def phrase_counts(docs: DataFrame, least: int = 100, depth: int = 5, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, words, phrase, f): exact counts of all phrases of up to ``depth`` words that occur ``least`` times or more; words 0 is a language's number of words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_of(text_col).cast("binary").alias("text"))
    bits, sample = frequent_cells(texts, least)
    tasks = partitions_for(spark, texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0, MERGED_TEXT)
    ranges = min(tasks, RANGES)
    bounds = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    shared = spark.sparkContext.broadcast((bits, bounds))  # 8 MB and 63 phrases
    pieces = texts.mapInArrow(_tries(shared, depth, -(-tasks // ranges)), "range int, part int, lang string, phrases binary, counts binary")
    dealt = pieces.repartition(tasks, "range", "part").sortWithinPartitions("range", "part", "lang")
    found = dealt.mapInArrow(_merging(least), "lang string, words int, phrase binary, f bigint")
    return written(found.withColumn("phrase", F.col("phrase").cast("string")), "phrases")


def linked(counts: DataFrame, depth: int) -> DataFrame:
    """Frequent phrases with the counts of their left parts (shortest first) and right parts (longest first), found level by level.

    A phrase's parent has the left parts but one, its suffix link the right parts but one. ``whole`` is false for a
    phrase that its parent's or suffix's extension occurs in as often as it does itself.
    """
    none = F.array().cast("array<bigint>")
    levels = [written(counts.filter("words = 1").select("lang", "phrase", "f", none.alias("lefts"), none.alias("rights")), "level")]
    covering = []
    for level in range(2, depth + 1):
        own = counts.filter(F.col("words") == level).select(
            "lang", "phrase", "f", F.substring_index("phrase", " ", level - 1).alias("parent"), F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("suffix")
        )
        up, link = (levels[-1].select(F.col("lang").alias(f"{n}_lang"), F.col("phrase").alias(f"{n}_phrase"), F.col("f").alias(f"{n}_f"), F.col(c).alias(f"{n}_{c}")) for n, c in (("up", "lefts"), ("link", "rights")))
        joined = own.join(up.hint("merge"), (own.lang == up.up_lang) & (own.parent == up.up_phrase)).join(link.hint("merge"), (own.lang == link.link_lang) & (own.suffix == link.link_phrase))
        lefts, rights = F.concat("up_lefts", F.array("up_f")), F.concat(F.array("link_f"), "link_rights")
        done = written(joined.select("lang", "phrase", "f", lefts.alias("lefts"), rights.alias("rights"), "parent", "suffix", "up_f", "link_f"), "level")
        covering.append(done.select("lang", F.explode(F.array_compact(F.array(F.when(F.col("f") == F.col("up_f"), F.col("parent")), F.when(F.col("f") == F.col("link_f"), F.col("suffix"))))).alias("phrase")))
        levels.append(done.select("lang", "phrase", "f", "lefts", "rights"))
    phrases, covers = levels[1], covering[0]
    for level, cover in zip(levels[2:], covering[1:]):
        phrases, covers = phrases.unionByName(level), covers.unionByName(cover)
    covers = covers.distinct().select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"))
    marked = phrases.join(covers.hint("merge"), (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    return marked.select("lang", "phrase", "f", "lefts", "rights", F.col("_lang").isNull().alias("whole"))


def collocations(docs: DataFrame, least: int = 100, depth: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score, cut (words of the left part).

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line, vertical tab, form feed and carriage
    returns, and pieces into words at blanks and tabs. A phrase has 2 to ``depth`` words of one piece and occurs
    ``least`` times or more (a). Its score is the lowest ``floor(1000 a n / (l r))`` of its cuts, the first of equal
    ones, for l and r occurrences of the parts and n words of the language. Phrases that occur in a longer one as often
    are left out. Ties in score go to the larger a, then to the lesser phrase in byte order. Null texts are empty, null
    languages are ``und``; other columns, ids included, are ignored, and repeated rows count each. A table without
    frequent phrases gives no rows.
    """
    if depth < 2:
        raise ValueError("phrases have two words at least")
    spark = docs.sparkSession
    counts = phrase_counts(docs, least, depth, lang_col, text_col)
    words = counts.filter("words = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))  # one row per language
    found = linked(counts, depth).filter("whole").join(words, F.col("lang") == F.col("_lang"))

    def wide(x):
        return x.cast("decimal(19,0)")

    def score(cut):
        # products of up to 38 digits, which integral division takes to 64 bits again
        return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (F.col("f").cast("decimal(15,0)") * F.col("n").cast("decimal(17,0)")), wide(cut["lefts"]) * wide(cut["rights"]))

    cuts = F.transform(F.arrays_zip("lefts", "rights"), lambda c, i: F.struct(score(c).alias("score"), (i + 1).alias("cut"), c["lefts"].alias("l"), c["rights"].alias("r")))
    scored = written(found.select("lang", "phrase", F.col("f").alias("a"), "n", F.array_min(cuts).alias("best")).select("lang", "phrase", "a", "n", "best.*"), "scored")
    # a language may have any share of the candidates: parts of it hold their best ones first
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(1, scored.count() // RANKED)
    part = Window.partitionBy("lang", "part").orderBy(*order)
    best = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("bigint").alias("cut"))
