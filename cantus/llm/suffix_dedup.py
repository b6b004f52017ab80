"""Removal of repeated byte strings with suffix buckets and difference-cover samples.

A string of 200 bytes that occurs twice has the same least 64-byte hash in both places. Suffixes are therefore
bucketed by that anchor: a slice is a run of consecutive suffix starts that share one. Slices that are alike as a
whole are settled by counting, and a slice whose anchor occurs once is alone. The suffixes of the remaining slices are
sorted bucket by bucket, to a depth of 200 bytes: first by a short prefix, then long ties by the ranks of sampled
suffixes. The sample's positions are a difference cover: for any two suffixes some short shift leads both to sampled
ones, whose ranks and common prefixes are computed beforehand. A task holds the suffixes of half a megabyte at a time.

An anchor that very many slices share is split by the context at the side where a window reaches farther from it; such
anchors are found by a count over all documents, and the threshold bounds how many there can be. Keys that very many
slices share even so, found by a second count, and buckets that are larger than what a task sorts at a time go to no
single task: their strings of 200 bytes are dealt out by 128-bit hashes of their own and counted by Spark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, partitions_for, text_of, written

#: Length of the repeated strings, of anchors, and anchors of a window.
LENGTH, ANCHOR = 200, 64
WINDOW = LENGTH - ANCHOR + 1
SIDE = (LENGTH - ANCHOR) // 2
#: Bytes that a task hashes at a time (below 2**24), and that it sorts at a time.
BLOCK, SORTED = 1 << 20, 1 << 19
#: Occurrences from which an anchor is split, and the most anchors that can be (the threshold rises with the corpus).
HEAVY, HEAVY_KEYS = 4096, 1 << 18
#: Modulus of the difference cover.
PERIOD = 32

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_GOLDEN = _U(0x9E3779B97F4A7C15)
_BYTE = _mix((np.arange(1, 257, dtype=np.uint64)) * _GOLDEN)
_STEPS = {1 << k: _mix(np.asarray([1000 + k], np.uint64))[0] | _U(1) for k in range(6)}


def hashes(text: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` (a power of two) bytes from each position."""
    h, step = _BYTE[text], 1
    while step < length:
        h = h[:-step] * _STEPS[step] + h[step:]
        h ^= h >> _U(29)
        step *= 2
    return h


def difference_cover(v: int) -> list[int]:
    """A set of residues whose differences include every residue mod v, chosen greedily."""
    cover, missing = [0], set(range(1, v))
    while missing:
        best = max(range(v), key=lambda c: (len({(c - d) % v for d in cover} & missing | {(d - c) % v for d in cover} & missing), -c))
        missing -= {(best - d) % v for d in cover} | {(d - best) % v for d in cover}
        cover.append(best)
    return sorted(cover)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


_KINDS = (np.int64, np.int64, np.uint64, np.uint64, bool, bool)


def slices_of(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, ...]:
    """Slices of concatenated pieces [begins, ends): first start, number of starts, anchor key, digest, whether the
    anchor stands at several places in it, so that the slice may repeat a string by itself, and whether the anchor is
    a heavy one, so that the key is of its context too."""
    windows = len(text) - LENGTH + 1
    if windows <= 0:
        return tuple(np.zeros(0, t) for t in _KINDS)
    h = hashes(text, ANCHOR)
    least = window_minima(((h >> _U(24)) << _U(24)) | np.arange(len(h), dtype=np.uint64), WINDOW)
    anchor = (least & _U(0xFFFFFF)).astype(np.int64)
    key, split = h[anchor], np.zeros(windows, bool)
    if len(heavy):
        at = np.flatnonzero(np.isin(key, heavy))
        split[at] = True
        if len(at):
            a = anchor[at]
            left = a - at >= SIDE
            # 68 bytes of context: before the anchor or after it, inside the window either way
            near = np.where(left, a - SIDE, a + ANCHOR)
            key[at] = _mix(key[at] + _GOLDEN * (left + 1).astype(np.uint64) + _mix(h[near] + h[near + SIDE - ANCHOR] * _U(0xD6E8FEB86659FD93)))
    valid = np.zeros(windows + 1, np.int32)
    long = ends - begins >= LENGTH
    np.add.at(valid, begins[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    cut = np.ones(windows, bool)
    cut[1:] = (key[1:] != key[:-1]) | (valid[1:] != valid[:-1])
    cut[begins[long & (begins < windows)]] = True
    first = np.flatnonzero(cut)
    n = np.diff(np.concatenate((first, [windows])))
    whole = _mix(h[:windows] * _U(3) + h[ANCHOR : ANCHOR + windows] * _U(0x9FB21C651E98DF25) + _mix(h[2 * ANCHOR : 2 * ANCHOR + windows] + _GOLDEN * h[LENGTH - ANCHOR : LENGTH - ANCHOR + windows]))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(whole, dtype=np.uint64)))
    digest = _mix(total[first + n] - total[first] + _GOLDEN * n.astype(np.uint64))
    keep = valid[first]
    several = anchor[first] != anchor[first + n - 1]
    return first[keep], n[keep], key[first][keep], digest[keep], several[keep], split[first][keep]


def _blocks(texts: list[bytes]):
    """Concatenations of at most BLOCK bytes: text, piece begins and ends there, piece's document and offset in it."""
    held, size = [], 0
    for doc, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        step = BLOCK - LENGTH + 1
        for offset in range(0, len(text) - LENGTH + 1, step):
            piece = text[offset : offset + BLOCK]
            if size + len(piece) > BLOCK and held:
                yield _joined(held)
                held, size = [], 0
            held.append((doc, offset, piece))
            size += len(piece)
    if held:
        yield _joined(held)


def _joined(held):
    lengths = np.asarray([len(p) for _, _, p in held])
    ends = np.cumsum(lengths)
    return np.frombuffer(b"".join([p for _, _, p in held]), np.uint8), ends - lengths, ends, np.asarray([d for d, _, _ in held]), np.asarray([o for _, o, _ in held])


def _batch_slices(texts: list[bytes], heavy: np.ndarray) -> list[np.ndarray]:
    """document, start, n, key, digest, several, split of all slices of some texts."""
    out = []
    for text, begins, ends, doc, offset in _blocks(texts):
        first, *rest = slices_of(text, begins, ends, heavy)
        piece = np.searchsorted(begins, first, "right") - 1
        out.append((doc[piece], first - begins[piece] + offset[piece], *rest))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in (np.int64, *_KINDS)]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Of sorted rows, where each run of equal ones starts."""
    differs = np.ones(len(columns[0]), bool)
    if len(differs):
        differs[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(differs)


def repeated_windows(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the suffix starts begin a 200-byte string that begins at another start too; ``text`` has no end mark.

    Suffixes are compared by 32 bytes first. Two that agree there are compared by sampled suffixes: those at the shift
    that leads both to the cover share a class of 200 bytes less the shift exactly if the suffixes share 200 bytes.
    """
    n = len(text)
    padded = np.zeros(n + 2 * 256 + 8, np.uint8)
    padded[:n] = text
    word = np.lib.stride_tricks.as_strided(padded, (n + 2 * 256, 8), (1, 1))

    def words(at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(word[at]).view(">u8").ravel().astype(np.uint64)

    # ties by the first 32 bytes
    prefix = hashes(padded, PERIOD)[starts]
    order = np.argsort(prefix, kind="stable")
    head = _runs(prefix[order])
    same = np.setdiff1d(np.arange(len(order)), head, assume_unique=True)
    if any((words(starts[order[same]] + k) != words(starts[order[same - 1]] + k)).any() for k in range(0, PERIOD, 8)):
        order = np.lexsort([words(starts + k) for k in range(PERIOD - 8, -1, -8)])  # two prefixes share a hash
        head = _runs(*(words(starts[order] + k) for k in range(0, PERIOD, 8)))
    size = np.diff(np.concatenate((head, [len(order)])))
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(head)), size)
    tied = np.flatnonzero(size[group] > 1)
    marked = np.zeros(len(starts), bool)
    if not len(tied):
        return marked

    # ranks of the sampled suffixes to a depth of 256 bytes, by doubling
    in_cover = np.zeros(PERIOD, bool)
    in_cover[difference_cover(PERIOD)] = True
    limit = n + 256
    sample = np.flatnonzero(np.resize(in_cover, limit))
    place = np.full(limit + 256, len(sample), np.int64)
    place[sample] = np.arange(len(sample))
    order = np.lexsort([words(sample + k) for k in range(PERIOD - 8, -1, -8)])
    head = _runs(*(words(sample[order] + k) for k in range(0, PERIOD, 8)))
    rank = np.zeros(len(sample) + 1, np.int64)
    depth = PERIOD
    while True:
        rank[order] = np.repeat(np.arange(1, len(head) + 1), np.diff(np.concatenate((head, [len(order)]))))
        if depth >= LENGTH or len(head) == len(order):
            break
        pair = rank[:-1] * (len(sample) + 1) + rank[place[sample + depth]]
        order = np.argsort(pair, kind="stable")
        head = _runs(pair[order])
        depth *= 2

    # common prefixes of neighbours in that order
    common = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    for k in range(0, LENGTH, 8):
        a, b = words(sample[order[active]] + k), words(sample[order[active - 1]] + k)
        equal = a == b
        different = active[~equal]
        if len(different):
            # equal leading bytes of two big-endian words
            bits = 64 - np.frexp((a[~equal] ^ b[~equal]).astype(np.float64))[1]
            x = a[~equal] ^ b[~equal]
            lead = np.clip(bits, 0, 63) // 8
            lead = np.where((x >> (_U(56) - _U(8) * lead.astype(np.uint64))) == 0, lead + 1, lead)
            common[different] = k + lead
        active = active[equal]
        if not len(active):
            break
    common[active] = LENGTH

    at = starts[tied]
    for shift in range(PERIOD):
        of = np.flatnonzero(in_cover[(at + shift) % PERIOD])
        if not len(of):
            continue
        classes = np.empty(len(sample), np.int64)
        classes[order] = np.cumsum(common < LENGTH - shift)
        key = group[tied[of]] * (len(sample) + 1) + classes[place[at[of] + shift]]
        by = np.argsort(key, kind="stable")
        head = _runs(key[by])
        size = np.diff(np.concatenate((head, [len(by)])))
        marked[tied[of[by[np.repeat(size > 1, size)]]]] = True
    return marked


_SLICE = "doc_id bigint, salt bigint, start int, n int, key bigint, digest bigint, several boolean, twice boolean, hot boolean, deal bigint"


def _cut(heavy_anchors: Shared, hot_keys: Shared):
    """Slices of each document. Of slices of a batch that are alike, one goes to its bucket; the others are settled.
    Slices of hot keys are dealt out at random, as no task needs to see them together."""

    def run(batches):
        heavy, hot_ones = heavy_anchors.value, hot_keys.value
        for batch in batches:
            texts = batch.column("content").to_pylist()
            doc, start, n, key, digest, several, split = _batch_slices(texts, heavy)
            order = np.lexsort((digest, key))
            head = _runs(key[order], digest[order])
            size = np.diff(np.concatenate((head, [len(order)])))
            twice = np.zeros(len(order), bool)
            twice[order] = np.repeat(size > 1, size)
            rest = np.ones(len(order), bool)
            rest[order[head]] = False
            hot = split & np.isin(key, hot_ones) & ~rest
            deal = np.where(rest | hot, _mix(digest + start.astype(np.uint64) * _GOLDEN + doc.astype(np.uint64)), key).view(np.int64)
            ids, salts = batch.column("doc_id"), batch.column("salt").to_numpy()
            for lo in range(0, len(doc), 100_000):
                at = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc[at])), pa.array(salts[doc[at]]), pa.array(start[at].astype(np.int32)), pa.array(n[at].astype(np.int32)), pa.array(key[at].view(np.int64)), pa.array(digest[at].view(np.int64)), pa.array(several[at]), pa.array(twice[at]), pa.array(hot[at]), pa.array(deal[at])],
                    names=["doc_id", "salt", "start", "n", "key", "digest", "several", "twice", "hot", "deal"],
                )

    return run


def _count_keys(heavy_anchors: Shared | None):
    """Keys with their number of different slices in a batch: all of them, or those that heavy anchors split into."""

    def run(batches):
        for batch in batches:
            _, _, _, key, digest, _, split = _batch_slices(batch.column("content").to_pylist(), heavy_anchors.value if heavy_anchors else np.zeros(0, np.uint64))
            if heavy_anchors:
                key, digest = key[split], digest[split]
            order = np.lexsort((digest, key))
            key = key[order][_runs(key[order], digest[order])]
            head = _runs(key)
            size = np.diff(np.concatenate((head, [len(key)])))
            for lo in range(0, len(head), 100_000):
                at = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[head[at]].view(np.int64)), pa.array(size[at].astype(np.int64))], names=["key", "n"])

    return run


def _frequent(rows: DataFrame, least: int, heavy_anchors: Shared | None = None) -> Shared:
    """Keys of ``least`` slices or more, a broadcast: ``least`` is chosen so that there are a few HEAVY_KEYS at most."""
    counts = rows.select("content").mapInArrow(_count_keys(heavy_anchors), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    found = [r["key"] for r in counts.filter(F.col("n") >= least).select("key").collect()]
    return Shared(rows.sparkSession, np.sort(np.asarray(found, np.int64).view(np.uint64)))


#: Slices that repeat as a whole; slices to sort, and repeated ones that others may share a string with; the same of
#: hot keys, whose strings are counted.
_DUPLICATE, _OPEN, _WITNESS, _HOT_OPEN, _HOT_WITNESS = range(1, 6)


def _classify(batches):
    """Of the slices of a partition: those that repeat as a whole, and those whose suffixes must be sorted or counted."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    key, digest, deal, twice, several, hot = (table.column(c).to_numpy() for c in ("key", "digest", "deal", "twice", "several", "hot"))
    settled = np.flatnonzero((key != deal) & ~hot)
    loose = np.flatnonzero(hot)
    mine = np.flatnonzero((key == deal) & ~hot)
    order = mine[np.lexsort((digest[mine], key[mine]))]
    head = _runs(key[order], digest[order])
    size = np.diff(np.concatenate((head, [len(order)])))
    again = (size > 1) | (np.add.reduceat(twice[order].astype(np.int64), head) > 0 if len(head) else np.zeros(0, bool))
    bucket = _runs(key[order[head]])
    groups = np.diff(np.concatenate((bucket, [len(head)])))
    new = np.add.reduceat((~again).astype(np.int64), bucket) if len(bucket) else np.zeros(0, np.int64)
    to_sort = np.repeat((groups > 1) & (new > 0), groups) | (~again & several[order[head]])
    parts = [
        (settled, _DUPLICATE), (order[np.repeat(again, size)], _DUPLICATE), (loose[twice[loose]], _DUPLICATE),
        (order[head[to_sort & again]], _WITNESS), (order[head[to_sort & ~again]], _OPEN), (loose[twice[loose]], _HOT_WITNESS), (loose[~twice[loose]], _HOT_OPEN),
    ]
    rows = np.concatenate([at for at, _ in parts])
    kinds = np.concatenate([np.full(len(at), kind, np.int32) for at, kind in parts])
    table = table.select(["doc_id", "salt", "start", "n", "key"])
    for lo in range(0, len(rows), 100_000):
        taken = table.take(pa.array(rows[lo : lo + 100_000])).append_column("kind", pa.array(kinds[lo : lo + 100_000]))
        yield from taken.combine_chunks().to_batches()


def _bytes_of_slices(batches):
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    schema = pa.schema([("doc_id", pa.int64()), ("salt", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("open", pa.bool_()), ("hot", pa.bool_()), ("content", pa.binary())])
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            rows = []
            for r in batch.slice(lo, 64).to_pylist():
                text = unpack(r["packed"])
                # identical rows of the table list a slice each: once is enough
                for start, n, key, kind in {(s["start"], s["n"], s["key"], s["kind"]) for s in r["slices"]}:
                    rows.append((r["doc_id"], r["salt"], start, n, key, kind in (_OPEN, _HOT_OPEN), kind in (_HOT_OPEN, _HOT_WITNESS), text[start : start + n + LENGTH - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _strings(batches):
    """Hash and place of every 200-byte string of the slices."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            rows = []
            for r in batch.slice(lo, 256).to_pylist():
                text = r["content"]
                rows += [(hashlib.blake2b(text[i : i + LENGTH], digest_size=16).digest(), r["doc_id"], r["salt"], r["start"] + i, r["open"]) for i in range(r["n"])]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["string", "doc_id", "salt", "start", "open"])


def _sort_suffixes(batches):
    """Repeated strings of the open slices; rows come sorted by key, and as many buckets as fit are sorted at a time."""
    held, size, key, head, before = [], 0, None, 0, 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                if row[4] != key:
                    key, head, before = row[4], len(held), size
                held.append(row)
                size += len(row[6])
                if size > SORTED and head:
                    yield _sort_buckets(held[:head])
                    held, size, head = held[head:], size - before, 0
    if held:
        yield _sort_buckets(held)


def _sort_buckets(rows: list[tuple]) -> pa.RecordBatch:
    doc, salt, start, n, _, open_, content = zip(*rows)
    n, start = np.asarray(n, np.int64), np.asarray(start, np.int64)
    sizes = n + LENGTH - 1
    begins, first = np.cumsum(sizes) - sizes, np.cumsum(n) - n
    of = np.repeat(np.arange(len(rows)), n)
    inside = np.arange(int(n.sum())) - first[of]
    marked = repeated_windows(np.frombuffer(b"".join(content), np.uint8), begins[of] + inside) & np.asarray(open_)[of]
    edge = np.ones(len(marked), bool)
    edge[1:] = (marked[1:] != marked[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(edge)
    length = np.diff(np.concatenate((at, [len(marked)])))
    keep = marked[at]
    at, length = at[keep], length[keep]
    rows_of = of[at].tolist()
    columns = [pa.array([doc[i] for i in rows_of], pa.int64()), pa.array([salt[i] for i in rows_of], pa.int64()), pa.array((start[of[at]] + inside[at]).astype(np.int32)), pa.array(length.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "salt", "start", "n"])


def _packed(batches):
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [pack(t) for t in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("salt"), pa.array(packed, pa.binary())], names=["doc_id", "salt", "packed"])


def spans_of(starts: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings from ``counts`` consecutive starts cover."""
    out: list[list[int]] = []
    for a, n in sorted(zip(starts, counts)):
        b = a + n + LENGTH - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans widened over the UTF-8 characters at their edges; those that meet then are one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        while a > 0 and a < len(text) and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        if out and a <= out[-1][1]:
            a = out.pop()[0]
        out.append((a, b))
    return out


def _apply(widen: bool):
    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(lo, 256).to_pylist():
                    text, kept, at = unpack(r["packed"]), [], 0
                    spans = spans_of([m["start"] for m in r["marks"] or ()], [m["n"] for m in r["marks"] or ()])
                    spans = whole_characters(text, spans) if widen else spans
                    for a, b in spans:
                        kept.append(text[at:a])
                        at = b
                    kept = b"".join([*kept, text[at:]])
                    rows.append((r["doc_id"], r["salt"], len(text), len(text) - len(kept), [list(s) for s in spans], kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "salt", "n_bytes", "n_removed", "spans", "kept"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, salt (hash of the text), marks: the suffix starts of repeated strings, as runs (start, n)."""
    spark = docs.sparkSession
    content = text_of(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(content).alias("salt"), content.alias("content"))
    total = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    parts = partitions_for(spark, total, 32 << 20)

    least = max(HEAVY, total // WINDOW // HEAVY_KEYS)
    heavy = _frequent(rows, least)
    hot_keys = _frequent(rows, least, heavy) if len(heavy.value) else heavy

    slices = rows.mapInArrow(_cut(heavy, hot_keys), _SLICE)
    kinds = written(slices.repartition(parts, "deal").mapInArrow(_classify, "doc_id bigint, salt bigint, start int, n int, key bigint, kind int"), "slices")

    wanted = kinds.filter(F.col("kind") != _DUPLICATE).groupBy("doc_id", "salt").agg(F.collect_list(F.struct("start", "n", "key", "kind")).alias("slices"))
    packed = rows.mapInArrow(_packed, "doc_id bigint, salt bigint, packed binary").hint("merge")
    # rows that agree in id and text are alike in every respect: one stands for all
    found = packed.alias("p").join(wanted.alias("w"), (F.col("p.salt") == F.col("w.salt")) & F.col("p.doc_id").eqNullSafe(F.col("w.doc_id")))
    schema = "doc_id bigint, salt bigint, start int, n int, key bigint, open boolean, hot boolean, content binary"
    pieces = found.select("p.doc_id", "p.salt", "packed", "slices").mapInArrow(_bytes_of_slices, schema)
    # buckets over the bound, which the second count did not find because few slices or plain anchors make them
    sizes = kinds.filter(F.col("kind").isin(_OPEN, _WITNESS)).groupBy("key").agg(F.sum(F.col("n") + LENGTH - 1).alias("bytes"))
    large = written(sizes.filter(F.col("bytes") > SORTED).select("key"), "large")
    some_large, some_hot = not large.isEmpty(), len(hot_keys.value) > 0
    if some_large or some_hot:
        pieces = written(pieces, "pieces")
    to_sort, to_count = pieces.filter("NOT hot"), pieces.filter("hot")
    if some_large:
        to_count = to_count.unionByName(to_sort.hint("merge").join(large, "key", "left_semi").select(pieces.columns))
        to_sort = to_sort.hint("merge").join(large, "key", "left_anti").select(pieces.columns)
    to_sort = to_sort.select("doc_id", "salt", "start", "n", "key", "open", "content")
    sorted_marks = written(to_sort.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_sort_suffixes, "doc_id bigint, salt bigint, start int, n int"), "marks")
    marks = kinds.filter(F.col("kind") == _DUPLICATE).select("doc_id", "salt", "start", "n").unionByName(sorted_marks)
    if some_large or some_hot:
        strings = written(to_count.mapInArrow(_strings, "string binary, doc_id bigint, salt bigint, start int, open boolean"), "strings")
        again = strings.groupBy("string").agg(F.count("*").alias("times")).filter("times > 1").select("string")
        found_again = strings.filter("open").hint("merge").join(again, "string", "left_semi").select("doc_id", "salt", "start", F.lit(1).alias("n"))
        marks = marks.unionByName(written(found_again, "marks"))
    return marks.groupBy("doc_id", "salt").agg(F.collect_set(F.struct("start", "n")).alias("marks"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", widen: bool = False) -> DataFrame:
    """Remove every byte covered by a 200-byte string that starts anywhere else too.

    Returns per row: ``id_col``, salt, n_bytes, n_removed, spans (maximal removed runs, as [start, end)), kept (binary:
    the remaining bytes). With ``widen``, a character of which a byte goes is removed whole. Texts are judged as UTF-8 bytes on the input; matches never cross rows; a null text counts as
    empty. Repeated rows are copies of each other, so they lose their bytes from 200 on. Ids may be null; other columns
    are ignored; an empty table gives no rows.
    """
    content = text_of(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(content).alias("salt"), content.alias("content"))
    packed = rows.mapInArrow(_packed, "doc_id bigint, salt bigint, packed binary").hint("merge")
    marks = repeated_spans(docs, id_col, text_col)
    joined = packed.alias("p").join(marks.alias("m"), (F.col("p.salt") == F.col("m.salt")) & F.col("p.doc_id").eqNullSafe(F.col("m.doc_id")), "left").select("p.doc_id", "p.salt", "packed", "marks")
    out = joined.mapInArrow(_apply(widen), "doc_id bigint, salt bigint, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary")
    return out.withColumnRenamed("doc_id", id_col)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

