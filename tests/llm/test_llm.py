"""The training-data operators against brute force, on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("cantus.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from cantus.llm import byte_bpe, chat, exact_dedup, near_dedup, packing, suffix_dedup, token_counts, token_files, topk, toxicity, word_ids  # noqa: E402
from cantus.llm.queries import tokenizer_file  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, sha string, id bigint"
LONG = "lorem ipsum dolor " * 4000
ROWS = [
    (1, "same text", "a", "x", 1), (2, "same text", None, "y", 2), (3, None, "b", None, None), (4, "", "b", "z", 1), (5, "Same text", "c", "x", 5),
    (5, "Same text", "c", "x", 5), (6, LONG, "d", "x", 6), (7, LONG, "d", "x", 7), (8, "ÉTÉ İstanbul ß \x1c</s>[INST]<|endoftext|> 日本 x'll", "e", "x", 8), (None, "no id", "f", "x", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(i, t or "") for i, t, *_ in ROWS]


# --- exact dedup ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("budget", [1 << 20, 300])
def test_exact_dedup(docs, budget):
    got = exact_dedup.exact_dedup(docs, table_bytes=budget).collect()
    groups = collections.defaultdict(list)
    for i, t in texts():
        groups[t].append(i)
    assert len(got) == len(ROWS)
    kept = collections.Counter()
    for r in got:
        t = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in groups[t] if i is not None]
        assert r.group_size == len(groups[t]) and r.keep_id == (max(ids) if ids else None)
        kept[t] += r.kept
    assert all(v == 1 for v in kept.values())


def test_exact_dedup_levels_with_colliding_hashes():
    table = exact_dedup.ContentTable(4)
    for n in range(50):
        content = str(n % 10).encode()
        table.add(*table.find(7, content), 7, b"", content, n, 1)
    assert sorted(zip(table.contents, table.max_ids, table.counts)) == [(str(k).encode(), 40 + k, 5) for k in range(10)]


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert packing.pack_documents(empty, tokenizer_file("word_bpe_49k.json")).count() == 0
    assert token_files.token_file_digests(empty, tokenizer_file("word_bpe_49k.json")).count() == 0


# --- near dedup -----------------------------------------------------------------------------------------------------


def brute_classes(rows):
    sets = {i: near_dedup.shingles(near_dedup.words_of(t)) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a]) and len(sets[b]) and near_dedup.similarity(sets[a], sets[b]) >= near_dedup.SIMILAR:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


def test_near_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, ""), (n + 1, "  !! "), (n + 2, "short text"), (n + 3, "Short, text")]
    want = brute_classes(rows)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.class_id) for i, r in got.items())
    sizes = collections.Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] for r in got.values())


def test_near_dedup_finds_a_link_behind_many_likelier_refuted_pairs(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    rows = []
    for i in range(80):
        words = list(base)
        for at in rng.sample(range(400), 6):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want = brute_classes(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(set(want.values())) == 76 and {r.doc_id: r.class_id for r in got} == want


def test_near_dedup_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL_ROWS", 7)
    rng = random.Random(2)
    rows = []
    for family in range(3):
        base = [f"v{rng.randrange(2000)}" for _ in range(200)]
        for edits in (1, 2, 4, 6, 8, 10) * 6:
            words = list(base)
            for at in rng.sample(range(200), edits):
                words[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words + words[: 40 * (family == 2)] * rng.randrange(3))))
    want = brute_classes(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want and 3 < len(set(want.values())) < len(rows)


def test_links_of_a_cell_connect_what_brute_force_connects():
    rng = np.random.default_rng(4)
    for _ in range(30):
        universe, sets, comps = rng.integers(1, 1 << 60, 40).astype(np.uint64), [], []
        for i in range(14):
            drawn = np.sort(rng.choice(universe, rng.integers(30, 41), replace=False))
            sets.append((drawn, rng.integers(1, 4, len(drawn)) if rng.random() < 0.4 else None))
            comps.append(int(rng.integers(0, 9)))
        sides = [3 if c else 1 for c in comps]
        parent = {c: c for c in comps}

        def root(c):
            while parent[c] != c:
                c = parent[c]
            return c

        for a in range(14):
            for b in range(14):
                x, y = (np.repeat(s[0], 1 if s[1] is None else s[1]) for s in (sets[a], sets[b]))
                if comps[a] != comps[b] and near_dedup.similarity(x, y) >= near_dedup.SIMILAR:
                    parent[root(comps[a])] = root(comps[b])
        want = {frozenset(c for c in parent if root(c) == root(d)) for d in parent}
        links = near_dedup.links_of_cell(comps, sides, sets)
        parent = {c: c for c in comps}
        for a, b in links:
            assert root(a) != root(b)
            parent[root(a)] = root(b)
        assert {frozenset(c for c in parent if root(c) == root(d)) for d in parent} == want


def test_near_dedup_finds_texts_that_only_repeat_more(spark):
    rng = random.Random(5)
    rows = []
    for n in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words + words[:150] * 200))]
    want = {i: i - i % 2 for i, _ in rows}
    sets = [near_dedup.shingles(near_dedup.words_of(t)) for _, t in rows[:2]]
    assert near_dedup.similarity(*sets) >= 0.8 > 0.7 > near_dedup.probability_jaccard(*map(near_dedup.weighted, sets))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert near_dedup.expected_miss() < 1e-5


def test_near_dedup_awkward_rows(docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert all(r.kept and r.class_id is None for r in got if r.doc_id is None)
    assert sum(r.kept for r in got if r.doc_id == 5) <= 1
    assert {r.class_id for r in got if r.doc_id in (1, 2, 5)} == {1}


def test_prob_min_hash_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    elements = rng.integers(1, 1 << 60, 500).astype(np.uint64)
    a, b = np.sort(elements[:400]), np.sort(elements[60:])
    wa, wb = 1 + rng.random(len(a)) * 3, 1 + rng.random(len(b)) * 3
    both = np.concatenate((a, b))
    owner = np.repeat([0, 1], [len(a), len(b)])
    signature = near_dedup.prob_min_hash(both, np.concatenate((wa, wb)), owner, 2, 4096)
    naive = 0.0
    x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    for e in set(x) & set(y):
        naive += 1 / sum(max(x.get(f, 0) / x[e], y.get(f, 0) / y[e]) for f in set(x) | set(y))
    assert near_dedup.probability_jaccard((a, wa), (b, wb)) == pytest.approx(naive)
    assert (signature[0] == signature[1]).mean() == pytest.approx(naive, abs=0.04)


# --- tokens ---------------------------------------------------------------------------------------------------------


def test_byte_bpe_equals_library(docs):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    got = sorted(byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect(), key=lambda r: bytes(r.ids))
    want = sorted(np.asarray(library.encode_ordinary(t), "<u4").tobytes() for _, t in texts())
    assert [bytes(r.ids) for r in got] == want
    assert sorted(bytes(r.decoded) for r in got) == sorted(t.encode() for _, t in texts())


def test_merges_take_the_leftmost_of_equal_ranks():
    ranks = {bytes([c]): c for c in range(256)} | {b"aa": 256, b"aaa": 257}
    assert byte_bpe.merge_bytes(b"aaaaa", ranks) == [256, 257]
    table = byte_bpe.PerfectHash(ranks)
    assert all(table.get(k) == v for k, v in ranks.items()) and table.get(b"zz") == -1


def test_word_ids_equal_library():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    library.encode_special_tokens = True
    encoder = word_ids.WordIds(word_ids.read_tokenizer(tokenizer_file("word_bpe_49k.json")))
    rng = random.Random(1)
    alphabet = "aAbZ éÉßİıĳŉƁΣσς'’.,!$<|>09²½Ⅷ́\x1c\x1d\t\n 　日😀ʰ"
    samples = [t for _, t in texts() if len(t) < 1000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    for t in samples:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_token_counts_equal_plain_dynamic_programming(docs):
    import regex

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    scores = token_counts.unigram_scores(byte_bpe.load_ranks(path))

    def plain(piece):
        best = [(0, 0)]
        for i in range(1, len(piece) + 1):
            best.append(max((best[j][0] + scores[piece[j:i]], best[j][1] - 1) for j in range(i) if piece[j:i] in scores))
        return -best[-1][1]

    words = {t: regex.findall(public_tokenizers.PATTERN, t) for _, t in texts()}
    want = sorted((len(t.encode()), len(w), sum(plain(x.encode()) for x in w)) for t, w in ((t, words[t]) for _, t in texts()))
    got = token_counts.token_counts(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted((r.n_bytes, r.n_pretokens, r.n_tokens) for r in got) == want


def test_long_pre_tokens_are_scored_beyond_the_trie(monkeypatch):
    rng = random.Random(9)
    scores = {t: -rng.randint(1, 90) for t in (b"a", b"b", b"ab", b"ba", b"abb", b"bbbb", b"abab")}
    pieces = [bytes(rng.choice(b"abz") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    whole = token_counts.Trie(scores)
    want = [whole.count(p) for p in pieces]
    monkeypatch.setattr(token_counts, "DEEP", 5)
    short = token_counts.Trie(scores)
    assert [short.count(p) for p in pieces] == want and len(short.children) < len(whole.children) / 3


def test_empty_tables_of_the_other_operators(empty, spark):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    assert token_counts.token_counts(empty, path, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.digests(empty, path, public_tokenizers.PATTERN).count() == 0
    items = spark.createDataFrame([], "id bigint, vector array<bigint>")
    assert topk.maxscore_topk(items, items, 3).count() == 0
    assert toxicity.toxicity(empty, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == 0
    assert chat.conversation_digests(chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


def test_one_word_of_a_megabyte(spark):
    tiktoken = pytest.importorskip("tiktoken")
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghij") for _ in range(1 << 20))
    docs = spark.createDataFrame([(1, word), (1, word), (2, word[:100])], "doc_id bigint, text string")
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    counts = token_counts.token_counts(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted(r.n_bytes for r in counts) == [100, 1 << 20, 1 << 20] and all(r.n_pretokens == 1 for r in counts)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()}
    assert bytes(got[1].decoded) == word.encode() and bytes(got[2].ids) == np.asarray(library.encode_ordinary(word[:100]), "<u4").tobytes()
    assert {r.kept for r in near_dedup.near_duplicates(docs).collect() if r.doc_id == 2} == {True}


def test_simple8b_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 59, 60, 61, 5000):
        for high in (1, 2, 50, 50_000, 1 << 32):
            ids = rng.integers(0, high, n).astype("<u4")
            ids[rng.random(n) < 0.01] = (1 << 32) - 1
            words = token_files.encode_words(ids)
            assert np.array_equal(token_files.decode_words(words), ids)
    ids = rng.integers(0, 50_000, 9000).astype("<u4")
    _, _, _, _, _, n, offsets, words = token_files._block(0, 0, 0, [1], [ids.tobytes()])
    part = token_files.decode_slice(np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4"), 4321, 6789)
    assert n == 9000 and np.array_equal(part, ids[4321:6789])


def test_token_files(docs):
    encoder = word_ids.WordIds(word_ids.read_tokenizer(tokenizer_file("word_bpe_49k.json")))
    end, start, want = np.asarray([1], "<u4").tobytes(), 0, []
    for i, t in sorted(texts(), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = encoder.encode(t) + end
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    got = [tuple(r) for r in token_files.token_file_digests(docs, tokenizer_file("word_bpe_49k.json")).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_files_of_one_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(token_files, "RUN_IDS", 64)
    rows = [(None if k % 2 else 7, f"text {k * 7919 % 101} " * (k % 40)) for k in range(120)]
    path = tokenizer_file("word_bpe_49k.json")
    files = token_files.write_token_files(spark.createDataFrame(rows, "doc_id bigint, text string"), path, file_bytes=2000, block_ids=500)
    got = token_files.read_token_files(files).orderBy("start").collect()
    encoder, at, want = word_ids.WordIds(word_ids.read_tokenizer(path)), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[1])):
        ids = encoder.encode(t) + b"\1\0\0\0"
        want.append((i, at, len(ids) // 4, ids))
        at += len(ids) // 4
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == want
    assert files.select("file").distinct().count() > 4


def test_packing(docs):
    encoder = word_ids.WordIds(word_ids.read_tokenizer(tokenizer_file("word_bpe_49k.json")))
    end = np.asarray([1], "<u4").tobytes()
    pieces = packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json")).collect()
    want = collections.Counter()
    for i, t in texts():
        ids = encoder.encode(t) + end
        for at in range(0, len(ids) // 4, 2048):
            part = ids[4 * at : 4 * (at + 2048)]
            want[i, at, len(part) // 4, zlib.crc32(part), len(ids) // 4] += 1
    assert collections.Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_first_fit_decreasing_equals_plain_form():
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(400)]
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    used, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((b for b, u in enumerate(used) if u + sizes[i] <= 100), len(used))
        if at == len(used):
            used.append(0)
        want[i] = (at, used[at])
        used[at] += sizes[i]
    assert {i: (bins[i], offsets[i]) for i in range(len(sizes))} == want


# --- top-k ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [7, 4096])
def test_topk_equals_brute_force(spark, shard):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-3, 4, 6).tolist()) for i in range(200)] + [(500, [1, 2]), (501, [2, 1]), (502, None), (503, [1, None, 2, 3, 4, 5]), (None, [1] * 6)]
    items = spark.createDataFrame(rows, "id bigint, vector array<bigint>")
    got = topk.maxscore_topk(items, items.filter("id % 20 = 0"), 5, shard_rows=shard).collect()
    want = []
    good = {i: v for i, v in rows if i is not None and v is not None and None not in v}
    for q in (i for i in good if i % 20 == 0):
        scored = sorted((-int(np.dot(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_ranks_every_row(spark):
    """Each row of items is a candidate, and each row of queries has a list: as the registered SQL has it."""
    rows = [(0, [1, 0])] + [(1, [9, 0])] * 3 + [(i, [i, 0]) for i in range(2, 7)] + [(6, [6, 1]), (0, [0, -1]), (0, [1, 0])]
    items = spark.createDataFrame(rows, "id bigint, vector array<bigint>").coalesce(1)
    for k, block in ((4, 4096), (7, 6)):
        got = topk.maxscore_topk(items, items.filter("id = 0"), k, block_queries=block).collect()
        want = []
        for q, v in rows:
            if q == 0:
                scored = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)
                want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
        assert sorted(map(tuple, got)) == sorted(want)


def test_topk_in_several_blocks(spark):
    rng = np.random.default_rng(9)
    items = spark.createDataFrame([(i, rng.integers(-9, 9, 4).tolist()) for i in range(60)], "id bigint, vector array<bigint>")
    one = topk.maxscore_topk(items, items, 3).collect()
    many = topk.maxscore_topk(items, items, 3, block_queries=40).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 180


def test_integer_vectors(spark):
    rows = [(1, [0.5, -0.0001]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (5, [None, 1.0])]
    got = topk.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert [tuple(r) for r in got] == [(1, [512, -1])]


# --- suffix dedup ---------------------------------------------------------------------------------------------------


def brute_spans(rows):
    count = collections.Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    out = []
    for i, b in rows:
        covered = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                covered[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, x in zip(b, covered) if not x)
        runs = sum(1 for k, x in enumerate(covered) if x and (k == 0 or not covered[k - 1]))
        out.append((i, len(b), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, line = noise(500), noise(90)
    rows = [(i, noise(rng.randint(0, 600)) + (passage[rng.randint(0, 80) :] if i % 3 == 0 else "") + line + noise(rng.randint(0, 300))) for i in range(40)]
    rows += [(100, "ab " * 400), (101, "x" * 450), (102, None), (103, rows[0][1]), (103, rows[0][1]), (104, passage[:199]), (105, "yz" * 99), (None, rows[3][1])]
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_spans([(i, (t or "").encode()) for i, t in rows])


def test_suffix_dedup_with_heavy_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY", 3)
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    line, tail = noise(120), noise(150)
    rows = [(i, noise(200) + line + (tail if i % 2 else noise(150)) + noise(100)) for i in range(60)]
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_spans([(i, t.encode()) for i, t in rows])


def test_suffix_dedup_sorts_no_bucket_over_the_bound(spark, monkeypatch):
    rng = random.Random(13)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    line, tail = noise(150), noise(150)
    rows = [(i, noise(150) + line + (tail if i % 5 == 0 else noise(150))) for i in range(40)]
    sorted_bytes = []
    plain = suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "SORTED", 4000)
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda text, starts: sorted_bytes.append(len(text)) or plain(text, starts))
    monkeypatch.setattr(suffix_dedup, "written", lambda df, label: df.sparkSession.createDataFrame(df.collect(), df.schema))
    collect = lambda df, function, schema: df.sparkSession.createDataFrame(
        [tuple(r.values()) for b in function(iter(df.toArrow().combine_chunks().to_batches())) for r in b.to_pylist()], schema
    )
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.mapInArrow", collect)
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_spans([(i, t.encode()) for i, t in rows])
    assert sorted_bytes and max(sorted_bytes) <= 4000


def test_suffix_dedup_counts_anchors_over_all_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY", 20)
    rng = random.Random(14)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    line, tail = noise(190), noise(60)
    rows = [(i, noise(150) + line + (tail if i % 9 == 0 else noise(60)) + noise(40)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(30)
    found = []
    plain = suffix_dedup._frequent
    monkeypatch.setattr(suffix_dedup, "_frequent", lambda *a: found.append(plain(*a)) or found[-1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = suffix_dedup.digests(docs).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(len(keys.value) for keys in found) and len(found) == 2
    assert sorted((tuple(r) for r in got), key=str) == brute_spans([(i, t.encode()) for i, t in rows])


def test_whole_characters():
    text = "aé日b".encode()
    assert suffix_dedup.whole_characters(text, [(2, 3)]) == [(1, 3)]
    assert suffix_dedup.whole_characters(text, [(1, 2), (4, 5)]) == [(1, 6)]
    assert suffix_dedup.whole_characters(text, [(0, len(text))]) == [(0, len(text))]


def test_difference_cover():
    for v in (7, 13, 32, 64):
        cover = suffix_dedup.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_repeated_windows_with_equal_prefix_hashes(monkeypatch):
    rng = np.random.default_rng(4)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    text[1500:1800] = text[200:500]
    starts = np.arange(len(text) - 199)
    count = collections.Counter(text[i : i + 200].tobytes() for i in starts)
    want = np.asarray([count[text[i : i + 200].tobytes()] > 1 for i in starts])
    assert np.array_equal(suffix_dedup.repeated_windows(text, starts), want)
    weak = suffix_dedup.hashes
    monkeypatch.setattr(suffix_dedup, "hashes", lambda t, n: weak(t, n) % np.uint64(5))
    assert np.array_equal(suffix_dedup.repeated_windows(text, starts), want)


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_folding():
    for text in ("1d10t", "іdіоt", "Ｉｄｉｏｔ", "ídiot", "id​iot", "IDIOT", "!diot"):
        assert toxicity.fold(text) == "idiot"
    assert toxicity.fold("idiot$$$ 42%") == "idiot$$$ 42%"


def test_matches_are_whole_words_outside_exceptions():
    matcher = toxicity.Matcher({"trash": 2.0, "scum": 1.0})
    assert [t[2] for t in matcher.spans("trash, the trash can. scumble scum")] == [2.0, 1.0]
    assert matcher.features("") == (0.0, 0.0, 0.0)


def test_matches_equal_a_naive_scan():
    rng = random.Random(8)
    terms = {"ab": 1.0, "abc": 2.0, "b": 0.5, "cab": 1.5, "bc": 3.0}
    phrases = ("ab bc", "b c", "cab")
    matcher = toxicity.Matcher({t: w for t, w in terms.items() if t not in phrases}, phrases)
    for _ in range(3000):
        text = "".join(rng.choice("abc  .") for _ in range(rng.randint(0, 14)))
        whole = lambda a, b: (a == 0 or not text[a - 1].isalpha()) and (b == len(text) or not text[b].isalpha())
        at = [(a, b) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if whole(a, b)]
        excused = [(a, b) for a, b in at if text[a:b] in phrases]
        want = [(a, b, terms[text[a:b]]) for a, b in at if text[a:b] in terms and text[a:b] not in phrases and not any(x <= a and b <= y for x, y in excused)]
        assert sorted(matcher.spans(text)) == sorted(want)


def test_toxicity_on_held_out_rows(spark, small):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    flagged = [r for r in rows if r.predicted]
    assert flagged and sum(r.toxic for r in flagged) >= 0.9 * len(flagged)
    mean = lambda label: np.mean([r.score for r in rows if r.toxic == label])
    assert mean(1) > mean(0) + 0.2


def test_toxicity_without_labels(docs, spark):
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, toxic int")
    bad = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "you 1d10t, worthless scum")], "doc_id bigint, text string"))
    got = toxicity.toxicity(bad, labels).collect()
    assert len(got) == len(ROWS) + 1
    assert {r.doc_id for r in got if r.predicted} == {50}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


# --- chat -----------------------------------------------------------------------------------------------------------


def test_escaping_is_reversible():
    rng = random.Random(6)
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "", "a>"]), "".join(rng.choice("ab\\<>[]/INST|s\n") for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(1, 5))]
        assert chat.parse("".join(chat.format_turn(*t)[0] for t in turns)) == turns


def test_chat_prefix_tree(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said, 1), (-1, 1, "assistant", said, 1)]
    for c in range(30):
        rows += [(c, 0, "system", "shared", 0), (c, 1, "user", f"q{c % 5}", 0), (c, 2, "assistant", f"a{c % 7}" * (c % 3), 0), (c, 2, None, None, 0)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, path int")
    sequences = chat.format_conversations(table)
    kept = sequences.collect()
    chars = sum(len(s.text) for s in kept)
    got = {r.conv_id: r for r in chat.conversation_digests(sequences).collect()}
    assert chars < sum(r.formatted_chars for r in got.values()) / 2
    turns = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        turns[c].append((t, role or "", text or ""))
    assert set(got) == set(turns)
    for c, parts in turns.items():
        parts.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in parts)
        loss = "".join(x for _, r, x in parts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(parts), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for s in kept:  # positions count a node's ancestors, and intervals cover them and the node
        for i, parent in enumerate(s.parents):
            before = s.positions[parent] + s.lengths[parent] if parent >= 0 else 0
            assert s.positions[i] == before == sum(b - a for a, b in s.attends[i]) - s.lengths[i]


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline

    x, y, z = (" ".join(f"{c}{k}" for k in range(80)) for c in "xyz")
    rows = [(7, x), (7, y), (8, x + " more"), (9, z), (9, z + " more"), (9, "")]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    got = collections.Counter((r.doc_id, r.text.removesuffix(" more")) for r in left)
    assert got == collections.Counter([(7, x), (7, y), (9, z), (9, "")])


CLASHING = ("_id", "_text", "_score", "_sha", "_kept", "salt", "n_removed", "row", "id", "rest", "sha", "key")


def pipeline_rows():
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "gé") for b in ("lo", "ma", "nis", "rê", "tor", "ux", "zen")]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(("", "", "s", "ni")) for _ in range(n))
    passage, base = prose(70), prose(150)
    rows = [(i, prose(rng.randint(20, 90))) for i in range(12)]
    rows += [(20, rows[0][1]), (21, rows[0][1]), (21, rows[0][1]), (22, rows[1][1])]  # exact copies
    rows += [(30 + k, " ".join([f"w{k}", *base.split()[1:-1], f"v{k}"])) for k in range(4)]  # near copies
    rows += [(40 + k, f"{prose(10)}\ufffd{prose(20)} \ufffd {passage} {prose(20)}") for k in range(3)]  # a shared passage
    rows += [(50, "you idiot, you worthless pathetic scum " * 3), (51, "you 1d10t and scum, moron, " * 4)]  # toxic
    return rows + [(None, prose(40)), (60, None), (61, ""), (9, prose(45))]


def clashing(spark, rows):
    table = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    return table.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))


def test_near_stage_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (1, words), (2, words + " more"), (3, "another text of some seven plain words"), (3, "another text of some seven plain words"), (4, ""), (4, ""), (None, words), (None, words)]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert collections.Counter(map(tuple, left)) == collections.Counter([(1, words), (3, rows[3][1]), (4, ""), (4, ""), (None, words), (None, words)])


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = pipeline_rows()
    clashing(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = [(i, t) for i, t in rows if i not in (50, 51)]
    best = {}
    for i, t in left:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    left = sorted({(None if i < 0 else i, t) for t, i in best.items()}, key=str)
    numbered = [(n, t) for n, (i, t) in enumerate(left) if i is not None]
    classes = brute_classes(numbered)
    least = {}
    for n, c in classes.items():
        least[c] = min(least.get(c, n), n, key=lambda m: left[m])
    left = [(i, t) for n, (i, t) in enumerate(left) if i is None or least[classes[n]] == n]
    count = collections.Counter(b[k : k + 200] for b in (t.encode() for _, t in left) for k in range(len(b) - 199))
    want = []
    for i, t in left:
        b = t.encode()
        covered = [any(count[b[k : k + 200]] > 1 for k in range(max(0, at - 199), min(at, len(b) - 200) + 1)) for at in range(len(b))]
        ends = np.cumsum([len(c.encode()) for c in t]).tolist()
        want.append((i, "".join(c for c, b, a in zip(t, ends, [0, *ends]) if not any(covered[a:b]))))
    assert sum(len(t) for _, t in want) < sum(len(t) for _, t in left) - 800 and any("\ufffd" in t for _, t in want)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == columns, name
    got = docs.collect()
    assert sorted(((r.doc_id, r.text or "") for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text or "") and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for c in CLASHING) for r in got)

    encoder = word_ids.WordIds(word_ids.read_tokenizer(tokenizer_file("word_bpe_49k.json")))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.doc_tokens) if r.doc_id is not None else (-1, r.doc_tokens) for r in pieces) == sorted((-1 if i is None else i, len(encoder.encode(t)) // 4 + 1) for i, t in want)


def test_pipeline_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing(spark, [(1, "x")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, small), "test")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.filter(F.col("doc_id").isNull()).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert pieces.select("doc_id").distinct().count() == before
    assert math.isfinite(pieces.agg(F.sum("length")).first()[0])
