"""Very long texts and repeated rows in the operators that read whole texts, with results known beforehand."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("cantus.llm")
pytest.importorskip("public_tokenizers")

from cantus.llm import chat, packing, suffix_dedup, token_files, toxicity  # noqa: E402
from cantus.llm.queries import tokenizer_file  # noqa: E402

WORDS = tokenizer_file("word_bpe_49k.json")
LONG = "lorem ipsum dolor " * 100_000
ROWS = [(1, LONG), (2, "short text"), (2, "short text"), (2, "short text"), (3, LONG + "end"), (4, None), (4, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(2)


@pytest.fixture(scope="module")
def ids():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(WORDS)
    made = {t: library.encode(t or "", add_special_tokens=False).ids + [1] for t in {t for _, t in ROWS}}
    return {t: np.asarray(i, "<u4") for t, i in made.items()}


def test_packing(docs, ids):
    got = packing.pack_documents(docs, WORDS).collect()
    pieces = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    want = collections.Counter()
    for i, t in ROWS:
        for start in range(0, len(ids[t]), packing.LENGTH):
            part = ids[t][start : start + packing.LENGTH]
            want[i, start, len(part), zlib.crc32(part.tobytes()), len(ids[t])] += 1
    assert pieces == want
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= packing.LENGTH


def test_token_files(docs, ids):
    got = token_files.token_file_digests(docs, WORDS).collect()
    at = 0
    want = []
    for i, t in sorted(ROWS, key=lambda r: r[0]):
        want.append((i, at, len(ids[t]), zlib.crc32(ids[t].tobytes())))
        at += len(ids[t])
    assert sorted(map(tuple, got)) == sorted(want)


def test_suffix_dedup(docs):
    got = {r.doc_id: r for r in suffix_dedup.digests(docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    # a text that repeats itself every 18 bytes loses all but what its last, new word takes part in
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans, got[1].kept_sha256) == (len(LONG), len(LONG), 1, empty)
    assert (got[3].n_bytes, got[3].n_removed, got[3].n_spans, got[3].kept_sha256) == (len(LONG) + 3, len(LONG), 1, hashlib.sha256(b"end").hexdigest())
    assert got[2].n_removed == got[4].n_removed == 0


def test_toxicity(spark):
    rng = random.Random(3)
    said = lambda toxic: " ".join(f"w{rng.randrange(400)}" if not toxic or rng.random() < 0.6 else rng.choice(("vile", "wretched", "zorkfiend")) for _ in range(40)) + " "
    plain, bad = said(False), said(True)
    rows = [(i, said(i % 2)) for i in range(240)] + [(300, plain * 5000), (301, bad * 5000), (302, bad), (302, bad), (303, None), (303, None)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(240)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), labels).collect()
    assert len(got) == len(rows)
    of = collections.defaultdict(set)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        of[r.doc_id].add((r.score, r.predicted))
    assert all(len(v) == 1 for v in of.values())
    assert {p for _, p in of[301]} == {p for _, p in of[302]} == {1} and {p for _, p in of[300]} == {p for _, p in of[303]} == {0}


def test_chat(spark):
    turns = [(1, 0, "user", LONG), (1, 1, "assistant", LONG + "<x>"), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "[you]"), (2, 1, "assistant", "[you]"), (3, 0, "user", None)]
    rows = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(2)
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(rows)).collect()}
    for conv in (1, 2, 3):
        mine = [t for t in turns if t[0] == conv]
        loss = "".join(t or "" for _, _, role, t in mine if role == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t or ''}\n" for _, _, role, t in mine).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
