"""Token counts under a unigram model, with forward scores shared in a trie.

Distinct pre-tokens of a batch are inserted in a trie. A node's forward score (the best segmentation of its prefix)
depends on the path above it only, so it is computed once however many pre-tokens pass through; the count of the best
segmentation is stored at terminals. A document's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import load_ranks
from .common import Shared, text_of

#: Distinct pre-tokens whose counts a worker remembers before it starts over.
MEMO = 1 << 19
#: Bytes of a pre-token that the trie holds; what a longer one has beyond them is scored without being inserted.
DEEP = 1 << 12


def unigram_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Integer log scores of a Zipfian unigram model over a ranked vocabulary; integers make ties exact."""
    return {token: -round(math.log(rank + 2) * (1 << 20)) for token, rank in ranks.items()}


class Trie:
    """Nodes hold the forward score and token count of their prefix; a byte outside the vocabulary counts as a token."""

    def __init__(self, scores: dict[bytes, int]) -> None:
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.unknown = 2 * min(scores.values(), default=-1)
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.forward: list[tuple[int, int]] = [(0, 0)]  # score, minus the count: the larger pair is better

    def count(self, piece: bytes) -> int:
        """Insert a pre-token; the token count of its best segmentation, the shortest of equally good ones."""
        node, path, n = 0, [0], len(piece)
        children, forward = self.children, self.forward
        for i in range(n):
            if (child := children[node].get(piece[i])) is None:
                break
            node = child
            path.append(node)
        scores, longest = self.scores, self.longest
        recent = [forward[at] for at in path[-longest:]]
        for i in range(len(path), n + 1):
            best, low = None, i - len(recent)
            for j in range(low, i):
                if (s := scores.get(piece[j:i])) is None:
                    if j != i - 1:
                        continue
                    s = self.unknown
                before = recent[j - low]
                candidate = (before[0] + s, before[1] - 1)
                if best is None or candidate > best:
                    best = candidate
            recent.append(best)
            if len(recent) > longest:
                del recent[0]
            if i <= DEEP:
                children[node][piece[i - 1]] = node = len(children)
                children.append({})
                forward.append(best)
        return -recent[-1][1]


class Counter:
    def __init__(self, scores: dict[bytes, int], pattern: str) -> None:
        self.trie, self.findall, self.memo = Trie(scores), regex.compile(pattern).findall, {}

    def count_all(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        lists = [self.findall(t) for t in texts]
        unknown = set().union(*lists).difference(self.memo)
        if len(self.memo) + len(unknown) > MEMO:
            self.memo, unknown = {}, set().union(*lists)
        self.trie.clear()  # the batch's trie; its terminals' counts are kept
        for word in sorted(unknown):
            self.memo[word] = self.trie.count(word.encode("utf-8"))
        get = self.memo.__getitem__
        return [(len(words), sum(map(get, words))) for words in lists]


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_bytes, n_pretokens, n_tokens of the whole text.

    Null texts count as empty (all zero); ids may be null or repeated, and repeated rows are counted alike; other columns
    are ignored; an empty table gives no rows. A pre-token may have any length.
    """
    shared = Shared(docs.sparkSession, unigram_scores(load_ranks(ranks_path)))  # a vocabulary file of fixed size

    def run(batches):
        if shared.id not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[shared.id] = Counter(shared.value, pattern)
        counter = _COUNTERS[shared.id]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = part.column("text").to_pylist()
                counts = counter.count_all(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("n_bytes"), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], names=[id_col, "n_bytes", "n_pretokens", "n_tokens"]
                )

    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes")).mapInArrow(run, f"`{id_col}` bigint, n_bytes bigint, n_pretokens bigint, n_tokens bigint")
