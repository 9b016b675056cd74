"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

A task inserts its distinct pre-tokens in one trie. A node holds the best forward score of its prefix and the tokens of that
segmentation, computed once when the node is made, so pre-tokens share the work of their common prefixes; the node where a pre-token
ends holds its count. The pieces that end at a character are found backwards, for as long as some piece ends in what was passed. The trie
and the table of ends start anew when they are full.

The vocabulary's file has merge ranks, not probabilities, and tokenizers are never trained here; so a piece's probability follows
from its rank r by Zipf's law as 1 / (r + ZIPF), normalised over the vocabulary. The best segmentation has the largest sum of log
probabilities, then the fewest tokens. A character that no piece covers costs the least log probability less 10 and counts its UTF-8
bytes as tokens where the vocabulary has byte pieces, else one.

Null and empty texts have no tokens. Rows that repeat a doc_id are counted each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from posetrail.llm import shared

SPACE = "▁"
#: Nodes of a task's trie, and pre-tokens whose ends it keeps; beyond these it starts anew.
NODES, KEPT = 500_000, 600_000
#: Shift of ranks in Zipf's law.
ZIPF = 2.7


def pieces(model_path: str) -> tuple[dict[str, float], bool]:
    """(piece -> log probability, whether bytes are pieces) of a SentencePiece model file of the merge type."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        proto.ParseFromString(f.read())
    kinds = proto.SentencePiece
    ranked = [p.piece for p in sorted((p for p in proto.pieces if p.type == kinds.NORMAL), key=lambda p: -p.score)]
    total = math.log(sum(1 / (r + ZIPF) for r in range(1, len(ranked) + 1)))
    return {p: -math.log(r + ZIPF) - total for r, p in enumerate(ranked, 1)}, any(p.type == kinds.BYTE for p in proto.pieces)


class Counter:
    """Counts of the best segmentation, in a trie."""

    def __init__(self, scores: dict[str, float], bytes_too: bool):
        self.bytes_too = bytes_too
        self.unknown = min(scores.values(), default=0.0) - 10
        #: What pieces end in, with the score of what is a piece itself.
        self.tails: dict[str, float | None] = {p[k:]: None for p in scores for k in range(1, len(p))} | scores
        self.steps = 0  # nodes whose forward scores were computed
        self.clear()

    def clear(self) -> None:
        self.below: list[dict[str, int]] = [{}]
        self.best, self.tokens = [0.0], [0]
        self.kept: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """The token count of a word; nodes of its prefixes that are not there yet are made."""
        node, path, find = 0, [0], self.tails.get
        trie, best, tokens = self.below, self.best, self.tokens
        for end, c in enumerate(word, 1):
            below = trie[node]
            node = below.get(c, -1)
            if node < 0:
                last = path[-1]
                top, fewest = best[last] + self.unknown, tokens[last] + (len(c.encode("utf-8", "surrogatepass")) if self.bytes_too else 1)
                for begin in range(end - 1, -1, -1):
                    s = find(word[begin:end], False)
                    if s is None:
                        continue
                    if s is False:  # nothing ends in this
                        break
                    s += best[path[begin]]
                    if s >= top:
                        n = tokens[path[begin]] + 1
                        if s > top or n < fewest:
                            top, fewest = s, n
                node = below[c] = len(best)
                trie.append({})
                best.append(top)
                tokens.append(fewest)
                self.steps += 1
            path.append(node)
        return tokens[node]

    parts = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")

    def count(self, texts: list[str]) -> list[int]:
        split = [self.parts.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.kept) > KEPT or len(self.best) > NODES:
            self.clear()
        kept = self.kept
        for parts in split:
            for p in parts:
                if p not in kept:
                    kept[p] = self.insert(p)
        get = kept.__getitem__
        return [sum(map(get, parts)) for parts in split]


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens) of every row; a narrow job."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces(model_path))  # 32,000 pieces
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n = counter.count([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(shared.tidy(run), f"doc_id {kind}, n_tokens long")
