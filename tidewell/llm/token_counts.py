"""Operator 1: token counts of texts under a unigram model, shared along a trie."""

from __future__ import annotations

import base64
import hashlib
import math

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from tidewell.llm.workers import kept, map_texts

MAX_NODES = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Piece -> rank of a rank file (base64 piece and rank a line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Unigram log probabilities from a vocabulary ordered by frequency: p ~ 1 / (rank + 1).

    Ranks follow the order in which merges were found, that is, falling frequency. Rank files
    hold no probabilities, and tokenizers are not trained here.
    """
    log_total = math.log(sum(1 / (rank + 1) for rank in ranks.values()))
    return {piece: -math.log(rank + 1) - log_total for piece, rank in ranks.items()}


class CountTrie:
    """Trie of pre-tokens; a node keeps the best score and token count of its prefix.

    The forward step of a node looks back along its own path only, so a prefix that many
    pre-tokens share is computed once. Ties of the score go to fewer tokens.
    """

    def __init__(self, scores: dict[bytes, float], max_nodes: int = MAX_NODES) -> None:
        self.scores, self.longest, self.max_nodes = scores, max(map(len, scores), default=1), max_nodes
        missing = [b for b in range(256) if bytes([b]) not in scores]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # by node: score, minus the number of tokens
        self.terminal: dict[str, int] = {}  # pre-token -> tokens

    def __getitem__(self, word: str) -> int:
        found = self.terminal.get(word)
        return self.insert(word) if found is None else found

    def insert(self, word: str) -> int:
        data = word.encode("utf-8", "surrogatepass")
        child, best, scores, longest = self.child, self.best, self.scores, self.longest
        node, path = 0, [best[0]]
        for i, byte in enumerate(data, 1):
            step = node * 256 + byte
            node = child.get(step, 0)
            if not node:
                top = (-math.inf, 0)
                for j in range(max(0, i - longest), i):
                    score = scores.get(data[j:i])
                    if score is not None:
                        before, count = path[j]
                        top = max(top, (before + score, count - 1))
                best.append(top)
                node = child[step] = len(best) - 1
            path.append(best[node])
        self.terminal[word] = -path[-1][1]
        return -path[-1][1]

    def trim(self) -> None:
        """Memory bound: start anew; nodes are computed again when needed."""
        if len(self.best) > self.max_nodes:
            self.reset()


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
                 max_nodes: int = MAX_NODES) -> DataFrame:
    """``doc_id, n_pretokens long, n_tokens long``, one row for each row of ``docs``.

    ``vocabulary`` is a rank file and ``pattern`` what cuts texts into pre-tokens; a pre-token's
    count is that of its best segmentation under the unigram scores. Null and empty texts have
    0 of both, a null id stays null, repeated rows are counted each. Texts are read whole where
    they are, without a shuffle; the trie of a task is bounded by ``max_nodes``.
    """
    with open(vocabulary, "rb") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # a fixed file, about 1 MB
    name = hashlib.sha256(content).hexdigest()
    added = StructType([StructField("n_pretokens", LongType()), StructField("n_tokens", LongType())])

    def step():
        def load():
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
            return CountTrie(zipf_scores(ranks), max_nodes)

        trie, cut = kept(("trie", name, max_nodes), load), regex.compile(pattern)

        def work(columns, texts):
            pretokens, tokens = [], []
            for t in texts:
                words = cut.findall(t) if t else []
                known = trie.terminal
                counts = [known[w] if w in known else trie.insert(w) for w in words]
                pretokens.append(len(words))
                tokens.append(sum(counts))
                trie.trim()
            yield [*columns, pa.array(pretokens, pa.int64()), pa.array(tokens, pa.int64())]

        return work

    return map_texts(docs, [doc_id], text, added, step)
