"""Token counts of a unigram vocabulary by dynamic programming over a trie of distinct words.

A word (with the mark that stands for the space before it) costs the number of pieces of its
most probable split. The distinct words of a batch are inserted in a trie. A node holds the
best forward score of the prefix it spells and the number of pieces of that best split; it is
worked out once, when the first word with that prefix arrives, and shared by all others. The
count at a word's last node is its token count. Documents then add up counts by word.

The vocabulary is a public piece list in rank order. Its file has ranks and no probabilities,
so piece scores follow Zipf's law by rank: log p = -log(rank + 10) - log(sum); any other scores can be passed.
A character that no piece covers costs a score below all pieces and as many tokens as it has bytes.

Scale: no shuffle and one pass. Words are counted in the task that reads them; a worker keeps
the counts of at most MEMO_WORDS words and the trie of at most TRIE_NODES nodes and drops
both when full, which costs time and changes no result.

Defined results. A null or empty text has no words and no tokens. Words of over LONG_WORD
characters are split by the same programme without the trie. Repeated rows give repeated
results; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from termforge.llm.common import resident

MARK = "▁"
MEMO_WORDS, TRIE_NODES, LONG_WORD = 400_000, 300_000, 256


def read_pieces(path: str) -> tuple[dict[str, float], float]:
    """Scores of a piece file's ordinary pieces, and the score of a single byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
    ]
    total = math.log(sum(1.0 / (rank + 10) for rank in range(len(plain))))
    scores = {piece: -math.log(rank + 10) - total for rank, piece in enumerate(plain)}
    return scores, min(scores.values()) - 10.0


class Trie:
    """Prefixes of the words seen, each with the best score and fewest-on-tie piece count of its best split."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        # Pieces by their characters from the last to the first: walked back from an end, it gives all that end there.
        self.backward: dict = {}
        for piece, score in scores.items():
            node = self.backward
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[""] = score
        self.clear()

    def clear(self) -> None:
        self.root: list = [{}, 0.0, 0]
        self.nodes = 1

    def best(self, word: str, end: int, path: list) -> tuple[float, int]:
        """Best (score, pieces) of word[:end]; path holds the nodes of its proper prefixes."""
        before = path[end - 1]
        score, pieces = before[1] + self.byte_score, before[2] + len(word[end - 1].encode())
        node, start = self.backward, end
        while start:
            start -= 1
            node = node.get(word[start])
            if node is None:
                break
            own = node.get("")
            if own is not None:
                from_here = path[start]
                s, p = from_here[1] + own, from_here[2] + 1
                if s > score or s == score and p < pieces:
                    score, pieces = s, p
        return score, pieces

    def count(self, word: str) -> int:
        """Pieces of the word's best split; inserts the word, unless it is very long."""
        keep = len(word) <= LONG_WORD
        if self.nodes > TRIE_NODES:
            self.clear()
        node = self.root
        path = [node]
        for end, char in enumerate(word, 1):
            following = node[0].get(char) if keep else None
            if following is None:
                following = [{} if keep else None, *self.best(word, end, path)]
                if keep:
                    node[0][char] = following
                    self.nodes += 1
            node = following
            path.append(node)
        return node[2]


class TokenCounter:
    def __init__(self, scores: dict[str, float], byte_score: float):
        self.trie, self.memo = Trie(scores, byte_score), {}

    def count(self, text: str | None) -> tuple[int, int]:
        """(words, tokens) of a text."""
        words = (text or "").encode().split()
        memo, total = self.memo, 0
        for word in words:
            own = memo.get(word)
            if own is None:
                own = self.trie.count(MARK + word.decode())
                if len(word) <= LONG_WORD:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[word] = own
            total += own
        return len(words), total


def _counter(path: str) -> TokenCounter:
    return resident(("tokencount", path), lambda: TokenCounter(*read_pieces(path)))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document; path: a piece file present on every executor."""

    @F.pandas_udf("n_words long, n_tokens long")
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _counter(path)
        for batch in texts:
            yield pd.DataFrame([counter.count(t if isinstance(t, str) else None) for t in batch], columns=["n_words", "n_tokens"], dtype="int64")

    return docs.select("doc_id", counts(F.col("text")).alias("c")).select("doc_id", "c.*")
