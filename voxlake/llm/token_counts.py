"""Token counts under a unigram model, by dynamic programming shared over a trie.

A pre-token's best segmentation maximises the sum of its tokens' scores. Forward
scores depend on the prefix alone, so the distinct pre-tokens are put into a
trie: the score and token count of a prefix are computed when its node is made,
once for all words that share it, and a word's count is read at its terminal.
"""

from __future__ import annotations

import base64
import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame

from voxlake.llm.bpe import BYTE_PIECES, UNUSUAL
from voxlake.llm.shared import columns, doc_texts, map_rows, tokenizer_json

#: Scores are integers in steps of 2**-20, so sums and ties are exact.
STEP = 1 << 20
#: Terminal counts kept by a process, and trie nodes; emptied when full.
WORDS, NODES = 600_000, 600_000


class UnigramTrie:
    """Forward scores of byte prefixes under scores by rank: log p ~ -log(rank + 2)."""

    def __init__(self, ranks: str):
        self.step: dict[int, int] = {}
        self.score: list[int | None] = [None]
        for line in ranks.splitlines():
            token, rank = line.split()
            node = 0
            for byte in reversed(base64.b64decode(token)):
                key = node << 8 | byte
                node = self.step.get(key) or self._backward_node(key)
            self.score[node] = -round(STEP * math.log(int(rank) + 2))
        self.terminal: dict[str, int] = {}
        self._empty_trie()

    def _backward_node(self, key: int) -> int:
        self.score.append(None)
        self.step[key] = len(self.score) - 1
        return self.step[key]

    def _empty_trie(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0], [0]  # by node; the root is the empty prefix

    def insert(self, word: str) -> int:
        """Token count of a word. Forward scores are computed for new nodes only."""
        data = word.encode()
        path, node, child, best, count, step, score = [0], 0, self.child, self.best, self.count, self.step, self.score
        for i, byte in enumerate(data):
            key = node << 8 | byte
            node = child.get(key, -1)
            if node < 0:
                most, fewest, back = None, 0, 0
                for j in range(i, -1, -1):
                    back = step.get(back << 8 | data[j], -1)
                    if back < 0:
                        break
                    own = score[back]
                    if own is not None:
                        total, n = best[path[j]] + own, count[path[j]] + 1
                        if most is None or total > most or total == most and n < fewest:
                            most, fewest = total, n
                node = child[key] = len(best)
                best.append(most)
                count.append(fewest)
            path.append(node)
        if len(best) > NODES:
            self._empty_trie()
        return self.count[path[-1]] if path[-1] < len(self.count) else count[path[-1]]

    def tokens(self, words: list[str]) -> int:
        terminal, total = self.terminal, 0
        for word in words:
            n = terminal.get(word)
            if n is None:
                if len(terminal) >= WORDS:
                    terminal.clear()
                n = terminal[word] = self.insert(word)
            total += n
        return total


@functools.lru_cache(maxsize=2)
def trie(ranks: str) -> UnigramTrie:
    return UnigramTrie(ranks)


@functools.lru_cache(maxsize=1)
def _any_text():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def pieces(text: str) -> list[str]:
    """Pre-tokens; their concatenation is the text."""
    return _any_text().findall(text) if UNUSUAL.search(text) else BYTE_PIECES.findall(text)


def token_counts(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, n_pieces, n_bytes of every document.

    ranks: a rank file whose tokens include every single byte. Ties in score go
    to fewer tokens. Null and empty texts count zero; repeated rows and rows
    without doc_id give one row each; other columns are ignored; an empty table
    gives no rows. Texts of any length are counted whole.
    """
    listing = docs.sparkSession.sparkContext.broadcast(tokenizer_json(ranks))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, n, split, size = trie(listing.value), [], [], []
        for text in batch["text"].to_pylist():
            words = pieces(text)
            n.append(model.tokens(words))
            split.append(len(words))
            size.append(len(text.encode()))
        return columns(doc_id=batch["doc_id"], n_tokens=pa.array(n, pa.int64()), n_pieces=pa.array(split, pa.int64()), n_bytes=pa.array(size, pa.int64()))

    return map_rows(doc_texts(docs), part, "doc_id long, n_tokens long, n_pieces long, n_bytes long")
