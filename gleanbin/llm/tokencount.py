"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The model's pieces are the byte strings of a ranked vocabulary; the piece of rank r scores -ln(r + 2), as ranks stand for
frequency by Zipf's law (nothing is trained). A pre-token's count is that of its best-scoring segmentation; ties go to
fewer pieces. Distinct pre-tokens are inserted in a trie of bytes; each node holds the forward score and the piece count
of its prefix, computed once from its ancestors when the node is made, so pre-tokens share all that they begin with. The
node where a pre-token ends gives its count, which is stored with it. Trie and stored counts are of bounded size: full
ones are dropped and grow anew, and where a very long pre-token fills the trie, its further prefixes are scored without
nodes; only as many scores as the longest piece has bytes are looked back at.

Defined cases: null text is empty (0 and 0); bytes that are not UTF-8 are read as U+FFFD; every byte is a piece, so any
text can be segmented; repeated rows give repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanbin.llm.bpe_stream import PATTERN, simple_parts
from gleanbin.llm.common import give_back

#: Nodes and stored counts at most; scores of a pre-token's prefixes that are held beyond those still needed.
NODES, STORED, HELD = 400_000, 600_000, 4096


class Unigram:
    """Pieces with scores, and the suffixes of pieces, which end the look back."""

    def __init__(self, ranks: dict[bytes, int]):
        self.score = {piece: -math.log(r + 2) for piece, r in ranks.items()}
        self.suffixes = {piece[k:] for piece in ranks for k in range(len(piece))}
        self.longest = max(map(len, ranks), default=1)

    @classmethod
    def from_tiktoken(cls, path: str) -> "Unigram":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Trie:
    """Forward scores by shared prefix; node 0 is the empty prefix."""

    def __init__(self, model: Unigram):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def count_of(self, word: bytes) -> int:
        """Pieces of the best segmentation of word, which is inserted as far as there is room."""
        if len(self.best) > NODES:
            self.clear()
        return self._walk(word, 0)

    def streamed(self, word: bytes) -> int:
        """The same with no node made or read."""
        return self._walk(word, -1)

    def _walk(self, word: bytes, node: int) -> int:
        """Scores of word's prefixes, of which as many as the longest piece has bytes are held; node -1 is none."""
        child, best, count = self.child, self.best, self.count
        score, suffixes, longest = self.model.score.get, self.model.suffixes, self.model.longest
        tops, leasts, base = [0.0], [0], 0  # of the prefixes from base bytes on
        for d, byte in enumerate(word, 1):
            step = child.get(node << 8 | byte, -1) if node >= 0 else -1
            if step >= 0:
                top, least = best[step], count[step]
            else:
                top, least = -math.inf, 0
                for a in range(d - 1, max(-1, d - longest - 1), -1):
                    piece = word[a:d]
                    if piece not in suffixes:
                        break
                    s = score(piece)
                    if s is not None:
                        s += tops[a - base]
                        n = leasts[a - base] + 1
                        if s > top or s == top and n < least:
                            top, least = s, n
                if node >= 0 and len(best) <= NODES:
                    step = child[node << 8 | byte] = len(best)
                    best.append(top)
                    count.append(least)
            node = step
            tops.append(top)
            leasts.append(least)
            if len(tops) > HELD + longest:
                del tops[:HELD], leasts[:HELD]
                base += HELD
        return leasts[-1]


class Stored(dict):
    """(pre-tokens, tokens) of what stands between gaps, of bounded size."""

    def __init__(self, trie: Trie, pattern):
        super().__init__()
        self.trie, self.pattern = trie, pattern

    def __missing__(self, part: str) -> tuple[int, int]:
        words = self.pattern.findall(part if part[0] == "\n" else " " + part)
        found = len(words), sum(self.trie.count_of(w.encode()) for w in words)
        if len(part) <= 200:
            if len(self) > STORED:
                self.clear()
            self[part] = found
        return found


class Counter:
    def __init__(self, model: Unigram):
        self.trie, self.pattern = Trie(model), regex.compile(PATTERN)
        self.stored = Stored(self.trie, self.pattern)

    def counts(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a whole text."""
        first, rest = simple_parts(text)
        n = total = 0
        for m in self.pattern.finditer(first):
            n += 1
            total += self.trie.count_of(m.group().encode())
        for a, b in map(self.stored.__getitem__, rest):
            n += a
            total += b
        return n, total


@cache
def counter(path: str) -> Counter:
    """One a worker."""
    return Counter(Unigram.from_tiktoken(path))


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            rows = [c.counts((x.as_py() or b"").decode("utf-8", "replace")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])
        c.trie.clear()  # workers stay for later stages
        c.stored.clear()
        give_back()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
