"""Byte-pair encoding and decoding as a bounded-lookahead streaming transducer.

A boundary between two tokens can only move if a merge further right takes part of what stands left of it. Merges apply
in rank order, so such influence runs along a chain of merges of falling rank, each starting where the right half of
the one before ends. The longest chain, in bytes, is the merge list's sufficient lookahead; it is computed once from the
merges (827 bytes for the 50k list). Bytes further than that before the end of what has been read can't change any
more: their tokens are emitted, and only a window of the input stays in memory. Every text, short or long, is fed to the
one encoder in slices, and every pre-token to the one transducer; what it gave for a pre-token is remembered, in caches of
fixed size.

Decoding is an incremental state machine from bytes to text: it holds back at most three bytes of a character that is
not complete; invalid bytes become U+FFFD as in lossy UTF-8.

Defined cases: null text counts as empty (0 tokens, digests of the empty string); the strings of added tokens in a text
become their ids, as the tokenizers library has it; bytes that are not UTF-8 are read as U+FFFD; repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanbin.llm.common import give_back

#: Fixed value: the pre-token pattern of the public byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a slice, in which texts are fed to the encoder.
SLICE = 1 << 16
#: Distinct pre-tokens that a worker remembers in each of two generations; twice as many parts between gaps; characters of
#: what is remembered at most.
REMEMBERED, LONGEST_REMEMBERED = 100_000, 200
NO_MERGE = 1 << 30


def printable_bytes() -> dict[str, int]:
    """The stand-in characters of a byte-level vocabulary: printable Latin-1 stands for itself, the rest for U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeTable:
    """A merge list with its tokens as bytes and its sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = printable_bytes(), spec["model"]["vocab"]
        raw = lambda token: bytes(chars[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, k in vocab.items():
            self.tokens[k] = raw(token)
        for token, k in self.added.items():
            self.tokens[k] = token.encode()
        self.byte_id = [vocab[c] for c in sorted(chars, key=chars.get)]
        self.pairs: dict[int, int] = {}
        self.merged: list[int] = []
        reach: dict[bytes, int] = {}
        self.lookahead = 1
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append(vocab[a + b])
            left, right = raw(a), raw(b)
            # how far right of this pair the text can decide whether it merges, plus the pair's own right half
            far = len(right) + max(reach.get(right[k:], 0) for k in range(len(right)))
            reach[left] = max(reach.get(left, 0), far)
            self.lookahead = max(self.lookahead, far)
        self.longest = max(map(len, self.tokens))
        self.window = 4 * (self.lookahead + self.longest)

    def merge(self, data: bytes) -> list[int]:
        """The tokens of data, taken as a whole pre-token."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > 96:
            return self._merge_heap(ids)
        get, merged = self.pairs.get, self.merged
        ranks = [get(a << 20 | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_MERGE:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [merged[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NO_MERGE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NO_MERGE)
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < n and (r := get(ids[k] << 20 | ids[m])) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[m]))
        return [x for x in ids if x >= 0]


class PieceTransducer:
    """One pre-token, fed in pieces: emits tokens once they are stable."""

    def __init__(self, table: MergeTable):
        self.table, self.held = table, b""

    def feed(self, data: bytes) -> list[int]:
        t, out = self.table, []
        self.held += data
        start = 0
        while len(self.held) - start >= t.window:
            at, stable = 0, t.window - t.lookahead
            for k in t.merge(self.held[start : start + t.window]):
                if at + len(t.tokens[k]) > stable:
                    break
                out.append(k)
                at += len(t.tokens[k])
            start += at
        self.held = self.held[start:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.table.merge(self.held), b""
        return out


class Remembered(dict):
    """Tokens by pre-token, of bounded size: the older generation goes when the younger is full."""

    def __init__(self, table: MergeTable, most: int = REMEMBERED):
        super().__init__()
        self.table, self.most, self.older = table, most, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.older.get(word)
        if found is None:
            piece = PieceTransducer(self.table)
            found = tuple(piece.feed(word.encode()) + piece.finish())
            if len(word) > LONGEST_REMEMBERED:
                return found
        self[word] = found
        return found

    def trim(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class RememberedParts(Remembered):
    """Tokens of what stands between two spaces (its space included) or, with its line break, begins a line."""

    def __init__(self, words: Remembered, pattern, most: int = REMEMBERED):
        super().__init__(words.table, most)
        self.words, self.pattern = words, pattern

    def __missing__(self, part: str) -> tuple[int, ...]:
        found = self.older.get(part)
        if found is None:
            found = tuple(chain.from_iterable(map(self.words.__getitem__, self.pattern.findall(part if part[0] == "\n" else " " + part))))
            if len(part) > LONGEST_REMEMBERED:
                return found
        self[part] = found
        return found


#: Gaps of more than one space or line break, and white space of other kinds.
LONG_GAPS = ["  ", "\n ", " \n", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f"]
OTHER_SPACE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
CLASSES = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "O": regex.compile(r"[^\s\p{L}\p{N}]*")}


#: The last end of a word before a gap, searched from the right.
LAST_GAP = regex.compile(r"(?r)\S(?=\s)")


class StreamEncoder:
    """Encodes a text fed in slices, with constant memory; added tokens are taken out before.

    Of what was fed, pre-tokens that can still grow are held back; all before them go through the transducer, whose
    tokens for a pre-token are remembered once stable.
    """

    def __init__(self, table: MergeTable, remembered: Remembered | None = None, parts: RememberedParts | None = None):
        self.table, self.words = table, remembered if remembered is not None else Remembered(table)
        self.pattern = regex.compile(PATTERN)
        self.parts = parts if parts is not None else RememberedParts(self.words, self.pattern)
        self.held, self.open, self.kind = "", None, ""

    def _stable(self, text: str) -> list[int]:
        """The tokens of whole pre-tokens."""
        first, rest = simple_parts(text)
        out = list(chain.from_iterable(map(self.words.__getitem__, self.pattern.findall(first))))
        out.extend(chain.from_iterable(map(self.parts.__getitem__, rest)))
        self.words.trim()
        self.parts.trim()
        return out

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        text, self.held = self.held + text, ""
        if self.open:  # a pre-token longer than the window goes on
            end = CLASSES[self.kind].match(text).end()
            out += self.open.feed(text[:end].encode())
            if end == len(text):
                return out
            out += self.open.finish()
            self.open, text = None, text[end:]
        gap = LAST_GAP.search(text, max(0, len(text) - 4096))
        cut = gap.end() if gap else 0
        if not cut and len(text) > SLICE // 4:  # no gap near the end: all but what touches the end, or a contraction, is stable
            spans = [m.span() for m in self.pattern.finditer(text)]
            while spans and spans[-1][1] > len(text) - 4:
                cut = spans.pop()[0]
            tail = text[cut:]
            body = tail[1:] if tail[:1] == " " else tail
            kind = next((k for k, p in CLASSES.items() if body and p.match(body).end() == len(body)), "")
            if kind and len(tail) > self.table.window and not spans_contraction(text, cut):
                out += chain.from_iterable(map(self.words.__getitem__, (text[a:b] for a, b in spans)))
                self.open, self.kind = PieceTransducer(self.table), kind
                return out + self.open.feed(tail.encode())
        if cut:
            out += self._stable(text[:cut])
        self.held = text[cut:]
        return out

    def finish(self) -> list[int]:
        out = self.open.finish() if self.open else []
        out += chain.from_iterable(map(self.words.__getitem__, self.pattern.findall(self.held)))
        self.held, self.open = "", None
        return out


def spans_contraction(text: str, cut: int) -> bool:
    """Whether an apostrophe just before the cut could still claim what follows."""
    return "'" in text[max(0, cut - 1) : cut + 1]


class ByteTextMachine:
    """Bytes to text, piece by piece; the state is the start of a character that is not complete."""

    def __init__(self):
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def simple_parts(text: str) -> tuple[str, list[str]]:
    """A text whose every gap is one space or one line break, as its first word and the parts that begin with a gap.

    A space is left out, a line break stays. Pre-tokens never span the end of a word before a gap, so parts can be looked
    at one by one. Any other text comes back whole, with no parts.
    """
    if not text or text[0].isspace() or text[-1] in " \n" or any(gap in text for gap in LONG_GAPS) or not text.isascii() and OTHER_SPACE.search(text):
        return text, []
    first, *rest = text.replace("\n", " \n").split(" ")
    return first, rest


class Codec:
    """encode() and decode() of whole texts over the streaming parts."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.table = MergeTable(path)
        self.words = Remembered(self.table, remembered)
        self.pattern = regex.compile(PATTERN)
        self.parts = RememberedParts(self.words, self.pattern, 2 * remembered)
        self.added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.table.added, key=len, reverse=True)) + ")") if self.table.added else None
        self.names = [str(k) for k in range(len(self.table.tokens))]

    def _plain(self, text: str) -> Iterator[list[int]]:
        encoder = StreamEncoder(self.table, self.words, self.parts)
        for k in range(0, len(text), SLICE):
            yield encoder.feed(text[k : k + SLICE])
        yield encoder.finish()

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids in pieces, each as soon as it is stable."""
        for k, part in enumerate(self.added.split(text) if self.added and self.added.search(text) else [text]):
            if k % 2:
                yield [self.table.added[part]]
            elif part:
                yield from self._plain(part)

    def forget(self) -> None:
        """Gives up what is remembered, as workers stay for later stages."""
        for cache_ in (self.words, self.parts):
            cache_.clear()
            cache_.older = {}
        give_back()

    def decode(self, pieces) -> Iterator[str]:
        machine, get = ByteTextMachine(), self.table.tokens.__getitem__
        for ids in pieces:
            yield machine.feed(b"".join(map(get, ids)))
        yield machine.finish()

    def digest(self, text: str) -> tuple[int, str, str]:
        """n_tokens, SHA-256 of the ids joined by commas, SHA-256 of the text decoded from them; piece by piece."""
        n, ids_hash, text_hash, name = 0, hashlib.sha256(), hashlib.sha256(), self.names.__getitem__

        def pieces():
            nonlocal n
            for ids in self.encode(text):
                if ids:
                    ids_hash.update(("," if n else "").encode() + ",".join(map(name, ids)).encode())
                    n += len(ids)
                    yield ids

        for part in self.decode(pieces()):
            text_hash.update(part.encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


@cache
def codec(path: str) -> Codec:
    """One a worker."""
    return Codec(path)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = [c.digest((x.as_py() or b"").decode("utf-8", "replace")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and token_ids array<int> of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [list(chain.from_iterable(c.encode((x.as_py() or b"").decode("utf-8", "replace")))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "token_ids"])
        c.forget()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, token_ids array<int>")
