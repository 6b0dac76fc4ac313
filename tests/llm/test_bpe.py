"""The transducer against the tokenizers library, and its decoder."""

import random

import pytest

from gleanbin.llm import bpe_stream as B
from gleanbin.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return B.Codec(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


PIECES = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "re", "é", "日本", "1", "23", "--", "---", "!", "fund", "amental", "<|endoftext|>", "\u00a0", "\u2028", "🙂", " the", "ing", "'ll", "=", "\x1c", "\u200b", "ß"]


def same(codec, library, text):
    ids = [x for part in codec.encode(text) for x in part]
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == want, text[:80]
    assert "".join(codec.decode([ids])) == library.decode(want, skip_special_tokens=False)


def test_short_texts(codec, library):
    rng = random.Random(1)
    for _ in range(1500):
        same(codec, library, "".join(rng.choice(PIECES) for _ in range(rng.randrange(40))))


@pytest.mark.parametrize("unit", ["a", " ", "\n", "-", "1", "é", "ab", " a", "a'", "'s", "fundamental", "\u00a0 "])
def test_long_runs(codec, library, unit):
    for text in (unit * (70_000 // len(unit)), "x " + unit * (70_000 // len(unit)) + "y z"):
        same(codec, library, text)


def test_long_mixtures(codec, library):
    rng = random.Random(2)
    for k in range(4):
        some = rng.sample(PIECES, 1 + 3 * k)
        same(codec, library, "".join(rng.choice(some) for _ in range(50_000)))


def test_a_piece_fed_byte_by_byte_holds_a_window_only(codec):
    word = "".join(random.Random(3).choice("abcdefing-") for _ in range(30_000)).encode()
    piece, out = B.PieceTransducer(codec.table), []
    for k in range(0, len(word), 7):
        out += piece.feed(word[k : k + 7])
        assert len(piece.held) <= codec.table.window + 7
    assert out + piece.finish() == codec.table.merge(word)


def test_lookahead_is_sufficient(codec):
    """Tokens further than the lookahead from the end never change, whatever follows."""
    rng = random.Random(4)
    t = codec.table
    for _ in range(15):
        word = "".join(rng.choice(["fund", "amental", "ing", "er", "-", "s", "=", "the"]) for _ in range(500)).encode()
        whole, at = t.merge(word), 0
        short = t.merge(word[: len(word) // 2])
        for a, b in zip(whole, short):
            at += len(t.tokens[b])
            if at > len(word) // 2 - t.lookahead:
                break
            assert a == b


def test_decoder_state_across_characters():
    machine = B.ByteTextMachine()
    out = "".join(machine.feed(bytes([b])) for b in "é🙂x".encode() + b"\xff\xe2\x82") + machine.finish()
    assert out == "é🙂x\ufffd\ufffd" and B.ByteTextMachine().feed(b"\xe2\x82") == ""


def test_caches_stay_bounded(library):
    small = B.Codec(PATH, remembered=50)
    rng = random.Random(5)
    for _ in range(60):
        same(small, library, " ".join(f"w{rng.randrange(10_000)}" for _ in range(30)))
        assert len(small.words) <= 50 + 30 and len(small.parts) <= 100 + 30


def test_table_cases(spark):
    import hashlib

    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "q" * 9000, None)], "doc_id long, text string, n_tokens string")
    got = B.digests(d, PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got)[1:4] == [(1, 0), (2, 0), (3, 2)] and len(got) == 5
    assert {r["ids_sha256"] for r in got if r["doc_id"] in (1, 2)} == {empty} == {r["decoded_sha256"] for r in got if r["doc_id"] in (1, 2)}
    assert B.digests(d.limit(0), PATH).count() == 0
