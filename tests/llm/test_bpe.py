"""Ids and texts against the tokenizers library, hand-made vocabularies against plain merging."""

import random
from itertools import product

import numpy as np
import pytest
from tokenizers import Tokenizer

from exonloom.llm import bpe

FILES = ["/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/byte_bpe_50k.json"]
BITS = [
    "a", "aa", "ab", "the", "ing", "é", "é", "Σ", "ς", "İ", "ß", "日本", "́", "🙂", "1", "22", "!", "'s", "'S", "'LL", " ", "  ", "\n", "\t", "\x0b",
    "\x1c", "\x85", "\xa0", "　", "​", "\x00", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "</w>", "<|", "x" * 9,
]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    return bpe.load(request.param), Tokenizer.from_file(request.param)


def test_mixed_texts_equal_the_library(both):
    mine, theirs = both
    draw = random.Random(3)
    encoder = mine.encoder()
    for _ in range(1500):
        text = "".join(draw.choice(BITS) for _ in range(draw.randint(0, 25)))
        assert list(encoder.text(text.encode())) == theirs.encode(text, add_special_tokens=False).ids, repr(text)


def test_small_memories_change_nothing(both, monkeypatch):
    mine, theirs = both
    for name, value in (("REMEMBERED", 7), ("SLICE_BYTES", 16), ("AT_ONCE", 3), ("TOGETHER", 4)):
        monkeypatch.setattr(bpe, name, value)
    draw = random.Random(5)
    encoder = bpe.Encoder(mine)
    texts = ["".join(draw.choice(BITS) for _ in range(draw.randint(0, 60))) for _ in range(60)]
    for i in range(0, len(texts), 6):
        got = encoder.texts([t.encode() for t in texts[i : i + 6]])
        assert [np.frombuffer(g, np.int32).tolist() for g in got] == [e.ids for e in theirs.encode_batch(texts[i : i + 6], add_special_tokens=False)]


def test_long_words_and_texts_equal_the_library(both):
    mine, theirs = both
    draw = random.Random(4)
    texts = ["a" * 5000, "abababa" * 900, "!?" * 3000, "".join(draw.choice("abcdeinorst") for _ in range(6000)), "one two  three\n" * 150_000]
    for text in texts:
        assert list(mine.encoder().text(text.encode())) == theirs.encode(text, add_special_tokens=False).ids


def plain_merge(merges, letters):
    """The textbook loop: the lowest merge, leftmost first."""
    rank = {m: i for i, m in enumerate(merges)}
    word = list(letters)
    while True:
        found = min(((rank[p], i) for i, p in enumerate(zip(word, word[1:])) if p in rank), default=None)
        if found is None:
            return word
        i = found[1]
        word[i : i + 2] = [word[i] + word[i + 1]]


@pytest.mark.parametrize("merges", [
    [("a", "a"), ("aa", "a"), ("b", "a"), ("aa", "ba")],
    [("a", "b"), ("b", "a"), ("ab", "ab"), ("ba", "b"), ("abab", "a")],
    [("b", "c"), ("a", "bc"), ("a", "b"), ("ab", "abc"), ("c", "c"), ("cc", "cc")],
    [("a", "a"), ("aa", "aa"), ("aaaa", "aaaa"), ("aaaa", "a"), ("b", "aaaaa")],
])
def test_small_vocabularies_against_plain_merging(merges):
    letters = bpe.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
    config = {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}, "version": "1.0"}
    encoder = bpe.Vocabulary(config).encoder()
    for n in range(1, 9):
        for word in map("".join, product("abc" if n < 7 else "ab", repeat=n)):
            want = np.array([vocab[t] for t in plain_merge(merges, word)], np.int32).tobytes()
            assert encoder.word(word) == want and encoder.together([word, "a", word]) == [want, encoder.word("a"), want], word


def test_a_merge_before_its_parts_is_refused():
    vocab = {c: i for i, c in enumerate(bpe.byte_letters())} | {"abc": 256, "ab": 257}
    with pytest.raises(ValueError, match="does not follow"):
        bpe.Vocabulary({"model": {"type": "BPE", "vocab": vocab, "merges": [["ab", "c"], ["a", "b"]]}, "pre_tokenizer": {"type": "ByteLevel"}})


def test_rows_nulls_clashing_names_and_repeats(spark, both):
    mine, theirs = both
    texts = ["Hello  World's", None, "", "Hello  World's", "é <|endoftext|> x", " "]
    rows = spark.createDataFrame([(i, t, i * 2, "b") for i, t in enumerate(texts)], "doc_id int, text string, ids int, Body string")
    got = bpe.decode(bpe.encode(rows, mine), mine).orderBy("doc_id").collect()
    assert [r["Body"] for r in got] == ["b"] * 6 and [r["text"] for r in got] == texts
    for r, text in zip(got, texts):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == theirs.decode(ids, skip_special_tokens=False)


def test_decode_passes_over_nulls_and_unknown_ids(spark, both):
    mine, theirs = both
    rows = spark.createDataFrame([(1, [320, None, 9_999_999, -1, 321]), (2, None), (3, [])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode(rows, mine).collect()}
    assert got == {1: theirs.decode([320, 321], skip_special_tokens=False), 2: "", 3: ""}


def test_empty_table(spark, both):
    rows = spark.createDataFrame([], "doc_id int, text string")
    assert bpe.decode(bpe.encode(rows, both[0]), both[0]).collect() == []
