"""Round trips, reproducible draws and the distribution of segmentations."""

import math
from collections import Counter

import numpy as np
import pytest

from exonloom.llm import pieces
from exonloom.llm.tokens import mix

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def known():
    return pieces.load(PATH)


def encoded(v, texts, keys=None):
    bodies = [t.encode() for t in texts]
    keys = mix(np.arange(len(texts)) if keys is None else np.array(keys))
    ids, n = pieces.encode_slice(v, b"".join(bodies), np.array([len(b) for b in bodies]), keys)
    ends = np.cumsum(n)
    return [ids[e - m : e].tolist() for e, m in zip(ends, n)]


def tiny():
    words = ["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "▁▁"]
    return pieces.Vocabulary([(i + 256, w, -math.log(i + 2)) for i, w in enumerate(words)], list(range(256)), 256 + len(words)), words


@pytest.mark.parametrize("text", ["abab", "ba  ab", " a", "acb"])
def test_distribution_against_all_segmentations(text):
    v, words = tiny()
    weight = {w: 1 / (i + 2) for i, w in enumerate(words)}
    code = {w: i + 256 for i, w in enumerate(words)}

    def all_of(s):
        if not s:
            yield (), 1.0
            return
        for k in range(1, len(s) + 1):
            if s[:k] in weight:
                for rest, p in all_of(s[k:]):
                    yield (code[s[:k]], *rest), p * weight[s[:k]]
        if s[0] not in weight:
            for rest, p in all_of(s[1:]):
                yield (*s[0].encode(), *rest), p

    want = Counter()
    for ids, p in all_of("▁" + text.replace(" ", "▁")):
        want[ids] += p
    total = sum(want.values())
    n = 20000
    got = Counter(map(tuple, encoded(v, [text] * n)))
    assert set(got) <= set(want)
    for ids, p in want.items():
        p /= total
        assert abs(got[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_round_trips(spark, known):
    texts = [None, "", " ", "  ", "▁", "a▁b ▁ c", "tab\tnew\nline\r\n", "😀 naïve 日本語 \x00\x01", "x" * 5000, ("word and " * 20000), "é", "  two  spaces  ", " ﻿"]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "null key", 1), (3, "  ", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces int").repartition(3)
    assert all(r["lossless"] for r in pieces.encode(docs, known, check=True).collect())
    got = pieces.decode(pieces.encode(docs, known), known).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["decoded"] == (r["text"] or "")
        assert (len(r["pieces"]) == 0) == (not r["text"])
    assert [r["pieces"] for r in got if r["doc_id"] == 3][0] == [r["pieces"] for r in got if r["doc_id"] == 3][1]
    assert pieces.encode(docs.limit(0), known).count() == 0


def test_draws_do_not_depend_on_company_and_differ_by_key(known):
    texts = [f"there is some text number {i} in the other place" for i in range(50)]
    whole = encoded(known, texts)
    assert whole[20:] == encoded(known, texts[20:], range(20, 50))
    assert len({tuple(x) for x in encoded(known, ["there is some text in the other place"] * 50)}) > 5


def test_pieces_spell_the_text(known):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text, ids in zip(["The quick brown fox", "naïve 😀"], encoded(known, ["The quick brown fox", "naïve 😀"])):
        assert model.decode(ids) == text


def test_a_difference_is_seen():
    a, b = np.frombuffer(b"abcd", np.uint8), np.frombuffer(b"abxd", np.uint8)
    two = np.array([2, 2])
    assert pieces.same_texts(a, two, a, two).all() and pieces.same_texts(a, two, b, two).tolist() == [True, False]
    assert pieces.same_texts(a, two, a, np.array([1, 3])).tolist() == [False, False]


def test_a_mark_inside_a_piece_is_refused():
    with pytest.raises(ValueError, match="inside"):
        pieces.Vocabulary([(256, "a▁b", 0.0)], list(range(256)), 257)
