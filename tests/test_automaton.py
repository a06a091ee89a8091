"""The automaton against plain searches, at any length of its stretches."""

import random
import re

import numpy as np
import pytest

from exonloom.operators import automaton, motifs


def laid(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def plain(texts, words):
    return sorted((i, j, m.start()) for i, t in enumerate(texts) for j, w in enumerate(words) for m in re.finditer(re.escape(w), t))


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("shortest", [1, 5, 256])
def test_against_plain_searches(seed, shortest, monkeypatch):
    monkeypatch.setattr(automaton, "SHORTEST", shortest)
    rng = random.Random(seed)
    letters = rng.choice(["AC", "ACGT", "aé日"])
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(40)})
    texts = ["".join(rng.choice(letters + "x") for _ in range(rng.choice([0, 3, 50, 400]))) for _ in range(12)]
    data, offsets = laid(texts)
    made = automaton.Automaton([w.encode() for w in words])
    where, motif, start = made.hits(data, offsets)
    start = automaton.code_points(data, offsets, where, start)
    assert sorted(zip(where.tolist(), motif.tolist(), start.tolist())) == plain(texts, words)
    where, motif, start = made.occurrences(data, offsets)
    overlapping = sorted((i, j, k) for i, t in enumerate(texts) for j, w in enumerate(words) for k in range(len(t)) if t.startswith(w, k))
    assert sorted(zip(where.tolist(), motif.tolist(), automaton.code_points(data, offsets, where, start).tolist())) == overlapping


def test_no_motifs_no_texts_and_empty_motifs():
    data, offsets = laid(["abc", ""])
    assert all(len(x) == 0 for x in automaton.Automaton([]).hits(data, offsets))
    assert all(len(x) == 0 for x in automaton.Automaton([b"a"]).hits(*laid([])))
    with pytest.raises(ValueError):
        automaton.Automaton([b""])


def test_thousands_of_motifs_equal_the_join(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("ACGT") for _ in range(rng.randint(5, 8))) for _ in range(3000)}
    names = spark.createDataFrame([(f"R{i % 7}", w) for i, w in enumerate(sorted(words))] + [("R9", "AAAAA"), (None, None)], "rbp_name string, motif string")
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 4, 900, 3000)] + ["A" * 50, None]
    seqs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "seq_id string, seq string")
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(motifs.scan_by_join(seqs, names))
    assert rows(motifs.scan_exact(seqs, names)) == want == rows(motifs.scan_exact(seqs, names, limit=700))
