"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a word ends in one certain token.  An automaton over the vocabulary lists the tokens
that end at a prefix, longest first; the one that is compatible with the last token of the prefix before it is the
last token here, and the back pointers from the whole word spell its encoding.  Two tokens are compatible when no
merge crosses their border before both are built.  Work is linear in the length of a word, however long it is.

Text is normalised and cut into words by the parts that the tokenizer file names; only the merges are done here.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exonloom.llm import tokens

#: Words and chunks that a worker remembers at a time, in two generations: what was not met in the last one is
#: forgotten.  Token pairs that it remembers; a full memory of these is emptied.
REMEMBERED, PAIRS = 1 << 18, 1 << 20
#: Letters of a word that is encoded together with others, and words of one such step.
TOGETHER, AT_ONCE = 64, 1 << 14
#: Bytes of text that are cut into chunks at once, about; also of one output batch, and ids of one.
SLICE_BYTES, SLICE_IDS = 1 << 20, 1 << 18
NEVER = 1 << 60
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
BYTES_ONLY = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary: merges, added tokens, and the automaton of its tokens.

    ``config`` is the content of a ``tokenizers`` file.  Every merge must make another token and come after those
    that make its parts, as in any trained vocabulary; the base letters must all have ids.  ``ValueError`` else.
    """

    def __init__(self, config: dict) -> None:
        self._encoder: Encoder | None = None
        model = config["model"]
        if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("not a plain BPE vocabulary")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in config.get("added_tokens") or []):
            raise ValueError("added tokens must match the raw text as it is")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.parts = json.dumps({k: config.get(k) for k in ("version", "normalizer", "pre_tokenizer")} | {
            "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})
        if not config.get("pre_tokenizer"):
            raise ValueError("the file names no way to cut words")
        split = config["pre_tokenizer"].get("pretokenizers", [{}])[0]
        self.spaces_dropped = split.get("type") == "Split" and split.get("behavior") == "Removed" and bool(split.get("invert"))
        self.pattern = split["pattern"].get("Regex") if self.spaces_dropped else None
        if config["pre_tokenizer"].get("pretokenizers", [])[1:] != [BYTES_ONLY]:
            self.pattern = None
        self.joined_bytes = (config.get("decoder") or {}).get("type") == "ByteLevel"
        if config.get("decoder") and not self.joined_bytes:
            raise ValueError("unknown decoder")
        vocab = model["vocab"]
        self.added = {a["content"].encode(): a["id"] for a in config.get("added_tokens") or []}
        self.written = {i: w for w, i in vocab.items()} | {i: w.decode() for w, i in self.added.items()}
        letters = byte_letters()
        self.code = {c: k for k, c in enumerate(letters)}
        base = letters + [c + self.suffix for c in letters if self.suffix]
        if missing := [c for c in base if c not in vocab]:
            raise ValueError(f"{len(missing)} base letters have no id")
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank = {vocab[c]: -1 for c in base}
        spelt = {vocab[c]: (k,) for k, c in enumerate(base)}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            if made in self.rank or a not in self.rank or b not in self.rank:
                raise ValueError(f"merge {r} does not follow those of its parts, or makes a token again")
            self.pair[a, b], self.halves[made], self.rank[made] = r, (a, b), r
            spelt[made] = spelt[a] + spelt[b]
        sound = {t for t in spelt if t not in self.halves}
        for t, (a, b) in self.halves.items():  # in order of rank
            if a in sound and b in sound and not self._crossed(a, b, whole=False):
                sound.add(t)
        self._build({t: s for t, s in spelt.items() if t in sound})

    def _build(self, spelt: dict[int, tuple[int, ...]]) -> None:
        """Trie with failure links: per node the token that ends there, and the next shorter suffix that is a token."""
        self.step: dict[int, int] = {}
        self.token, self.size, parents = [-1], [0], [(0, 0)]
        for t, letters in sorted(spelt.items(), key=lambda x: len(x[1])):
            node = 0
            for letter in letters:
                at = node << 9 | letter
                if at not in self.step:
                    self.step[at] = len(self.token)
                    self.token.append(-1)
                    self.size.append(self.size[node] + 1)
                    parents.append((node, letter))
                node = self.step[at]
            self.token[node] = t
        self.fail = [0] * len(self.token)
        self.shorter = [0] * len(self.token)
        for node in sorted(range(1, len(self.token)), key=self.size.__getitem__):
            parent, letter = parents[node]
            if parent:
                self.fail[node] = self._go(self.fail[parent], letter)
            f = self.fail[node]
            self.shorter[node] = f if self.token[f] >= 0 else self.shorter[f]

    def _go(self, node: int, letter: int) -> int:
        while True:
            found = self.step.get(node << 9 | letter)
            if found is not None or not node:
                return found or 0
            node = self.fail[node]

    def _edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """The tokens that lie at one edge of ``t`` while it is built, each with the rank of the merge that ends it."""
        out = [(t, NEVER)]
        while t in self.halves:
            t, r = self.halves[t][side], self.rank[t]
            out.append((t, r))
        return out

    def _crossed(self, a: int, b: int, whole: bool = True) -> bool:
        """Whether a merge crosses the border of ``a`` and ``b`` while they are built, or (``whole``) after.

        Of equal merges the one further left comes first.
        """
        right = self._edge(b, 0)
        for x, until in self._edge(a, 1):
            for y, till in right:
                if not whole and until == till == NEVER:
                    continue
                r = self.pair.get((x, y))
                if r is not None and r < until and r <= till:
                    return True
        return False

    def encoder(self) -> Encoder:
        """The encoder of this vocabulary; a worker keeps it, and what it remembers, from task to task."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    def __getstate__(self) -> dict:
        return vars(self) | {"_encoder": None}


class Encoder:
    """Encodes texts with a vocabulary; remembers chunks, words and pairs within bounds."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        from tokenizers import Tokenizer

        self.v = v = vocabulary
        parts = Tokenizer.from_str(v.parts)
        self.normal, self.cut = parts.normalizer, parts.pre_tokenizer
        added = sorted(v.added, key=len, reverse=True)
        self.special = re.compile(b"(" + b"|".join(map(re.escape, added)) + b")") if added else None
        # the file's own pattern for ASCII, where all libraries agree on classes; a space ends a chunk
        self.ascii_words = regex.compile(f"(?:{v.pattern})| ") if v.pattern else None
        self.printed = {i: c for i, c in enumerate(byte_letters()) if chr(i) != c}
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_chunks: dict[bytes, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.pairs, self.fits = np.zeros(1, np.int64) - 1, np.zeros(1, bool)  # sorted
        keys = np.fromiter(v.step.keys(), np.int64, len(v.step))
        order = np.argsort(keys)
        self.edges, self.ends = keys[order], np.fromiter(v.step.values(), np.int32, len(v.step))[order]
        self.token, self.size, self.fail, self.shorter = (np.array(x, np.int32) for x in (v.token, v.size, v.fail, v.shorter))
        self.letter = np.zeros(512, np.int32)
        self.letter[[ord(c) for c in v.code]] = list(v.code.values())

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each token of ``a`` may stand before that of ``b``."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.pairs, key).clip(0, len(self.pairs) - 1)
        new = self.pairs[at] != key
        if new.any():
            if len(self.pairs) > PAIRS:
                self.pairs, self.fits = self.pairs[:1], self.fits[:1]
                return self.compatible(a, b)
            found = np.unique(key[new])
            fits = np.array([not self.v._crossed(k >> 20, k & 0xFFFFF) for k in found.tolist()], bool)
            place = np.searchsorted(self.pairs, found)
            self.pairs, self.fits = np.insert(self.pairs, place, found), np.insert(self.fits, place, fits)
            at = np.searchsorted(self.pairs, key)
        return self.fits[at]

    def go(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The automaton's next nodes."""
        out, todo = np.zeros(len(node), np.int32), np.arange(len(node))
        while len(todo):
            key = node.astype(np.int64) << 9 | letter
            at = np.searchsorted(self.edges, key).clip(0, len(self.edges) - 1)
            found = self.edges[at] == key
            out[todo[found]] = self.ends[at[found]]
            more = ~found & (node > 0)
            todo, node, letter = todo[more], self.fail[node[more]], letter[more]
        return out

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of words of byte letters, as little-endian int32, all taken one letter further at a time."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(-sizes, kind="stable")
        n = sizes[order]
        flat = self.letter[np.frombuffer("".join(words[i] for i in order).encode("utf-16-le"), np.uint16)]
        letters = np.zeros((len(n), int(n[0])), np.int32)
        inside = np.arange(letters.shape[1]) < n[:, None]
        letters[inside] = flat
        if self.v.suffix:
            letters[np.arange(len(n)), n - 1] += 256
        last = np.zeros((len(n), letters.shape[1] + 1), np.int32)
        start = np.zeros(last.shape, np.int32)
        node = np.zeros(len(n), np.int32)
        for i in range(1, last.shape[1]):
            todo = np.arange(int(np.searchsorted(-n, -i, "right")))
            node = self.go(node[: len(todo)], letters[: len(todo), i - 1])
            at = np.where(self.token[node] >= 0, node, self.shorter[node])
            while len(todo):  # a single letter is always a token, and one of the tokens always fits
                t, j = self.token[at], i - self.size[at]
                fits = j == 0
                fits[~fits] = self.compatible(last[todo[~fits], j[~fits]], t[~fits])
                last[todo[fits], i], start[todo[fits], i] = t[fits], j[fits]
                todo, at = todo[~fits], self.shorter[at[~fits]]
        place, live, found = n.copy(), np.arange(len(n)), []
        while len(live):
            found.append((live, last[live, place[live]]))
            place[live] = start[live, place[live]]
            live = live[place[live] > 0]
        row, ids = (np.concatenate(x) for x in zip(*reversed(found)))
        by_row = np.argsort(row, kind="stable")
        ends = np.cumsum(np.bincount(row, minlength=len(n))) * 4
        data = ids[by_row].astype("<i4").tobytes()
        out = [b""] * len(n)
        for i, e, f in zip(order.tolist(), [0, *ends.tolist()], ends.tolist()):
            out[i] = data[e:f]
        return out

    def word(self, word: str) -> bytes:
        """Ids of one word of byte letters, for words too long to go with others."""
        v = self.v
        letters = [v.code[c] for c in word]
        if v.suffix:
            letters[-1] += 256
        n, node = len(letters), 0
        last, start = [0] * (n + 1), [0] * (n + 1)
        near: dict[tuple[int, int], bool] = {}
        for i, letter in enumerate(letters, 1):
            node = v._go(node, letter)
            at = node if v.token[node] >= 0 else v.shorter[node]
            while True:
                t, j = v.token[at], i - v.size[at]
                fits = not j or near.get((last[j], t))
                if fits is None:
                    fits = near[last[j], t] = not v._crossed(last[j], t)
                if fits:
                    last[i], start[i] = t, j
                    break
                at = v.shorter[at]
        out, i = array("i"), n
        while i:
            out.append(last[i])
            i = start[i]
        out.reverse()
        return out.tobytes()

    def learn(self, words: set[str]) -> None:
        """Make ``self.words`` hold all these words."""
        if len(self.words) + len(words) > REMEMBERED // 2:
            self.words, self.old_words = {}, self.words
        new = words - self.words.keys()
        again = {w: self.old_words[w] for w in new & self.old_words.keys()}
        self.words.update(again)
        new -= again.keys()
        for w in new:
            if len(w) > TOGETHER:
                self.words[w] = self.word(w)
        short = [w for w in new if len(w) <= TOGETHER]
        for i in range(0, len(short), AT_ONCE):
            part = short[i : i + AT_ONCE]
            self.words.update(zip(part, self.together(part), strict=True))

    def alone(self, chunk: bytes) -> bytes:
        """Ids of one stretch of text that is encoded apart from what stands around it."""
        out = []
        for k, part in enumerate(self.special.split(chunk) if self.special else [chunk]):
            if k % 2:
                out.append(array("i", [self.v.added[part]]).tobytes())
            elif part:
                text = part.decode("utf-8", "replace")
                words = [w for w, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(text) if self.normal else text)]
                self.learn(set(words))
                out += [self.words[w] for w in words]
        return b"".join(out)

    def fill(self, chunks: set[bytes]) -> None:
        """Make ``self.chunks`` hold all these chunks; plain ones are normalised and cut together."""
        if len(self.chunks) + len(chunks) > REMEMBERED // 2:
            self.chunks, self.old_chunks = {}, self.chunks
        new = chunks - self.chunks.keys()
        again = {c: self.old_chunks[c] for c in new & self.old_chunks.keys()}
        self.chunks.update(again)
        simple, plain = [], []
        for chunk in new - again.keys():
            if self.special and b"<" in chunk and self.special.search(chunk):
                self.chunks[chunk] = self.alone(chunk)
            elif self.ascii_words and chunk.isascii():
                simple.append(chunk)
            elif chunk.isascii() or len(chunk.decode("utf-8", "replace").split()) == 1:
                plain.append(chunk)
            else:  # wide spaces
                self.chunks[chunk] = self.alone(chunk)
        for of, cut in ((simple, self._cut_ascii), (plain, self._cut)):
            if not of:
                continue
            joined = b"\n".join(of).decode("utf-8", "replace")
            words, ends = cut(self.normal.normalize_str(joined) if self.normal else joined)
            if len(ends) != len(of) - 1:  # a normal form that adds or drops spaces
                self.chunks.update((c, self.alone(c)) for c in of)
                continue
            self.learn(set(words))
            ids = [self.words[w] for w in words]
            self.chunks.update((c, b"".join(ids[i:j])) for c, i, j in zip(of, [0, *ends], [*ends, len(ids)]))

    def _cut_ascii(self, joined: str) -> tuple[list[str], list[int]]:
        """Words of byte letters, and how many come before the end of each chunk but the last."""
        found = self.ascii_words.findall(joined)
        if not joined.isprintable():
            found = [w if w == " " else w.translate(self.printed) for w in found]
        spaces = np.flatnonzero(np.array([w == " " for w in found], bool))
        return [w for w in found if w != " "], (spaces - np.arange(len(spaces))).tolist()

    def _cut(self, joined: str) -> tuple[list[str], list[int]]:
        """The same by the library's parts."""
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        got = self.cut.pre_tokenize_str(joined)
        starts = np.array([a for _, (a, _) in got], np.int64)
        return [w for w, _ in got], np.searchsorted(starts, np.flatnonzero((points == 32) | (points == 10))).tolist()

    def texts(self, bodies: Sequence[bytes]) -> list[bytes]:
        """Ids of whole texts, as little-endian int32."""
        if not self.v.spaces_dropped:
            return [self.alone(t) for t in bodies]
        out: list[list[bytes]] = [[] for _ in bodies]
        waiting, size = [], 0

        def finish() -> None:
            self.fill(set().union(*(c for _, c in waiting)))
            for i, chunks in waiting:
                out[i].append(b"".join([self.chunks[c] for c in chunks]))
            waiting.clear()

        for i, text in enumerate(bodies):
            at = 0
            while at < len(text):
                cut = _SPACE.search(text, min(at + SLICE_BYTES, len(text)))
                end = cut.start() if cut else len(text)
                waiting.append((i, text[at:end].split()))  # of bytes: \x20\x09-\x0D only, which no token and no normal form spans
                size += end - at
                at = end + 1
                if size >= SLICE_BYTES:
                    finish()
                    size = 0
        finish()
        return [b"".join(x) for x in out]

    def text(self, text: bytes) -> array:
        """Ids of one text."""
        return array("i", self.texts([text])[0])


def load(path: str) -> Vocabulary:
    """The vocabulary of a ``tokenizers`` JSON file, read by the driver."""
    return Vocabulary(json.loads(Path(path).read_text()))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids``, the token ids of ``text`` without any that frame it.

    Null and empty texts have no ids.  Every row is encoded by itself, repeated rows too; other columns stay as they
    are, one named as the result is replaced; an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c != ids]
    body = tokens.unused(docs.columns, "body")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of the vocabulary's size
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sent.value.encoder()
        for batch in batches:
            bodies, i = batch.column(body), 0
            while i < len(bodies):
                part, size, j = [], 0, i
                while j < len(bodies) and (j == i or size < SLICE_BYTES):
                    part.append(bodies[j].as_py() or b"")
                    size += len(part[-1])
                    j += 1
                made = encoder.texts(part)
                ends = np.cumsum([0, *map(len, made)]) // 4
                made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(made), np.int32)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in keep], made], names=[*keep, ids])
                i = j

    return docs.select(*keep, F.col(text).cast("binary").alias(body)).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with ``decoded``, the text of their ids, added tokens included.

    Tokens are joined by one space, or as bytes where the file names a byte decoder.  Null or no ids give an empty
    text; null ids and ids that the vocabulary lacks are passed over.
    """
    keep = [c for c in rows.columns if c != decoded]
    sent = rows.sparkSession.sparkContext.broadcast((vocabulary.written, vocabulary.joined_bytes, vocabulary.code))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, joined, code = sent.value
        texts = {i: w.encode() for i, w in written.items()}
        if joined:  # what is no byte letter stands for itself
            texts = {i: bytes(code[c] for c in w) if all(c in code for c in w) else w.encode() for i, w in written.items()}
        known = np.zeros(max(texts) + 2, bool)
        known[list(texts)] = True
        table = pa.array([texts.get(i, b"") for i in range(len(known))], pa.binary())
        for batch in batches:
            lists = batch.column(ids)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            sound = (flat >= 0) & (flat < len(known))
            sound &= known[np.where(sound, flat, len(known) - 1)]
            at = np.concatenate([[0], np.cumsum(sound)])[np.concatenate([[0], np.cumsum(sizes)])]
            flat = flat[sound]
            i = 0
            while i < len(lists):
                j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_IDS, "right")) - 1)
                parts = pa.ListArray.from_arrays(pa.array(at[i : j + 1] - at[i], pa.int32()), table.take(pa.array(flat[at[i] : at[j]])))
                made = pc.binary_join(parts, b"" if joined else b" ")
                made = pa.array([x.decode("utf-8", "replace") for x in made.to_pylist()], pa.string()) if joined else made.cast(pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in keep], made], names=[*keep, decoded])
                i = j

    return rows.select(*keep).mapInArrow(run, schema)
