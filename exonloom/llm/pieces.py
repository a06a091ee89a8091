"""Sampled segmentation into the pieces of a public vocabulary, and its decoding.

The lattice of a text has an edge for every piece that stands in it, and byte pieces for characters
that no piece holds.  Forward filtering sums the weight of all segmentations up to each place;
backward sampling draws the last piece from these sums and goes on before it.  So each segmentation
comes with the probability of its weight, without a beam or a list of best ones.

Pieces never go on after a space begins, nor over characters outside the vocabulary.  The lattice
therefore falls into short units whose sums do not depend on the rest; equal units of a slice are
filtered once and drawn from many times.  Draws are hashes of the row's key, the unit's number and the
step, so they are the same for any partitioning.

Decoding joins the pieces' bytes.  A text that holds the space mark itself has it as bytes, so every text
comes back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exonloom.llm.tokens import mix, places, slices, texts, unused

SPACE, MARK = 32, 0x2581  # a space, and what stands for it in pieces
OUTSIDE = 0x110000  # a character that is in no piece
SLICE_BYTES = 1 << 18
SLOTS = 19


class Vocabulary:
    """Arrays of a vocabulary: the trie of its pieces, their weights and their bytes."""

    def __init__(self, pieces: list[tuple[int, str, float]], bytes_of: list[int], size: int):
        """``pieces`` are (id, text with marks, log weight); ``bytes_of`` has the ids of the 256 byte pieces."""
        self.byte_ids = np.array(bytes_of, np.int32)
        edges, ends, self.most = {}, {}, 1
        chars = set()
        for i, piece, weight in pieces:
            if MARK in map(ord, piece.lstrip(chr(MARK))):
                raise ValueError(f"piece {i} has a space mark inside")
            node = 0
            for c in map(ord, piece):
                node = edges.setdefault((node, c), len(edges) + 1)
            ends[node] = (i, weight)
            chars.update(map(ord, piece))
            self.most = max(self.most, len(piece))
        # codes of edges: 0 none, 1 to size a piece, then one to four bytes
        self.size = size
        self.code = np.zeros(len(edges) + 1, np.int32)
        self.weight = np.zeros(size + 5)
        for node, (i, weight) in ends.items():
            self.code[node] = i + 1
            self.weight[i + 1] = np.exp(weight)
        self.weight[size + 1 :] = np.exp(-np.log(size) - 4) ** np.arange(1, 5)
        self.random = mix(np.arange(OUTSIDE + 1))
        self.read = np.full(OUTSIDE, OUTSIDE, np.int32)  # characters as they stand in pieces
        inside = np.array(sorted(chars - {SPACE, MARK}))
        self.read[inside] = inside
        self.read[SPACE] = MARK
        self.top = np.zeros(OUTSIDE + 1, np.int32)  # children of the root
        for (n, c), child in edges.items():
            if n == 0:
                self.top[c] = child
        keys = np.array([(n << 21) | c for n, c in edges], np.int64)
        self.keys = np.full(1 << SLOTS, -1, np.int64)
        self.next = np.zeros(1 << SLOTS, np.int32)
        left, child = np.arange(len(keys)), np.fromiter(edges.values(), np.int32, len(edges))
        slot = self.slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            _, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.next[slot[put]] = keys[put], child[put]
            left = np.setdiff1d(left, put)
            busy = left[self.keys[slot[left]] != keys[left]]
            slot[busy] = (slot[busy] + 1) & ((1 << SLOTS) - 1)
        out = [b""] * size
        for i, piece, _ in pieces:
            out[i] = piece.replace(chr(MARK), " ").encode()
        for value, i in enumerate(bytes_of):
            out[i] = bytes([value])
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_at = np.concatenate(([0], np.cumsum([len(x) for x in out])))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node after ``char``, 0 if there is none."""
        key = (node.astype(np.int64) << 21) | char
        at = self.slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.next[at], 0)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << SLOTS) - 1)
            found = self.keys[at[open_]]
            good = found == key[open_]
            out[open_[good]] = self.next[at[open_[good]]]
            open_ = open_[~good & (found >= 0)]
        return out


def restored(parts: dict) -> Vocabulary:
    out = Vocabulary.__new__(Vocabulary)
    out.__dict__.update(parts)
    return out


def load(path: str, flatness: float = 1.0) -> Vocabulary:
    """A vocabulary from a SentencePiece model file with byte pieces.

    The scores of a merge vocabulary are ranks; a piece's weight falls as the power ``flatness`` of its rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    ids = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    rank = {i: r for r, i in enumerate(sorted(ids, key=lambda i: -model.get_score(i)))}
    pieces = [(i, model.id_to_piece(i), -flatness * float(np.log(rank[i] + 10))) for i in ids]
    return Vocabulary(pieces, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], n)


def edges_of(v: Vocabulary, chars: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Codes of the edges by the place they end at and their length.

    ``room`` is the number of characters from a place to the end of its unit.  A character without a piece
    of its own has an edge of bytes.
    """
    out = np.zeros((len(chars), v.most), np.int32)
    node = v.top[chars]
    at = np.flatnonzero(node)
    node = node[at]
    for k in range(v.most):
        if k:
            fits = room[at] > k
            at, node = at[fits], node[fits]
            node = v.child(node, chars[at + k])
            alive = node > 0
            at, node = at[alive], node[alive]
        if not len(at):
            break
        out[at + k, k] = v.code[node]
    alone = np.flatnonzero(out[:, 0] == 0)
    c = chars[alone]
    size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    size[c == OUTSIDE] = 3  # the order of size among outside characters plays no part: they are units of their own
    out[alone, 0] = v.size + size
    return out


def filtered(v: Vocabulary, code: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each end and length the probability that the last piece is longer, by forward filtering.

    ``first`` and ``size`` are the units, longest first.  The sums of the last places are kept in a window and
    scaled together, so they neither vanish nor overflow in long units.
    """
    most = code.shape[1]
    longer = np.zeros(code.shape, np.float32)
    window = np.zeros((len(first), most + 1))
    window[:, 0] = 1
    count = np.searchsorted(-size, -np.arange(1, size.max() + 1), "right") if len(size) else []
    for j, n in enumerate(count):
        at, w = first[:n] + j, min(j + 1, most)
        terms = v.weight[code[at, :w]]
        terms *= window[:n, :w]
        total = np.cumsum(terms, axis=1, out=terms)
        now = total[:, -1].copy()
        total /= now[:, None]
        longer[at, :w] = 1 - total
        window[:n, 1 : w + 1] = window[:n, :w]
        window[:n, 0] = now
        if j % 4 == 3:
            window[:n] /= window[:n, : w + 1].max(axis=1)[:, None]
    return longer


def drawn(seed: np.ndarray, step: int) -> np.ndarray:
    return (mix(seed + np.uint64(step)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def encode_slice(v: Vocabulary, bodies: bytes, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of UTF-8 texts end to end, and the number of ids of each text; ``keys`` seed their draws."""
    raw = np.frombuffer(bodies, np.uint8)
    chars = np.frombuffer(bodies.decode("utf-8").encode("utf-32-le"), np.int32)
    heads = np.flatnonzero((raw & 0xC0) != 0x80)  # byte at which each character starts
    n_chars = np.diff(np.searchsorted(heads, np.concatenate(([0], np.cumsum(lengths)))))
    known = v.read[chars]
    keep = np.flatnonzero(n_chars)  # a mark goes before every text that is not empty
    starts = np.cumsum(n_chars) - n_chars
    chars = np.insert(known, starts[keep], MARK)
    byte_of = np.insert(heads, starts[keep], -1)
    n = n_chars + (n_chars > 0)
    begin = (np.cumsum(n) - n)[keep]

    mark, out = chars == MARK, chars == OUTSIDE
    cut = mark | out
    cut[1:] &= ~mark[:-1] | out[1:]
    cut[1:] |= out[:-1]
    cut[begin] = True
    first = np.flatnonzero(cut)
    size = np.diff(first, append=len(chars))
    owner = np.repeat(np.arange(len(keep)), np.diff(np.searchsorted(first, np.append(begin, len(chars)))))
    nth = np.arange(len(first)) - np.searchsorted(first, begin)[owner]

    at = np.arange(len(chars)) - np.repeat(first, size)
    exact = v.random[chars] * places(int(size.max()) if len(size) else 1)[at]
    name = np.add.reduceat(exact, first) + mix(size) if len(first) else np.zeros(0, np.uint64)
    _, one, of = np.unique(name, return_index=True, return_inverse=True)
    order = np.argsort(-size[one], kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    one, of = one[order], rank[of]
    u_size = size[one]
    u_first = np.cumsum(u_size) - u_size
    within = np.arange(int(u_size.sum())) - np.repeat(u_first, u_size)
    u_chars = chars[np.repeat(first[one], u_size) + within]
    code = edges_of(v, u_chars, np.repeat(u_size, u_size) - within)
    longer = filtered(v, code, u_first, u_size)

    live = np.arange(len(first))
    end = u_first[of] + size - 1
    seed = mix(mix(keys[keep])[owner] + nth.astype(np.uint64))
    got_piece, got_char = [], []
    step = 0
    while len(live):
        e = end[live]
        k = (longer[e] > drawn(seed[live], step).astype(np.float32)[:, None]).sum(axis=1)
        p = code[e, k] - 1
        got_piece.append(p)
        got_char.append(first[live] + e - u_first[of[live]])
        end[live] = e - k - 1
        live = live[end[live] >= u_first[of[live]]]
        step += 1
    if not got_piece:
        return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
    place, ids = np.concatenate(got_char), np.concatenate(got_piece)
    order = np.argsort(place, kind="stable")
    place, ids = place[order], ids[order]
    plain = ids < v.size
    at_byte = byte_of[place]
    until = np.append(heads, len(raw))
    last = until[np.searchsorted(until, at_byte, "right").clip(0, len(until) - 1)]
    width = np.where(plain, 1, last - at_byte)
    target = np.cumsum(width) - width
    made = np.empty(int(width.sum()), np.int32)
    made[target[plain]] = ids[plain]
    w = width[~plain]
    inner = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    made[np.repeat(target[~plain], w) + inner] = v.byte_ids[raw[np.repeat(at_byte[~plain], w) + inner]]
    per = np.zeros(len(lengths), np.int64)
    np.add.at(per, keep[np.searchsorted(begin, place, "right") - 1], width)
    return made, per


def decode_slice(v: Vocabulary, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of piece ids, and the number of bytes of each; the mark before a text goes."""
    a, b = v.out_at[ids], v.out_at[ids + 1]
    size = b - a
    starts = np.cumsum(n) - n
    some = np.flatnonzero(n)
    a = a.copy()
    a[starts[some]] += 1
    size[starts[some]] -= 1
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    total = np.concatenate(([0], np.cumsum(size)))
    ends = np.cumsum(n)
    return v.out[np.repeat(a, size) + at], total[ends] - total[ends - n]


def same_texts(data: np.ndarray, lengths: np.ndarray, made: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which texts of one run of bytes equal those of another."""
    if np.array_equal(lengths, sizes) and np.array_equal(data, made):
        return np.ones(len(lengths), bool)
    a, b = np.cumsum(lengths), np.cumsum(sizes)
    return np.array([np.array_equal(data[x - n : x], made[y - m : y]) for x, n, y, m in zip(a, lengths, b, sizes, strict=True)], bool)


def encode(
    docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", seed: int = 0, check: bool = False
) -> DataFrame:
    """``docs`` with ``pieces``, a sampled segmentation of ``text`` as ids; with ``check`` also ``lossless``.

    ``lossless`` says whether the pieces, decoded at once, are the bytes of the text.  Null and empty texts have no
    pieces.  Rows with one key and text have one segmentation; a null key seeds like 0.  Columns with the name
    of a result are replaced; an empty table gives an empty result.
    """
    made_columns = ["pieces", "lossless"] if check else ["pieces"]
    keep = [c for c in docs.columns if c not in made_columns]
    body, seeds = unused(docs.columns, "body"), unused(docs.columns, "seed_of_row")
    sent = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))  # of fixed size
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    if check:
        schema.add("lossless", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = restored(sent.value)
        for batch in batches:
            data, offsets = texts(batch.column(body))
            keys = mix(batch.column(seeds).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            for i, j in slices(offsets, SLICE_BYTES):
                raw, lengths = data[offsets[i] : offsets[j]], np.diff(offsets[i : j + 1])
                ids, n = encode_slice(v, raw.tobytes(), lengths, keys[i:j])
                made = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ids))]
                if check:
                    made.append(pa.array(same_texts(raw, lengths, *decode_slice(v, ids, n))))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in keep], *made], names=[*keep, *made_columns])

    seeded = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("0")), F.lit(seed)).alias(seeds)
    return docs.select(*keep, F.col(text).cast("binary").alias(body), seeded).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces") -> DataFrame:
    """``rows`` with ``decoded``, the text of their pieces; null or no pieces: empty."""
    keep = [c for c in rows.columns if c not in (pieces, "decoded")]
    sent = rows.sparkSession.sparkContext.broadcast(vars(vocabulary))
    schema = T.StructType([*[rows.schema[c] for c in keep], rows.schema[pieces], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = restored(sent.value)
        for batch in batches:
            lists = batch.column(pieces)
            n = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(n)))
            for i, j in slices(at, 1 << 19):
                made, size = decode_slice(v, ids[at[i] : at[j]], n[i:j])
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                text = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(made)])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, j - i) for c in keep], lists.slice(i, j - i), text], names=[*keep, pieces, "decoded"]
                )

    return rows.select(*keep, pieces).mapInArrow(run, schema)
