"""Many motifs looked for at once: an automaton with failure links as flat arrays, run over lanes of bytes.

The arrays are built once and broadcast.  A task cuts its texts into stretches of equal length, each with a run-up of
the longest motif before it, and takes all stretches one byte further at a time, so a step is one array look-up for
thousands of places.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Stretches that are walked side by side, about, and the shortest and longest of them.
LANES, SHORTEST, LONGEST = 4096, 256, 1 << 16


class Automaton:
    """``step[state, class]`` of all states; of each, the motif that ends there and the next state with a shorter one."""

    def __init__(self, motifs: Sequence[bytes]):
        if any(not m for m in motifs):
            raise ValueError("an empty motif is found everywhere")
        used = sorted(set().union(*motifs)) if motifs else []
        self.kind = np.zeros(256, np.int16)  # 0: in no motif
        self.kind[used] = np.arange(1, len(used) + 1)
        children: dict[tuple[int, int], int] = {}
        depth, parent, letter, ends = [0], [0], [0], [-1]
        for i, motif in enumerate(motifs):
            node = 0
            for k in self.kind[np.frombuffer(motif, np.uint8)].tolist():
                found = children.get((node, k))
                if found is None:
                    found = children[node, k] = len(depth)
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    letter.append(k)
                    ends.append(-1)
                node = found
            ends[node] = i
        depth, parent, letter = (np.array(x, np.int32) for x in (depth, parent, letter))
        self.motif, self.sizes = np.array(ends, np.int32), np.array([len(m) for m in motifs], np.int64)
        self.longest = int(depth.max())
        self.step = np.zeros((len(depth), len(used) + 1), np.int32)
        fail = np.zeros(len(depth), np.int32)
        self.shorter = np.zeros(len(depth), np.int32)
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(self.longest + 2))
        for d in range(1, self.longest + 1):  # a level at a time: failures lead to levels that are done
            level = order[cut[d] : cut[d + 1]]
            if d > 1:
                fail[level] = self.step[fail[parent[level]], letter[level]]
            else:
                self.step[0, letter[level]] = level
            f = fail[level]
            self.shorter[level] = np.where(self.motif[f] >= 0, f, self.shorter[f])
            self.step[level] = self.step[f]
            below = order[cut[d + 1] : cut[d + 2]] if d < self.longest else order[:0]
            self.step[parent[below], letter[below]] = below
        self.found = (self.motif >= 0) | (self.shorter > 0)

    def occurrences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, motif, start)`` of every occurrence, overlapping ones too; starts count bytes of the text."""
        sizes = np.diff(offsets)
        span = int(np.clip(sizes.sum() // LANES, SHORTEST, LONGEST))
        pieces = -(-sizes // span)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        own = offsets[:-1][text] + nth * span
        stop = np.minimum(own + span, offsets[1:][text])
        begin = np.maximum(own - (self.longest - 1), offsets[:-1][text])
        length = stop - begin
        order = np.argsort(-length, kind="stable")  # so that the lanes still running come first
        text, own, begin, length = text[order], own[order], begin[order], length[order]
        kinds = self.kind[data]
        state, got = np.zeros(len(text), np.int32), []
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t, "left"))
            at = begin[:n] + t
            state[:n] = self.step[state[:n], kinds[at]]
            hit = np.flatnonzero(self.found[state[:n]] & (at >= own[:n]))
            if len(hit):
                got.append((hit, state[hit], at[hit]))
        if not got:
            return (np.zeros(0, np.int64),) * 3
        lane, state, at = (np.concatenate(x) for x in zip(*got))
        out = []
        while len(lane):
            own_motif = self.motif[state] >= 0
            motif = self.motif[state[own_motif]]
            out.append((text[lane[own_motif]], motif, at[own_motif] + 1 - self.sizes[motif]))
            more = self.shorter[state] > 0
            lane, at, state = lane[more], at[more], self.shorter[state[more]]
        where, motif, start = (np.concatenate(x) for x in zip(*out))
        return where, motif.astype(np.int64), start - offsets[:-1][where]

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The occurrences that are left when each motif is taken from left to right without overlaps with itself."""
        where, motif, start = self.occurrences(data, offsets)
        order = np.lexsort((start, motif, where))
        where, motif, start = where[order], motif[order], start[order]
        size = self.sizes[motif]
        near = np.zeros(len(start), bool)  # overlaps the occurrence before it
        near[1:] = (where[1:] == where[:-1]) & (motif[1:] == motif[:-1]) & (start[1:] - start[:-1] < size[1:])
        keep = ~near
        heads = np.flatnonzero(near & ~np.concatenate([[False], near[:-1]])) if len(near) else near
        for i in heads.tolist():  # runs of overlapping ones
            free = start[i - 1] + size[i]
            while i < len(near) and near[i]:
                if start[i] >= free:
                    keep[i], free = True, start[i] + size[i]
                i += 1
        return where[keep], motif[keep], start[keep]


def code_points(data: np.ndarray, offsets: np.ndarray, where: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Byte places within texts as places in code points (UTF-8)."""
    if not len(data) or data.max(initial=0) < 0x80:
        return start
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return upto[offsets[:-1][where] + start] - upto[offsets[:-1][where]]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
