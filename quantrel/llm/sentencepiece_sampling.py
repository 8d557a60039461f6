"""Operator 1: SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations into pieces are the paths of a lattice. A path's probability is proportional to the product of its
pieces' weights, 1 / (rank + ZIPF) to the power SHARPNESS. The K paths with the largest Gumbel-perturbed log-probabilities are K distinct
draws without replacement. They are found by A* over sets of paths: a set's bound is the largest perturbed value in
it, drawn for the set as a whole (a Gumbel at the set's log-mass, truncated at its parent's bound). The best set is split into its
best path, which keeps the bound, and at each step of that path the set of all other continuations, with bounds of
their own. Sets are split only when they come up, so K draws cost K walks through the text.

Bounds are pruned exactly: a uniform draw has 53 bits, so a bound is at most log-mass + LARGEST, and sets whose mass lies
too low to enter the K + 1 best are not drawn. The next bound after the K-th draw is the threshold of the
sample, and a path's inclusion score is P(its perturbed value exceeds that threshold) = 1 - exp(-exp(log_prob - threshold)).

Where no piece holds two neighbouring characters the lattice falls apart into chunks, whose lattices are kept
for as long as they fit. All chunks of a batch walk together in numpy. Random numbers hash (row key, walk, chunk, step): a row's draws
depend on its key and text alone, not on batches or partitions.

Characters without a piece, and the space mark where it is part of the text, become bytes, so decoding gives the text back.

Defined cases: a null or empty text has one segmentation, without pieces. A text with fewer than K segmentations gets them all, each with
inclusion score 1. Rows that repeat key and text get the same draws. Texts of any length are taken whole. An empty table gives an
empty result. Null keys hash like a key of their own; extra columns are ignored.
"""

from __future__ import annotations

import ctypes
import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K, ZIPF, SHARPNESS, SEED = 2, 10.0, 1.0, 17
#: Fixed values of the piece inventory: the space mark, and where the 256 byte pieces start.
MARK, BYTES_AT = "▁", 3
#: A chunk's weights are scaled by this factor a character, which all its segmentations share.
PER_CHAR = math.exp(3.0)
LARGEST = 53 * math.log(2) + 0.01
#: States of kept chunks, and rows and characters that walk together.
KEPT_STATES, BATCH_ROWS, BATCH_CHARS = 800_000, 150, 400_000
#: Characters of new chunks that are built together.
BUILD_CHARS = 100_000
#: Steps of a walk whose sets get bounds in full, and that are looked at, at once; further ones only where pruning asks for them.
NEAR, SPAN = 64, 448
ALL_BITS = (1 << 64) - 1
#: Code points of Unicode's private use, never pieces: they stand for the bytes of what has no piece.
PRIVATE = 0xF0000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function, by element."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_one(x: int) -> int:
    """mix() of one number."""
    x = (x + 0x9E3779B97F4A7C15) & ALL_BITS
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ALL_BITS
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ALL_BITS
    return x ^ x >> 31


def uniform_one(x: int) -> float:
    return ((mix_one(x) >> 11) + 0.5) * 2.0**-53


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), 53 bits."""
    return ((mix(x) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def load_pieces(path: str = MODEL) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.vocab_size())]


class Trie:
    """Pieces by character, as an open-addressed table of (node, character) -> node that numpy searches."""

    def __init__(self, ids: dict[str, int]):
        moves, self.piece = {}, [-1]
        for text, i in ids.items():
            node = 0
            for c in text:
                key = node << 21 | ord(c)
                if key not in moves:
                    moves[key] = len(self.piece)
                    self.piece.append(-1)
                node = moves[key]
            self.piece[node] = i
        self.piece = np.array(self.piece, np.int32)
        self.bits = max(4, (4 * len(moves)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        for key, node in moves.items():
            at = int(self.slot(np.array([key], np.int64))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.next[at] = key, node

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def follow(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where there is none."""
        key = node.astype(np.int64) << 21 | char.astype(np.int64)
        at = self.slot(key)
        other = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.keys) - 1)
            other = other[(self.keys[at[other]] != key[other]) & (self.keys[at[other]] >= 0)]
        return self.next[at]


class Lattices:
    """Chunk lattices over a piece inventory, kept in flat arrays.

    A chunk ends wherever no piece holds its last character next to the one that follows, so a text's lattice is the row of its chunks'
    lattices. A chunk has a state for each of its characters. State s has edges first[s] .. first[s] + width[s] - 1, longest first; an edge has
    its state, its piece, the state that it leads to (-1: the end), its probability given the state, and the running sum of those.
    Chunks are found by a hash of their characters, and what is found is compared with them.
    """

    KINDS = {"char": np.uint32, "size": np.int32, "first": np.int32, "width": np.int16, "again": bool, "source": np.int32, "piece": np.int32, "to": np.int32, "p": np.float64, "cum": np.float64}
    BY_STATE = ("char", "size", "first", "width", "again")

    def __init__(self, pieces: list[str], zipf: float = ZIPF, sharpness: float = SHARPNESS):
        self.names = pieces
        start = BYTES_AT + 256
        ids = {p: i for i, p in enumerate(pieces) if i >= start}
        self.weight = np.array([(1 / (max(0, i - start) + zipf)) ** sharpness * PER_CHAR ** (1 if i < start else len(p)) for i, p in enumerate(pieces)])
        self.trie = Trie(ids)
        # characters of single pieces and of the space mark stay; all else becomes bytes
        self.rare = re.compile("[^" + "".join(re.escape(p) for p in sorted(ids) if len(p) == 1 and p != MARK) + " ]")
        chars = sorted({ord(c) for p in ids if len(p) > 1 for c in p if ord(c) < 0xFFFF})
        self.kind = np.zeros(0x10000, np.int16)
        self.kind[chars] = np.arange(1, len(chars) + 1)
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in ids:
            for x, y in zip(p, p[1:], strict=False):
                self.joins[self.kind[min(ord(x), 0xFFFF)], self.kind[min(ord(y), 0xFFFF)]] = True
        self.power = np.empty(0, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.states = self.links = self.chunks = 0
        self.kept = {k: np.zeros(1024, kind) for k, kind in self.KINDS.items()}
        self.bits = 16
        self.keys, self.starts = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def put(self, **values: np.ndarray) -> None:
        """Append to the kept arrays, which grow by a quarter as needed."""
        for k, new in values.items():
            done = self.states if k in self.BY_STATE else self.links
            if done + len(new) > len(self.kept[k]):
                self.kept[k] = np.concatenate([self.kept[k], np.zeros(done // 4 + len(new), self.KINDS[k])])
            self.kept[k][done : done + len(new)] = new
        self.states += len(values["first"])
        self.links += len(values["p"])

    def prepare(self, text: str) -> str:
        """The text as the lattice sees it: space marks, one of them ahead, and bytes for what has no piece."""
        if not text:
            return ""
        return MARK + self.rare.sub(lambda m: "".join(chr(PRIVATE + b) for b in m[0].encode()), text).replace(" ", MARK)

    def cut(self, chars: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Where the chunks start."""
        kind = self.kind[np.minimum(chars, 0xFFFF)]
        apart = np.ones(len(chars), bool)
        apart[1:] = ~self.joins[kind[:-1], kind[1:]]
        apart[text_starts] = True
        return np.flatnonzero(apart)

    def hashes(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Never 0. Sums of character times power of place, shifted to the chunk's start."""
        if len(self.power) < len(chars):
            base = 0x9E3779B97F4A7C15
            self.power = np.cumprod(np.full(len(chars) + 1024, base, np.uint64))
            self.inverse = np.cumprod(np.full(len(chars) + 1024, pow(base, -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(chars.astype(np.uint64)) * self.power[: len(chars)])])
        return mix((sums[starts + sizes] - sums[starts]) * self.inverse[starts] + sizes.astype(np.uint64)) | np.uint64(1)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """First states of the chunks with these hashes, -1 where there is none."""
        at, last = self.slot(h), len(self.keys) - 1
        got = self.keys[at]
        other = np.flatnonzero((got != h) & (got != 0))
        while len(other):
            at[other] = (at[other] + 1) & last
            got[other] = self.keys[at[other]]
            other = other[(got[other] != h[other]) & (got[other] != 0)]
        return np.where(got == h, self.starts[at].astype(np.int64), -1)

    def insert(self, h: np.ndarray, starts: np.ndarray) -> None:
        """New, distinct hashes."""
        self.chunks += len(h)
        if 2 * self.chunks > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, values = self.keys[old], self.starts[old]
            self.bits = (4 * self.chunks).bit_length()
            self.keys, self.starts = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            h, starts = np.concatenate([keys, h]), np.concatenate([values, starts])
        at, last = self.slot(h), len(self.keys) - 1
        left = np.arange(len(h))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = h[left[free]]
            won = self.keys[at[left]] == h[left]
            self.starts[at[left[won]]] = starts[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & last

    @staticmethod
    def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """start, start + 1, .. of each run, one after the other."""
        return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))

    def build(self, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Find the edges of all chunks in one walk through the trie, then their masses from the ends backwards. First states."""
        ends = np.cumsum(lengths)
        end = np.repeat(ends, lengths)
        at, node, size = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            node = self.trie.follow(node, chars[at + size])
            at, node, size = at[node >= 0], node[node >= 0], size + 1
            piece = self.trie.piece[node]
            has = piece >= 0
            found.append((at[has], np.full(int(has.sum()), size), piece[has]))
            on = at + size < end[at]
            at, node = at[on], node[on]
        bare = np.ones(len(chars), bool)
        for own, _, _ in found:
            bare[own] = False
        own = np.flatnonzero(bare)
        found.append((own, np.ones(len(own), np.int64), BYTES_AT + (chars[own].astype(np.int64) - PRIVATE)))
        levels = [own[::-1] for own, _, _ in found]
        source, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        # longest first (they were found by rising size), then by state, then by the state's distance from its chunk's end
        source, size, piece = source[::-1], size[::-1], piece[::-1]
        width = np.bincount(source, minlength=len(chars))
        far = end - np.arange(len(chars))
        by_far = np.argsort(far.astype(np.int16) if far.max() < 1 << 15 else far, kind="stable")
        place = np.empty(len(chars), np.int64)
        place[by_far] = np.cumsum(width[by_far]) - width[by_far]
        order, done = np.empty(len(source), np.int64), 0
        for own in levels[::-1]:
            at = place[own]
            order[at] = np.arange(done, done + len(own))
            place[own] = at + 1
            done += len(own)
        source, size, piece = source[order], size[order], piece[order].astype(np.int64)
        distance, target = far[source], source + size
        new = np.flatnonzero(np.diff(source, prepend=-1))
        width = np.diff(np.append(new, len(source)))
        p, mass, scale = self.weight[piece], np.ones(len(chars) + 1), np.zeros(len(chars) + 1)
        last = target == end[source]
        turns = np.append(np.flatnonzero(np.diff(distance, prepend=0)), len(distance))
        groups = np.searchsorted(new, turns)
        long = bool(lengths.max() > 64)
        for a, b, g, h in zip(turns[:-1], turns[1:], groups[:-1], groups[1:], strict=True):
            own, heads = slice(a, b), new[g:h] - a
            parts = p[own] * np.where(last[own], 1.0, mass[target[own]])
            if long:  # masses of long chunks are kept relative to a scale of their own
                shift = np.where(last[own], 0.0, scale[target[own]])
                top = np.repeat(np.maximum.reduceat(shift, heads), width[g:h])
                parts = parts * np.exp(shift - top)
            total = np.add.reduceat(parts, heads)
            p[own] = parts / np.repeat(total, width[g:h])
            if long:
                scale[source[new[g:h]]] = top[heads] + np.log(total)
                total = np.ones_like(total)
            mass[source[new[g:h]]] = total
        run = np.cumsum(p)
        cum = run - np.repeat(run[new] - p[new], width)
        cum[np.append(new[1:], len(p)) - 1] = 2.0
        states, first, wide = source[new], np.empty(len(chars), np.int64), np.empty(len(chars), np.int32)
        first[states], wide[states] = new + self.links, width
        at = ends - lengths + self.states
        self.put(char=chars, size=far, first=first, width=wide, again=np.zeros(len(chars), bool), source=source + self.states, piece=piece, to=np.where(last, -1, target + self.states), p=p, cum=cum)
        return at

    def build_all(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Chunks of up to 64 characters in blocks of bounded size, longer ones one by one."""
        out = np.empty(len(starts), np.int64)
        short = np.flatnonzero(sizes <= 64)
        blocks = np.cumsum(sizes[short]) // BUILD_CHARS
        for own in np.split(short, np.flatnonzero(np.diff(blocks)) + 1):
            if len(own):
                out[own] = self.build(chars[self.ragged(starts[own], sizes[own])], sizes[own])
        for i in np.flatnonzero(sizes > 64):
            out[i] = self.build(chars[starts[i] : starts[i] + sizes[i]], sizes[i : i + 1])[0]
        return out

    def places(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """First states of the chunks that start there and fill chars; new ones are built together."""
        sizes = np.diff(np.append(starts, len(chars)))
        h = self.hashes(chars, starts, sizes)
        out = self.find(h)
        known = out >= 0
        self.kept["again"][out[known]] = True
        if not known.all():
            absent = np.flatnonzero(~known)
            fresh, which, back = np.unique(h[absent], return_index=True, return_inverse=True)
            which = absent[which]
            built = self.build_all(chars, starts[which], sizes[which])
            self.insert(fresh, built)
            out[absent] = built[back]
        # two chunks may share a hash: those that differ from what was found are built for this time alone
        wrong = self.kept["size"][out] != sizes
        same = self.kept["char"][np.minimum(self.ragged(out, sizes), self.states - 1)] == chars
        if wrong.any() or not same.all():
            bad = np.flatnonzero(wrong | ~np.logical_and.reduceat(same, starts))
            out[bad] = self.build_all(chars, starts[bad], sizes[bad])
        return out

    def thin(self) -> None:
        """Forget the chunks that were met only once since the last thinning."""
        used = np.sort(self.starts[np.flatnonzero(self.keys)].astype(np.int64))
        used = used[self.kept["again"][used]]
        sizes = self.kept["size"][used].astype(np.int64)
        chars = self.kept["char"][self.ragged(used, sizes)]
        self.clear()
        if len(used):
            self.places(chars, np.cumsum(sizes) - sizes)

    def walk(self, state: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random path from each state to its chunk's end: steps of each, and the edges in order. salt: a number for each path."""
        first, to, cum = self.kept["first"], self.kept["to"], self.kept["cum"]
        n, t, where, taken = len(state), 0, np.arange(len(state)), []
        steps = np.zeros(n, np.int64)
        while len(where):
            u = uniform(salt + np.uint64(t))
            edge = first[state].astype(np.int64)
            late = np.flatnonzero(u > cum[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] > cum[edge[late]]]
            taken.append((where, edge))
            steps[where] += 1
            state = to[edge]
            on = state >= 0
            state, where, salt, t = state[on], where[on], salt[on], t + 1
        starts = np.cumsum(steps) - steps
        out = np.empty(int(steps.sum()), np.int64)
        for t, (who, edge) in enumerate(taken):
            out[starts[who] + t] = edge
        return steps, out


SPREAD = 0xD1342543DE82EF95


class Row:
    """A text's chunks and draws so far."""

    def __init__(self, key: int, states: np.ndarray):
        self.key, self.states = key, states
        self.draws: list[tuple[float, np.ndarray, np.ndarray]] = []  # bound, edges, chunk of each edge
        self.sets: list[tuple[float, int, int, float, tuple[int, ...]]] = []  # -bound, draw, step, log-mass before, edges that are out


def salt(key: int, draw: int, kind: int) -> int:
    """Start of a stream of random numbers; kind parts their uses."""
    return mix_one((key & ALL_BITS) ^ mix_one(draw * 4 + kind))


def number(base: int, i: int) -> float:
    return uniform_one(mix_one(base ^ (i * SPREAD & ALL_BITS)))


def salts(bases: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The i-th numbers of streams, before uniform()."""
    return mix(bases ^ (i.astype(np.uint64) * np.uint64(SPREAD)))


def first_sets(rows: list[Row], lattices: Lattices, starts: list[int], keep: int) -> None:
    """Bounds for what each row's newest draw left aside from step `start` on, all rows together.

    The first NEAR steps are drawn in full. A later set enters the `keep` best only if its uniform lies within exp(mass ahead - least) of 1;
    rows where any does, or that are not past LARGEST after SPAN steps, are done one by one.
    """
    p = lattices.kept["p"]
    chance = np.ones((len(rows), SPAN))
    ahead, bounds, bases = np.empty(len(rows)), np.empty(len(rows)), np.empty(len(rows), np.uint64)
    for n, (r, start) in enumerate(zip(rows, starts, strict=True)):
        bound, edges, _ = r.draws[-1]
        own = edges[start : start + SPAN]
        chance[n, : len(own)] = p[own]
        ahead[n] = np.log(p[edges[:start]]).sum() if start else 0.0
        bounds[n], bases[n] = bound, salt(r.key, len(r.draws) - 1, 1)
    logs = np.log(chance)
    after = ahead[:, None] + np.cumsum(logs, 1)
    u = uniform(salts(bases[:, None], np.array(starts)[:, None] + np.arange(SPAN)))
    before = after[:, :NEAR] - logs[:, :NEAR]
    with np.errstate(divide="ignore", invalid="ignore"):
        location = before + np.log1p(-chance[:, :NEAR])
        values = -np.logaddexp(-bounds[:, None], np.log(-np.log(u[:, :NEAR])) - location)
    best = np.argpartition(-values, keep - 1, axis=1)[:, :keep]
    kept = np.take_along_axis(values, best, 1)
    least = kept.min(1)
    with np.errstate(over="ignore"):
        reach = 2 * np.exp(after[:, NEAR - 1] - least)
    late = ((1 - u[:, NEAR:] <= reach[:, None]) & (chance[:, NEAR:] < 1)).any(1)
    far = ~(after[:, -1] < least - LARGEST)
    for n, (r, start) in enumerate(zip(rows, starts, strict=True)):
        draw, edges = len(r.draws) - 1, r.draws[-1][1]
        if late[n] or far[n] and len(edges) - start > SPAN:
            add_sets(r, lattices, start, keep)
            continue
        for i, v in zip(best[n].tolist(), kept[n].tolist(), strict=True):
            if v > -math.inf:
                heapq.heappush(r.sets, (-v, draw, start + i, float(before[n, i]), (int(edges[start + i]),)))


def add_sets(row: Row, lattices: Lattices, start: int, keep: int) -> None:
    """The same for one row, over as many steps as pruning asks for; at most `keep` sets can matter."""
    p = lattices.kept["p"]
    bound, edges, _ = row.draws[-1]
    draw, size, span = len(row.draws) - 1, len(edges), 8 * SPAN
    while True:
        stop = min(size, start + span)
        logs = np.log(p[edges[:stop]])
        before = np.cumsum(logs) - logs
        own = np.arange(start, stop)
        chance = p[edges[start:stop]]
        open_ = chance < 1.0  # a state with one edge leaves nothing aside
        own, chance, ahead = own[open_], chance[open_], before[start:][open_]
        noise = np.log(-np.log(uniform(salts(np.full(len(own), salt(row.key, draw, 1), np.uint64), own))))
        bounds = -np.logaddexp(-bound, noise - (ahead + np.log1p(-chance)))
        best = np.argpartition(-bounds, keep - 1)[:keep] if len(bounds) > keep else np.arange(len(bounds))
        if stop == size or len(bounds) > keep and before[-1] + logs[-1] < bounds[best].min() - LARGEST:
            break
        span *= 8
    for i in best:
        heapq.heappush(row.sets, (-float(bounds[i]), draw, int(own[i]), float(ahead[i]), (int(edges[own[i]]),)))


def split_set(row: Row, lattices: Lattices) -> tuple[float, np.ndarray, np.ndarray, int, int]:
    """Take the best set: its bound, the draw's edges and chunks up to the branch, the branch's edge and chunk."""
    p = lattices.kept["p"]
    value, draw, step, ahead, out = heapq.heappop(row.sets)
    bound, (_, edges, chunks) = -value, row.draws[draw]
    state = lattices.kept["source"][edges[step]]
    begin, n = int(lattices.kept["first"][state]), int(lattices.kept["width"][state])
    choices = [e for e in range(begin, begin + n) if e not in out]
    chances = p[choices]
    new = len(row.draws)
    u = number(salt(row.key, new, 2), step) * chances.sum()
    edge = choices[min(int(np.searchsorted(np.cumsum(chances), u)), len(choices) - 1)]
    rest = sum(float(p[e]) for e in choices if e != edge)
    if rest > 0 and len(choices) > 1:
        noise = math.log(-math.log(number(salt(row.key, new, 3), step)))
        heapq.heappush(row.sets, (-float(-np.logaddexp(-bound, noise - (ahead + math.log(rest)))), draw, step, ahead, (*out, edge)))
    return bound, edges[:step], chunks[:step], edge, int(chunks[step])


def sample(texts: list[str], keys: list[int], lattices: Lattices, k: int = K) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k draws (pieces, log-probability, perturbed value, log inclusion score), largest value first."""
    if lattices.states > KEPT_STATES:
        lattices.thin()
        if lattices.states > KEPT_STATES // 2:
            lattices.clear()
    seen = [lattices.prepare(t) for t in texts]
    ends = np.cumsum([len(t) for t in seen])
    states, cuts = np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    if ends[-1]:
        chars = np.frombuffer("".join(seen).encode("utf-32-le"), np.uint32)
        starts = lattices.cut(chars, (ends - [len(t) for t in seen])[[bool(t) for t in seen]])
        states = lattices.places(chars, starts)
        cuts[1:] = np.searchsorted(starts, ends)
    piece, to, p = lattices.kept["piece"], lattices.kept["to"], lattices.kept["p"]
    rows = [Row(key, states[i:j]) for key, i, j in zip(keys, cuts[:-1], cuts[1:], strict=True)]

    def finish(work: list[tuple[Row, float, np.ndarray, np.ndarray, int, int]]) -> None:
        """Walk on from each branch (row, bound, edges and chunks so far, state to go on from or -1, next whole chunk)."""
        starts, chunks, bases, counts = [], [], [], []
        for row, _, _, _, state, nxt in work:
            first = nxt - (state >= 0)
            own = row.states[first:]
            if state >= 0:
                own = own.copy()
                own[0] = state
            starts.append(own)
            chunks.append(np.arange(first, len(row.states)))
            bases.append(salt(row.key, len(row.draws), 0))
            counts.append(len(own))
        steps, edges = lattices.walk(np.concatenate(starts), salts(np.repeat(np.array(bases, np.uint64), counts), np.concatenate(chunks)))
        cuts = np.concatenate([[0], np.cumsum(steps)])[np.concatenate([[0], np.cumsum(counts)])]
        done = 0
        for (row, bound, head, before, state, nxt), c, a, b in zip(work, counts, cuts[:-1], cuts[1:], strict=True):
            owner = np.repeat(np.arange(nxt - (state >= 0), len(row.states)), steps[done : done + c])
            done += c
            row.draws.append((bound, np.concatenate([head, edges[a:b]]), np.concatenate([before, owner])))

    some = [r for r in rows if len(r.states)]
    nothing = np.empty(0, np.int64)
    if some:
        finish([(r, -math.log(-math.log(number(salt(r.key, 0, 2), 0))), nothing, nothing, -1, 0) for r in some])
        first_sets(some, lattices, [0] * len(some), k)
    for drawn in range(1, k):
        work = []
        for r in some:
            if len(r.draws) == drawn and r.sets:
                bound, head, chunks, edge, chunk = split_set(r, lattices)
                work.append((r, bound, np.append(head, edge), np.append(chunks, chunk), int(to[edge]), chunk + 1))
        if not work:
            break
        finish(work)
        first_sets([w[0] for w in work], lattices, [len(w[2]) for w in work], k - drawn)
    out = []
    for r in rows:
        if not len(r.states):
            out.append([(np.empty(0, np.int32), 0.0, 0.0, 0.0)])
            continue
        threshold = -r.sets[0][0] if r.sets else -math.inf
        own = []
        for bound, edges, _ in r.draws:
            log_prob = float(np.log(p[edges]).sum())
            over = log_prob - threshold
            own.append((piece[edges], log_prob, bound, 0.0 if over > 30 else over if over < -30 else math.log(-math.expm1(-math.exp(over)))))
        out.append(own)
    return out


class Decoder:
    """Piece sequences to text, by gathering the pieces' code points."""

    def __init__(self, pieces: list[str]):
        texts = [p.replace(MARK, " ") for p in pieces]
        texts[BYTES_AT : BYTES_AT + 256] = map(chr, range(256))
        self.chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.length = np.array([len(t) for t in texts])
        self.start = np.cumsum(self.length) - self.length

    def points(self, pieces: np.ndarray) -> np.ndarray:
        length = self.length[pieces]
        shift = self.start[pieces] - (np.cumsum(length) - length)
        return self.chars[np.repeat(shift, length) + np.arange(int(length.sum()))]

    def __call__(self, pieces: np.ndarray) -> str:
        pieces = np.asarray(pieces, np.int64)
        if not len(pieces):
            return ""
        wide = (pieces >= BYTES_AT + 128) & (pieces < BYTES_AT + 256)
        if not wide.any():
            return self.points(pieces).tobytes().decode("utf-32-le")[1:]
        out = []
        for run in np.split(np.arange(len(pieces)), np.flatnonzero(np.diff(wide)) + 1):
            own = pieces[run]
            out.append(bytes((own - BYTES_AT).astype(np.uint8)).decode(errors="replace") if wide[run[0]] else self.points(own).tobytes().decode("utf-32-le"))
        return "".join(out)[1:]


@lru_cache(maxsize=1)
def kept_lattices(pieces: tuple[str, ...]) -> tuple[Lattices, Decoder]:
    """A Python worker's lattices outlive its tasks."""
    return Lattices(list(pieces)), Decoder(list(pieces))


def trim() -> None:
    """Give freed memory back to the system, as idle Python workers keep theirs."""
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def encode_samples(df: DataFrame, id_column: str = "doc_id", text: str = "text", k: int = K, model: str = MODEL, seed: int = SEED) -> DataFrame:
    """id_column, draw (from 1), n_pieces, log_prob, perturbed, log_inclusion, round_trip and ids; a row for each draw of each row."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(load_pieces(model)))
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.lit(seed), f"`{id_column}`").alias("key"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, decode = kept_lattices(shared.value)
        for batch in batches:
            sizes, at = pc.binary_length(batch.column("t")).fill_null(0).to_pylist(), 0
            while at < len(sizes):
                stop, held = at + 1, sizes[at]
                while stop < len(sizes) and stop - at < BATCH_ROWS and held + sizes[stop] <= BATCH_CHARS:
                    held += sizes[stop]
                    stop += 1
                part = batch.slice(at, stop - at)
                texts, out = [t or "" for t in part.column("t").to_pylist()], []
                for i, own in enumerate(sample(texts, part.column("key").to_pylist(), lattices, k)):
                    out += [(i, n + 1, len(x), round(lp, 6), round(v, 6), round(inc, 6), decode(x) == texts[i], x) for n, (x, lp, v, inc) in enumerate(own)]
                rows, *columns = zip(*out, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int32()))
                made = [part.column("id").take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(made, ["id", "draw", "n_pieces", "log_prob", "perturbed", "log_inclusion", "round_trip", "ids"])
                at = stop
            trim()

    schema = f"id {kind}, draw int, n_pieces long, log_prob double, perturbed double, log_inclusion double, round_trip boolean, ids array<int>"
    return rows.mapInArrow(draw, schema).withColumnRenamed("id", id_column)


def decode_samples(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """Adds the text of each row's pieces; null pieces give null."""
    shared = df.sparkSession.sparkContext.broadcast(load_pieces(model))

    @F.pandas_udf("string")
    def text(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = Decoder(shared.value)
        for batch in series:
            yield pd.Series([None if x is None else decode(x) for x in batch], dtype=object)

    return df.withColumn(out, text(F.col(f"`{ids}`")))


def op1_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_samples(table(spark, sf_dir, "documents"))
