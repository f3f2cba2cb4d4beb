"""SentencePiece encoding and decoding: sampled segmentations without replacement.

Every way of writing a text as a chain of vocabulary pieces is a path through a lattice. A path's
probability is proportional to ``exp(alpha * sum of piece scores)``. Adding Gumbel noise to the log-probabilities
makes the k best perturbed paths a sample of k different segmentations without
replacement (Kool et al., 2019). They are found best first, as in A* sampling (Maddison et al., 2014): the best perturbed value
below a node, given that of its parent, is a truncated Gumbel variable, so each node's exact bound
can be drawn before its subtree is opened, and popping the best open node k times gives the k paths.
Noise is seeded by the row's key, so reruns and other partitionings give the same samples.

A text is cut into units between two characters that stand side by side in no piece, so no piece can cross a cut
and the text's lattice is the chain of its units' lattices, with all paths. The lattice of each different unit is
built once per task. A character without a piece is written as its bytes, so decoding is exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.text import mix, pieces, release

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Smoothing of the piece scores; the rank offset of Zipf's law that turns ranks into scores.
ALPHA, RANK_OFFSET = 0.4, 100.0
#: Nodes of unit lattices kept in a task before it starts anew.
KEPT_NODES = 1_500_000
PIECE_BYTES = 1 << 20
#: Rows of a result batch.
ROWS = 400

_LENGTH = np.ones(256, np.int64)
_LENGTH[0xC0:0xE0], _LENGTH[0xE0:0xF0], _LENGTH[0xF0:] = 2, 3, 4
_RANDOM = np.frombuffer(hashlib.shake_256(b"pieces").digest(8 * 256), np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, bytes as one number) of each character; a text's first byte starts one in any case."""
    lead = data & 0xC0 != 0x80
    lead[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(lead)
    chars = data[at].astype(np.uint64)
    size = np.diff(np.append(at, len(data)))
    for i in range(1, 4):
        wide = np.flatnonzero(size > i)
        chars[wide] |= data[at[wide] + i].astype(np.uint64) << np.uint64(8 * i)
    return at, chars


@dataclass(frozen=True)
class Vocabulary:
    """Piece bytes (a space for the model's space mark), ids and log scores, and the ids of single bytes."""

    names: list[bytes]
    ids: np.ndarray
    scores: np.ndarray
    bytes_ids: np.ndarray
    texts: list[bytes]

    def __post_init__(self) -> None:
        data = np.frombuffer(b"".join(self.names), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(n) for n in self.names])))
        at, chars = _characters(data, offsets)
        inside = np.ones(len(at), bool)
        inside[np.searchsorted(at, offsets[:-1])] = False
        first, second = chars[:-1][inside[1:]], chars[1:][inside[1:]]
        narrow = (first < 0x80) & (second < 0x80)
        table = np.zeros((128, 128), bool)
        table[first[narrow], second[narrow]] = True
        widths = np.array([len(t) for t in self.texts])
        object.__setattr__(self, "flat", np.frombuffer(b"".join(self.texts), np.uint8))
        object.__setattr__(self, "widths", widths)
        object.__setattr__(self, "places", np.cumsum(widths) - widths)
        # Neighbours inside pieces: a table for single bytes, sorted pairs for others.
        object.__setattr__(self, "near", table)
        object.__setattr__(self, "near_wide", np.unique((first[~narrow] << np.uint64(32)) | second[~narrow]))


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model with byte pieces. The ranks of merges become scores by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, ids, single, texts = [], [], np.zeros(256, np.int64), []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            single[value] = i
            texts.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            names.append(piece.replace("▁", " ").encode())
            ids.append(i)
            texts.append(names[-1])
    scores = -np.log(np.arange(len(ids)) + RANK_OFFSET)
    return Vocabulary(names, np.array(ids), scores, single, texts)


def _hash(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix((state + _RANDOM[byte]) * _BASE)


@dataclass
class Lattices:
    """Lattices of all units met so far; node 0.. of a unit are its byte positions, the last is its end."""

    vocabulary: Vocabulary
    alpha: float
    prefixes: np.ndarray = field(init=False)
    entry: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        names = self.vocabulary.names
        whole = {name: number for number, name in enumerate(names)}
        sizes = np.array([len(n) for n in names])
        padded = np.zeros((len(names), int(sizes.max())), np.uint8)
        padded[np.arange(padded.shape[1])[None, :] < sizes[:, None]] = np.frombuffer(b"".join(names), np.uint8)
        state, number = np.zeros(len(names), np.uint64), np.arange(len(names))
        keys, entries = [], []
        # All prefixes of a length at once; a prefix that is a piece itself has the piece's number.
        for i in range(padded.shape[1]):
            left = sizes[number] > i
            state, number = _hash(state[left], padded[number[left], i]), number[left]
            ends = sizes[number] == i + 1
            keys += [state[ends], state[~ends]]
            entries += [number[ends], np.full(int((~ends).sum()), -1)]
        keys, entries = np.concatenate(keys), np.concatenate(entries)
        order = np.lexsort((-entries, keys))
        first = np.ones(len(order), bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        self.prefixes, self.entry = keys[order][first], entries[order][first]
        # The first two bytes are looked up in tables.
        singles = _hash(np.zeros(256, np.uint64), np.arange(256))
        pairs = _hash(np.repeat(singles, 256), np.tile(np.arange(256), 256))
        self.first_states = (singles, pairs)
        self.first_entries = tuple(self._entries(states) for states in self.first_states)
        self.longest = max(map(len, whole))
        self.clear()

    def _entries(self, states: np.ndarray) -> np.ndarray:
        """Number of the piece that each prefix is, -1 where it is only a prefix, -2 where it is none."""
        at = np.minimum(np.searchsorted(self.prefixes, states), len(self.prefixes) - 1)
        return np.where(self.prefixes[at] == states, self.entry[at], -2)

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted unit hashes
        self.unit_node = np.zeros(0, np.int64)  # first node of each, in that order
        self.n_nodes = 0
        self.ends = np.zeros(0, bool)
        self.upto = np.zeros(0)  # chance of an edge and those before it
        self.edge_piece, self.edge_size, self.edge_log = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
        self.first_edge = np.zeros(1, np.int64)

    def units(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """First node of the lattice of each unit; builds those not met before."""
        if self.n_nodes > KEPT_NODES:
            self.clear()
        inside = np.arange(len(data)) - np.repeat(starts, sizes)
        power = np.full(int(sizes.max()), _BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        values = mix(np.add.reduceat(_RANDOM[data] * power[inside], starts) + sizes.astype(np.uint64))
        unique, first, inverse = np.unique(values, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != unique
        if new.any():
            self._build(data, starts[first[new]], sizes[first[new]], unique[new])
            at = np.searchsorted(self.known, unique)
        return self.unit_node[at][inverse]

    def _build(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, names: np.ndarray) -> None:
        width = sizes + 1
        base = np.cumsum(width) - width
        n = int(width.sum())
        offset = np.arange(n) - np.repeat(base, width)
        left = np.repeat(sizes, width) - offset  # bytes to the unit's end
        source = np.minimum(np.repeat(starts, width) + offset, len(data) - 1)
        byte = data[source]
        aligned = (left > 0) & ((byte < 0x80) | (byte >= 0xC0))
        node, state = np.flatnonzero(aligned), None
        state = np.zeros(len(node), np.uint64)
        found = []
        for size in range(1, self.longest + 1):
            keep = left[node] >= size
            node, state = node[keep], state[keep]
            if not len(node):
                break
            if size <= 2:
                code = byte[node].astype(np.int64) if size == 1 else byte[node].astype(np.int64) * 256 + byte[node + 1]
                entry = self.first_entries[size - 1][code]
                keep = entry > -2
                node, entry, state = node[keep], entry[keep], self.first_states[size - 1][code[keep]]
            else:
                state = _hash(state, byte[node + size - 1])
                entry = self._entries(state)
                keep = entry > -2
                node, state, entry = node[keep], state[keep], entry[keep]
            hit = entry >= 0
            found.append((node[hit], np.full(int(hit.sum()), size), entry[hit]))
        starts_here, size, piece = (np.concatenate(x) for x in zip(*found))
        # A character that is no piece is written as bytes.
        chars = np.flatnonzero(aligned)
        length = np.minimum(_LENGTH[byte[chars]], left[chars])
        single = np.zeros(n, bool)
        single[starts_here[size == np.minimum(_LENGTH[byte[starts_here]], left[starts_here])]] = True
        bare = ~single[chars]
        starts_here = np.concatenate((starts_here, chars[bare]))
        size, piece = np.concatenate((size, length[bare])), np.concatenate((piece, np.full(int(bare.sum()), -1)))
        order = np.argsort(starts_here * (self.longest + 1) - size)
        starts_here, size, piece = starts_here[order], size[order], piece[order]
        worst = self.vocabulary.scores[-1]
        weight = self.alpha * np.where(piece >= 0, self.vocabulary.scores[piece], worst * (size + 1))
        # Log-sum of all ways to the end, from the last position back.
        back = np.zeros(n)
        far = left[starts_here]
        by_left = np.argsort(far.astype(np.int16) if len(far) and far.max() < 1 << 15 else far, kind="stable")
        cuts = np.searchsorted(far[by_left], np.arange(1, int(sizes.max()) + 2))
        for d in range(len(cuts) - 1):
            edges = by_left[cuts[d] : cuts[d + 1]]
            if len(edges):
                head = starts_here[edges]
                begin = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
                value = weight[edges] + back[head + size[edges]]
                top = np.maximum.reduceat(value, begin)
                total = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(begin, len(head))))), begin)
                back[head[begin]] = top + np.log(total)
        log = weight + back[starts_here + size] - back[starts_here]
        begin = np.searchsorted(starts_here, np.arange(n + 1))
        total = np.concatenate(([0.0], np.cumsum(np.exp(log))))
        upto = total[1:] - total[begin[starts_here]]
        upto /= np.repeat(total[begin[1:]] - total[begin[:-1]], np.diff(begin))
        last = begin[1:][np.diff(begin) > 0] - 1
        upto[last] = 2.0
        upto = np.round(upto, 9)  # the same whatever was built along with it
        self.upto = np.concatenate((self.upto, upto))
        self.first_edge = np.concatenate((self.first_edge, self.first_edge[-1] + begin[1:]))
        self.edge_piece = np.concatenate((self.edge_piece, piece.astype(np.int32)))
        self.edge_size = np.concatenate((self.edge_size, size.astype(np.int32)))
        self.edge_log = np.concatenate((self.edge_log, np.minimum(log, 0.0)))
        self.ends = np.concatenate((self.ends, left == 0))
        known, nodes = np.concatenate((self.known, names)), np.concatenate((self.unit_node, base + self.n_nodes))
        order = np.argsort(known)
        self.known, self.unit_node = known[order], nodes[order]
        self.n_nodes += n

    def walk(self, node: np.ndarray, noise: _Noise) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A random path from each start node to its unit's end: (start number, node, edge) in order."""
        at, who = node.copy(), np.arange(len(node))
        out = []
        while True:
            live = ~self.ends[at]
            at, who = at[live], who[live]
            if not len(at):
                break
            want = noise.uniform(who)
            edge = self.first_edge[at]
            later = np.flatnonzero(want >= self.upto[edge])
            while len(later):  # a node has few edges; the longest, often the likeliest, come first
                edge[later] += 1
                later = later[want[later] >= self.upto[edge[later]]]
            out.append((who, at, edge))
            at = at + self.edge_size[edge]
        if not out:
            return who[:0], at[:0], at[:0]
        step = np.repeat(np.arange(len(out)), [len(x[0]) for x in out])
        who, at, edge = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(who * len(out) + step, kind="stable")  # merges the steps, each of which is in order
        return who[order], at[order], edge[order]


class _Noise:
    """Uniform numbers by (seed of the row, draw of the row): the same in any batch."""

    def __init__(self, seeds: np.ndarray) -> None:
        self.seeds, self.used = seeds, np.zeros(len(seeds), np.uint64)
        self.owner = np.zeros(0, np.int64)

    def of(self, owner: np.ndarray) -> _Noise:
        self.owner = owner
        return self

    def uniform(self, who: np.ndarray) -> np.ndarray:
        """One number for each of ``who`` (ascending); a row's draws are counted from where it stopped."""
        return self.draw(self.owner[who])

    def draw(self, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        begin = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        counts = np.diff(np.append(begin, len(rows)))
        number = np.arange(len(rows)) - np.repeat(begin, counts)
        state = self.seeds[rows] + (self.used[rows] + number.astype(np.uint64) + np.uint64(1)) * _BASE
        self.used[rows[begin]] += counts.astype(np.uint64)
        return ((mix(state) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def split_units(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, size) of the units of texts given one after another."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, chars = _characters(data, offsets)
    cut = np.ones(len(at), bool)
    before, after = chars[:-1], chars[1:]
    narrow = (before < 0x80) & (after < 0x80)
    cut[1:][narrow] = ~vocabulary.near[before[narrow], after[narrow]]
    wide = np.flatnonzero(~narrow)
    if len(wide) and len(vocabulary.near_wide):
        pair = (before[wide] << np.uint64(32)) | after[wide]
        place = np.minimum(np.searchsorted(vocabulary.near_wide, pair), len(vocabulary.near_wide) - 1)
        cut[1:][wide] = vocabulary.near_wide[place] != pair
    cut[np.searchsorted(at, offsets[:-1][offsets[:-1] < len(data)])] = True
    begin = at[cut]
    return begin, np.diff(np.append(begin, len(data)))


def _truncated(location: np.ndarray | float, top: np.ndarray | float, uniform: np.ndarray | float):
    """Gumbel variables at ``location``, given that they are at most ``top``."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.log(np.exp(np.minimum(location - top, 700)) - np.log(uniform)))


@dataclass
class _Path:
    """A segmentation: its edges, and where they start."""

    nodes: np.ndarray
    edges: np.ndarray
    units: np.ndarray
    log: float
    value: float


def sample_piece(lattices: Lattices, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, k: int) -> list[tuple[list[_Path], float]]:
    """For each text up to k different paths, best first, and the best value left outside."""
    rows = len(offsets) - 1
    noise = _Noise(seeds)
    top = -np.log(-np.log(noise.draw(np.arange(rows))))  # Gumbel variable of all paths together
    begin, size = split_units(data, offsets, lattices.vocabulary)
    starts = lattices.units(data, begin, size) if len(begin) else begin
    bounds = np.searchsorted(begin, offsets)  # units of each text
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    who, nodes, edges = lattices.walk(starts, noise.of(owner))
    cuts = np.searchsorted(who, bounds)
    paths: list[list[_Path]] = []
    opened: list[list[tuple[float, int, int, tuple[int, ...]]]] = []  # value, path, position, edges already taken there

    log = lattices.edge_log[edges]
    total = np.concatenate(([0.0], np.cumsum(log)))
    uniform = noise.draw(owner[who])
    with np.errstate(divide="ignore"):
        rest = np.log(-np.expm1(log))
    prefix = total[:-1] - total[cuts[:-1]][owner[who]] if len(who) else log
    single = np.diff(lattices.first_edge)[nodes] == 1 if len(nodes) else np.zeros(0, bool)
    location = np.where(single, -np.inf, prefix + rest)
    values = _truncated(location, top[owner[who]], uniform) if len(who) else log
    for r in range(rows):
        a, b = cuts[r], cuts[r + 1]
        paths.append([_Path(nodes[a:b], edges[a:b], who[a:b], float(total[b] - total[a]), float(top[r]))])
        own = values[a:b]
        best = np.argpartition(own, -k)[-k:] if len(own) > k else np.arange(len(own))
        opened.append([(float(own[i]), 0, int(i), (int(edges[a + i]),)) for i in best if np.isfinite(own[i])])
    for _ in range(1, k):
        popped = []
        for r in range(rows):
            if opened[r]:
                i = max(range(len(opened[r])), key=lambda i: opened[r][i][0])
                popped.append((r, *opened[r].pop(i)))
        if not popped:
            break
        who_rows = np.array([p[0] for p in popped])
        choice, again = noise.draw(who_rows), noise.draw(who_rows)
        tails, tail_rows, first = [], [], []
        for j, (r, value, p, t, taken) in enumerate(popped):
            path = paths[r][p]
            node = int(path.nodes[t])
            a, b = lattices.first_edge[node], lattices.first_edge[node + 1]
            options = [e for e in range(a, b) if e not in taken]
            chance = np.exp(lattices.edge_log[options]).tolist()
            mass = sum(chance)
            want, i = choice[j] * mass, 0
            while want >= chance[i] and i < len(options) - 1:
                want, i = want - chance[i], i + 1
            edge = options[i]
            before = float(lattices.edge_log[path.edges[:t]].sum()) if t else 0.0
            left = sum(chance[:i] + chance[i + 1 :])
            if left > 0:
                location = before + math.log(left)
                bound = location - math.log(math.exp(min(location - value, 700.0)) - math.log(again[j]))
                opened[r].append((bound, p, t, (*taken, edge)))
            unit = int(path.units[t])
            tail = starts[unit : bounds[r + 1]].copy()
            tail[0] = node + lattices.edge_size[edge]
            tails.append(tail)
            tail_rows.append(np.full(len(tail), r))
            first.append((edge, node, unit, before + float(lattices.edge_log[edge])))
        owner_2 = np.concatenate(tail_rows)
        who_2, nodes_2, edges_2 = lattices.walk(np.concatenate(tails), noise.of(owner_2))
        tail_bounds = np.concatenate(([0], np.cumsum([len(t) for t in tails])))
        cuts_2 = np.searchsorted(who_2, tail_bounds)
        log = lattices.edge_log[edges_2]
        total = np.concatenate(([0.0], np.cumsum(log)))
        which = np.repeat(np.arange(len(popped)), np.diff(cuts_2))
        uniform = noise.draw(owner_2[who_2])
        start = np.array([f[3] for f in first])
        with np.errstate(divide="ignore"):
            rest = np.log(-np.expm1(log))
        single = np.diff(lattices.first_edge)[nodes_2] == 1 if len(nodes_2) else np.zeros(0, bool)
        location = np.where(single, -np.inf, start[which] + total[:-1] - total[cuts_2[:-1]][which] + rest)
        values = _truncated(location, np.array([p[1] for p in popped])[which], uniform)
        for j, (r, value, p, t, _) in enumerate(popped):
            path = paths[r][p]
            edge, node, unit, before = first[j]
            a, b = cuts_2[j], cuts_2[j + 1]
            number = len(paths[r])
            paths[r].append(_Path(
                np.concatenate((path.nodes[:t], [node], nodes_2[a:b])), np.concatenate((path.edges[:t], [edge], edges_2[a:b])),
                np.concatenate((path.units[:t], [unit], who_2[a:b] - tail_bounds[j] + unit)), before + float(total[b] - total[a]), value,
            ))
            own = values[a:b]
            best = np.argpartition(own, -k)[-k:] if len(own) > k else np.arange(len(own))
            opened[r] += [(float(own[i]), number, int(t + 1 + i), (int(edges_2[a + i]),)) for i in best if np.isfinite(own[i])]
    return [(paths[r], max((x[0] for x in opened[r]), default=-np.inf)) for r in range(rows)]


def decode_ids(vocabulary: Vocabulary, ids) -> bytes:
    texts = vocabulary.texts
    return b"".join([texts[i] for i in ids])


_SAMPLES = "doc_id long, sample int, ids array<int>, log_probability double, log_inclusion double, exact boolean"


def _sample(vocabulary: Vocabulary, k: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary, alpha)
        for batch in batches:
            for row, data, offsets in pieces(batch.column(2), PIECE_BYTES):
                seeds = batch.column(1).slice(row, len(offsets) - 1).to_numpy().astype(np.uint64)
                doc_ids = batch.column(0).slice(row, len(offsets) - 1).to_pylist()
                found = sample_piece(lattices, data, offsets, mix(seeds), k)
                for at in range(0, len(found), ROWS):
                    yield _batch(lattices, data, offsets, doc_ids, found, range(at, min(at + ROWS, len(found))))
                found = None
        lattices = batch = data = None
        release()

    return run


def _batch(lattices: Lattices, data: np.ndarray, offsets: np.ndarray, doc_ids: list, found: list, rows: range) -> pa.RecordBatch:
    """The samples of some texts: all their paths are written as ids, and decoded again, at once."""
    vocabulary = lattices.vocabulary
    owner = np.array([r for r in rows for _ in found[r][0]], np.int64)
    paths = [path for r in rows for path in found[r][0]]
    outside = np.array([found[r][1] for r in owner.tolist()])
    steps = np.concatenate(([0], np.cumsum([len(p.edges) for p in paths])))
    edges = np.concatenate([p.edges for p in paths])
    piece, size = lattices.edge_piece[edges], lattices.edge_size[edges].astype(np.int64)
    bare = piece < 0
    count = np.where(bare, size, 1)
    ids = np.repeat(vocabulary.ids[piece], count)
    upto, tokens = (np.concatenate(([0], np.cumsum(x))) for x in (size, count))
    if bare.any():
        # Where in the texts each step starts, and each byte of a step without a piece.
        start = upto[:-1] - np.repeat(upto[steps[:-1]], np.diff(steps)) + np.repeat(offsets[owner], np.diff(steps))
        at = np.repeat(start, count) + np.arange(len(ids)) - np.repeat(tokens[:-1], count)
        single = np.repeat(bare, count)
        ids[single] = vocabulary.bytes_ids[data[at[single]]]
    log = np.zeros(len(paths))
    some = np.flatnonzero(np.diff(steps))
    if len(some):
        log[some] = np.add.reduceat(lattices.edge_log[edges], steps[some])
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        far = log - outside
        inclusion = np.where(np.isneginf(outside), 0.0, np.where(far > -30, np.log(-np.expm1(-np.exp(np.minimum(far, 700.0)))), far))
    bounds = tokens[steps]
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
    columns = [
        pa.array([doc_ids[r] for r in owner.tolist()], pa.int64()), pa.array(np.concatenate([np.arange(1, len(found[r][0]) + 1) for r in rows]), pa.int32()),
        lists, pa.array(np.round(log, 9)), pa.array(np.round(inclusion, 6)), pa.array(_exact(vocabulary, ids, bounds, data, offsets, owner)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in _SAMPLES.split(", ")])


def _exact(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, offsets: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each list of ids decodes to its text."""
    width = vocabulary.widths[ids]
    upto = np.concatenate(([0], np.cumsum(width)))
    got, want = np.diff(upto[bounds]), np.diff(offsets)[owner]
    decoded = vocabulary.flat[np.repeat(vocabulary.places[ids] - upto[:-1], width) + np.arange(int(upto[-1]))]
    # Each list's bytes beside its text's, as far as the text goes.
    first = upto[bounds[:-1]]
    inside = np.arange(int(upto[-1])) - np.repeat(first, got)
    text = np.minimum(np.repeat(offsets[owner], got) + inside, max(len(data) - 1, 0))
    wrong = np.concatenate(([0], np.cumsum(decoded != data[text]))) if len(data) else np.zeros(int(upto[-1]) + 1, np.int64)
    return (got == want) & (wrong[upto[bounds[1:]]] == wrong[first])


def sample(docs: DataFrame, k: int = 2, alpha: float = ALPHA, seed: int = 8, model: str = MODEL) -> DataFrame:
    """Up to k different segmentations of every whole text of ``docs(doc_id, text)``, best perturbed value first.

    Columns: ``doc_id, sample`` (1..), ``ids, log_probability, log_inclusion`` (log-probability of being among the k
    samples, given the best value left outside), ``exact`` (decoding gives the text). A null or
    empty text has one segmentation without ids. Very long texts are sampled whole; one unit of a very long run without a cut
    takes memory in proportion to its length. The noise is seeded by ``seed``, id and text: repeated rows get the same samples.
    Other columns are ignored; an empty table gives an empty one.
    """
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_sample(load(model), k, alpha), _SAMPLES)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its ``ids`` in place of them; null ids give a null text. A column ``text`` is replaced."""
    vocabulary = load(model)
    others = [c for c in encoded.columns if c not in ("ids", "text")]
    kinds = dict(encoded.dtypes)

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else decode_ids(vocabulary, ids).decode(errors="replace") for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], names=["text", *batch.schema.names[1:]])

    # Plain names on the way: a name with a dot can't be passed to a map.
    renamed = encoded.select("ids", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    found = renamed.mapInArrow(run, ", ".join(["text string", *[f"c{i} {kinds[c]}" for i, c in enumerate(others)]]))
    return found.select("text", *[F.col(f"c{i}").alias(c) for i, c in enumerate(others)])
