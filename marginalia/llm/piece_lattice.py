"""Lattices of SentencePiece pieces over many strings at once, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Multiplier of the rolling hash of code points, and the first of those of the tables.
BASE = np.uint64(0x9E3779B97F4A7C15)
SALT = 0xC2B2AE3D27D4EB4F
#: Bits of a table's slots: a few tables of 3 MB hold all prefixes of 32,000 pieces.
SLOT_BITS = 18
MARK = "▁"


class Pieces:
    """A model's pieces: their bytes, their log weights, and a table of all their prefixes.

    The weight of a piece falls with its rank in the model as a power law, ``(rank + 2) ** -power``:
    the model's own scores are ranks, not probabilities. Byte pieces stand only for characters that
    no piece covers; such a character is one edge, numbered ``size`` + its code point.
    """

    def __init__(self, model_path: str, power: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        bytes_of = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(MARK in names[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece with a space after another character would cross the units of a text")
        self.bytes = [bytes_of.get(i, n.replace(MARK, " ").encode()) for i, n in enumerate(names)]
        ranks = np.array([max(0.0, -sp.get_score(i)) for i in range(self.size)])
        self.weights = -power * np.log(np.minimum(ranks, self.size) + 2)
        self.fallback = -power * np.log(self.size + 2.0)
        prefixes: dict[str, int] = {}
        for i in plain:
            for k in range(1, len(names[i])):
                prefixes.setdefault(names[i][:k], -1)
        for i in plain:
            prefixes[names[i]] = i
        self.longest = max(map(len, prefixes), default=1)
        hashes = np.array([self._hash(p) for p in prefixes], dtype=np.uint64)
        values = np.fromiter(prefixes.values(), dtype=np.int64, count=len(prefixes))
        self.tables, salt = [], SALT
        while len(hashes):  # what finds its slot taken goes into the next table
            slots = (hashes * np.uint64(salt)) >> np.uint64(64 - SLOT_BITS)
            _, first = np.unique(slots, return_index=True)
            keys, found = np.zeros(1 << SLOT_BITS, dtype=np.uint64), np.full(1 << SLOT_BITS, -2, dtype=np.int32)
            keys[slots[first]], found[slots[first]] = hashes[first], values[first]
            self.tables.append((np.uint64(salt), keys, found))
            rest = np.ones(len(hashes), dtype=bool)
            rest[first] = False
            hashes, values, salt = hashes[rest], values[rest], salt * int(BASE) & (1 << 64) - 1

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hashed string; -1 for a mere prefix of pieces, -2 for neither."""
        out = np.full(len(hashes), -2, dtype=np.int64)
        for salt, keys, found in self.tables:
            slots = ((hashes * salt) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            out = np.where((out == -2) & (keys[slots] == hashes), found[slots], out)
        return out


@dataclass
class Lattice:
    """Edges in order of their start node. ``first[n]:first[n + 1]`` are those of node n; ``chance``
    is an edge's probability given its node, ``cum`` the running sum of these; a path that is at
    node n is done if n is an ``end``. ``start`` is the first node of each string."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    chance: np.ndarray
    cum: np.ndarray


def build(pieces: Pieces, points: np.ndarray, sizes: np.ndarray) -> Lattice:
    """The lattice of strings of code points that stand in a row; every string has one at least."""
    unit = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    togo = ends[unit] - np.arange(len(points))  # characters to the string's end
    node = np.arange(len(points)) + unit  # a string has one node more than characters
    n_nodes = len(points) + len(sizes)
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    alive, hashes = np.arange(len(points)), np.zeros(len(points), dtype=np.uint64)
    for length in range(1, pieces.longest + 1):
        hashes = hashes * BASE + points[alive + length - 1].astype(np.uint64) + np.uint64(1)
        piece = pieces.find(hashes)
        if length == 1:
            piece_or = np.where(piece >= 0, piece, pieces.size + points)
            found.append((node, piece_or, 1))
        else:
            some = piece >= 0
            found.append((node[alive[some]], piece[some], length))
        on = (piece > -2) & (togo[alive] > length)
        alive, hashes = alive[on], hashes[on]
        if not len(alive):
            break
    count = np.zeros(n_nodes + 1, dtype=np.int64)
    for at, _, _ in found:
        count[at + 1] += 1
    first = np.cumsum(count)
    total = int(first[-1])
    target, which, ptr = np.empty(total, dtype=np.int32), np.empty(total, dtype=np.int32), first[:-1].copy()
    for at, piece, length in found:
        place = ptr[at]
        ptr[at] += 1
        target[place], which[place] = at + length, piece
    weight = np.where(which < pieces.size, pieces.weights[np.minimum(which, pieces.size - 1)], pieces.fallback)

    # Backward sums, from the strings' ends on; nodes as far from an end together.
    mass = np.zeros(n_nodes)
    order = np.argsort(togo, kind="stable")
    cuts = np.searchsorted(togo[order], np.arange(1, int(togo.max(initial=0)) + 2))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        at = node[order[a:b]]
        n = first[at + 1] - first[at]
        begin = np.cumsum(n) - n
        edges = np.repeat(first[at] - begin, n) + np.arange(int(n.sum()))
        value = weight[edges] + mass[target[edges]]
        top = np.maximum.reduceat(value, begin)
        mass[at] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), begin))
    source = np.repeat(np.arange(n_nodes, dtype=np.int32), np.diff(first))
    chance = np.exp(weight + mass[target] - mass[source])
    running = np.cumsum(chance)
    cum = running - np.append(0.0, running)[first[source]]
    last = first[1:][np.diff(first) > 0] - 1
    cum[last] = np.inf
    return Lattice(np.cumsum(sizes + 1) - sizes - 1, np.diff(first) == 0, first, target, which, np.minimum(chance, 1.0), cum)


def uniform(keys: np.ndarray, stream: np.ndarray | int, index: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1), each a function of its row key, stream and index alone."""
    x = keys + np.asarray(stream, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def walk(lattice: Lattice, nodes: np.ndarray, keys: np.ndarray, stream: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, counts): a path drawn from each node to its string's end, edges of all paths in a row.

    ``index`` numbers the walkers of a row key; step s of walker i draws number (i << 32) + s.
    """
    counts = np.zeros(len(nodes), dtype=np.int64)
    active, at, steps = np.flatnonzero(~lattice.end[nodes]), nodes, []
    at = nodes[active]
    step = 0
    while len(active):
        u = uniform(keys[active], stream[active], (index[active] << 32) + step)
        edge = lattice.first[at]
        low = np.flatnonzero(lattice.cum[edge] < u)
        while len(low):
            edge[low] += 1
            low = low[lattice.cum[edge[low]] < u[low]]
        steps.append((active, edge))
        counts[active] += 1
        at = lattice.target[edge]
        on = ~lattice.end[at]
        active, at = active[on], at[on]
        step += 1
    begin = np.cumsum(counts) - counts
    edges = np.empty(int(counts.sum()), dtype=np.int64)
    for k, (who, edge) in enumerate(steps):
        edges[begin[who] + k] = edge
    return edges, counts
