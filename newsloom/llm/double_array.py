"""Double-array tries over word numbers, with lookups of many places at a time.

A state is a slot; from state ``s`` word ``w`` leads to slot ``base[s] + w`` if that slot's ``check`` is ``s``.
"""

from dataclasses import dataclass

import numpy as np

ROOT = 0
NONE = -1
_TRIES = 64


@dataclass
class DoubleArray:
    base: np.ndarray
    check: np.ndarray
    accepts: np.ndarray  # the number of the sequence that ends in a slot, or NONE

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places have a next state, and these states. Words of NONE lead nowhere."""
        slot = np.clip(self.base[state] + word, 0, len(self.check) - 1)
        go = (self.check[slot] == state) & (word != NONE)
        return go, slot[go]


def build(sequences: np.ndarray) -> DoubleArray:
    """The trie of the rows of ``sequences``, which are different and filled up with NONE; row i is accepted as i."""
    depth = sequences.shape[1]
    node = np.zeros(len(sequences), np.int64)
    parents, words, accepted = [np.array([NONE])], [np.array([NONE])], {}
    made = 1
    for level in range(depth):
        going = np.flatnonzero(sequences[:, level] != NONE)
        if not len(going):
            break
        keys = np.stack([node[going], sequences[going, level]], axis=1)
        edges, child = np.unique(keys, axis=0, return_inverse=True)
        node[going] = made + child.ravel()
        parents.append(edges[:, 0])
        words.append(edges[:, 1])
        made += len(edges)
    parent, word = np.concatenate(parents), np.concatenate(words)
    accepted = np.full(made, NONE)
    accepted[node] = np.arange(len(sequences))
    slot, base, check = _placed(parent, word)
    accepts = np.full(len(check), NONE)
    accepts[slot] = accepted
    return DoubleArray(base.astype(np.int32), check.astype(np.int32), accepts.astype(np.int32))


def _placed(parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slot for every node, so that the children of a node keep their words' distances and no two share a slot.

    Nodes of a level come in the order of their parents, so a node's children are neighbours. Large families are placed first,
    at random offsets; single children take whatever is left.
    """
    lot = np.random.default_rng(len(parent))
    first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])[1:]  # without the root, which is nobody's child
    sizes = np.diff(np.r_[first, len(parent)])
    width = int(word.max()) + 1 if len(parent) > 1 else 1
    used = np.zeros(2 * len(parent) + 2 * width, bool)
    used[ROOT] = True
    offset = np.zeros(len(parent), np.int64)  # by parent
    for i in np.argsort(-sizes, kind="stable"):
        if sizes[i] == 1:
            break
        children = word[first[i] : first[i] + sizes[i]]
        place = _fitting(used, children, lot)
        if place is None:
            used = np.r_[used, np.zeros(max(len(used) // 2, 2 * width), bool)]
            place = len(used) - width - int(lot.integers(width))
            while used[place + children].any():
                used = np.r_[used, np.zeros(width, bool)]
                place = len(used) - width
        used[place + children] = True
        offset[parent[first[i]]] = place
    single = first[sizes == 1]
    if len(single):
        free = np.flatnonzero(~used)
        if len(free) < len(single):
            free = np.r_[free, np.arange(len(used), len(used) + len(single) - len(free))]
        offset[parent[single]] = free[: len(single)] - word[single]
    slot = offset[parent] + word
    slot[0] = ROOT
    end = int(slot.max()) + 2  # one slot more, to which steps beyond the end are led
    base, check = np.zeros(end, np.int64), np.full(end, NONE)
    base[slot] = offset
    check[slot[1:]] = slot[parent[1:]]
    return slot, base, check


def _fitting(used: np.ndarray, children: np.ndarray, lot: np.random.Generator) -> int | None:
    """An offset at which all children fall on free slots, of some that are tried."""
    tries = lot.integers(0, len(used) - int(children.max()), _TRIES)
    free = ~used[tries[:, None] + children[None, :]].any(axis=1)
    return int(tries[free.argmax()]) if free.any() else None
