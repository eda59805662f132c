"""SuperMinHash signatures of many sets at a time.

Every element draws a random permutation of the slots, one place after the other, and offers the
value ``step + fraction`` to the slot it draws at that step; a slot keeps the least offer. A set is done
as soon as all its slots are taken, because later steps only offer more.
"""

import numpy as np

from newsloom.llm.bytewords import spread

_FREE = np.uint32(0xFFFFFFFF)
_STATE_BYTES = 4 << 20


def _draw(elements: np.ndarray, step: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """A place from ``step`` on and the offer there, with 24 bits of fraction."""
    lot = spread(elements, step)
    place = (lot >> np.uint64(40)) * np.uint64(slots - step) >> np.uint64(24)
    offer = (lot & np.uint64(0xFFFFFF)).astype(np.uint32) | np.uint32(step << 24)
    return place.astype(np.int64) + step, offer


def signatures(elements: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """One row of ``slots`` (256 at most) values per set; set i holds ``elements[offsets[i]:offsets[i + 1]]``.

    Empty sets have no offer in any slot.
    """
    sets = len(offsets) - 1
    held = np.full(sets * slots, _FREE, np.uint32)
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    place, offer = _draw(elements, 0, slots)
    np.minimum.at(held, owner * slots + place, offer)
    open_sets = np.flatnonzero((held.reshape(sets, slots) == _FREE).any(axis=1) & (np.diff(offsets) > 0))
    most = max(1, _STATE_BYTES // slots)
    at = 0
    sizes = np.diff(offsets)[open_sets]
    upto = np.cumsum(sizes)
    while at < len(open_sets):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        chosen = open_sets[at:to]
        mine = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in chosen])
        _later_steps(held, elements[mine], owner[mine], place[mine], slots)
        at = to
    return held.reshape(sets, slots)


def _later_steps(held: np.ndarray, elements: np.ndarray, owner: np.ndarray, first: np.ndarray, slots: int) -> None:
    slot_at = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
    row = np.arange(len(elements))
    slot_at[row, first] = 0
    table = held.reshape(-1, slots)
    for step in range(1, slots):
        place, offer = _draw(elements, step, slots)
        slot = slot_at[row, place]
        slot_at[row, place] = slot_at[row, step]
        np.minimum.at(held, owner * slots + slot, offer)
        if step % 4 == 0 or step < 4:
            waiting = np.unique(owner)
            waiting = waiting[(table[waiting] == _FREE).any(axis=1)]
            if not len(waiting):
                return
            stay = np.isin(owner, waiting)
            if stay.sum() * 2 < len(stay):
                elements, owner, slot_at = elements[stay], owner[stay], slot_at[stay]
                row = np.arange(len(elements))


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per band, different for equal values in different bands."""
    sets, slots = signature.shape
    parts = signature.reshape(sets, bands, slots // bands).astype(np.uint64)
    keys = np.tile(np.arange(bands, dtype=np.uint64), (sets, 1))
    for k in range(parts.shape[2]):
        keys = spread(keys ^ (parts[:, :, k] << np.uint64(20)), k)
    return keys.astype(np.int64)
