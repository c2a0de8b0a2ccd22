"""Byte-pair encoding of one very long piece in segments, with the ids that the whole piece has.

A segment's last tokens are not to be trusted, as what follows could have merged with them.  The next segment
therefore starts at a token end of the one before it, well before its end, and the two are joined at the
first token end of the overlap that both have, if they have a second one after it.  No merge can cross such a
place: a token end that a run of the merges keeps splits the run into two that do not see each other, so the
stretch between the two common ends is merged alike with either neighbour, and a merge across the first of
them, had there been one, would have happened in the second segment too.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

SEGMENT = 1 << 16  # bytes encoded at once
OVERLAP = 1 << 10  # at least as many bytes are encoded twice; more where the two do not agree


def encode_long(data: bytes, encode: Callable[[bytes, bool], tuple[np.ndarray, np.ndarray]], segment: int = SEGMENT,
                overlap: int = OVERLAP) -> np.ndarray:
    """Ids of ``data``; ``encode(part, last)`` gives a part's ids and the bytes of each token."""
    def run(a: int, size: int) -> tuple[np.ndarray, np.ndarray, int]:
        b = min(len(data), a + size)
        ids, sizes = encode(data[a:b], b == len(data))
        return ids, a + np.cumsum(sizes), b

    out: list[np.ndarray] = []
    settled = 0  # a token end of the whole piece; ids and ends are those of a segment from there to b
    ids, ends, b = run(0, segment)
    while b < len(data):
        back = overlap
        while True:
            k = int(np.searchsorted(ends, b - back, "right")) - 1
            begin = int(ends[k]) if k >= 0 else settled
            more, more_ends, more_b = run(begin, max(segment, 2 * back) if begin > settled else 2 * (b - settled))
            both = np.intersect1d(ends[(ends > begin) & (ends < b)], more_ends[more_ends < b], assume_unique=True)
            if begin == settled or len(both) > 1:
                break
            back *= 2
        if begin == settled:  # nothing earlier to go back to: the longer segment takes the place of the other
            ids, ends, b = more, more_ends, more_b
            continue
        settled = int(both[0])
        out.append(ids[:int(np.searchsorted(ends, settled, "right"))])
        cut = int(np.searchsorted(more_ends, settled, "right"))
        ids, ends, b = more[cut:], more_ends[cut:], more_b
    return np.concatenate([*out, ids])
