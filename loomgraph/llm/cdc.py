"""Content-defined chunking: cut where a gear rolling hash of the last 32 bytes has zero low bits."""

from __future__ import annotations

import numpy as np

from loomgraph.llm.arrays import byte_table

REACH = 32


def gear(buf: np.ndarray) -> np.ndarray:
    """Gear hash of the last REACH bytes at each byte, as log2(REACH) shifted sums."""
    h = (byte_table(11)[buf] >> np.uint64(32)).astype(np.uint32)
    step = 1
    while step < REACH:
        shifted = h[:-step] << np.uint32(step)
        h[step:] += shifted
        step *= 2
    return h


def cuts(buf: np.ndarray, off: np.ndarray, bits: int = 10, least: int = 256, most: int = 8192) -> list[np.ndarray]:
    """Ends of the chunks of each text, relative to the text, the last being its length.

    Chunks have about least + 2**bits bytes, never more than `most` and, but for the last one, never
    fewer than `least`. An empty text has no chunk. A cut depends on 32 bytes before it and on the
    cut before, so equal passages get equal chunks after the first common cut.
    """
    h = gear(buf) if len(buf) else np.zeros(0, np.uint32)
    at = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    lo = np.searchsorted(at, off[:-1] + max(least, REACH))
    hi = np.searchsorted(at, off[1:])
    out = []
    for k in range(len(off) - 1):
        base, n = int(off[k]), int(off[k + 1] - off[k])
        ends: list[int] = []
        last = 0
        for c in at[lo[k] : hi[k]].tolist():
            c -= base
            while c - last > most:
                last += most
                ends.append(last)
            if c - last >= least and c < n:
                ends.append(c)
                last = c
        while n - last > most:
            last += most
            ends.append(last)
        if n > last:
            ends.append(n)
        out.append(np.array(ends, np.int64))
    return out
