"""Context-tree weighting over binary-decomposed bytes, as numpy on sorted arrays.

A byte is eight binary decisions; each of the 255 decision nodes has a context tree over the `DEPTH` preceding bytes,
the latest first. At every tree node that training has visited a Krichevsky-Trofimov estimate competes with the
product of its children's weighted probabilities, one half each, so the prediction mixes the estimates of all depths on
the path. Below the deepest visited node there is nothing to mix: it counts as a leaf, and its own estimate takes all
that is left. Every context that has come is held, none is pruned.

A gram is a context with the byte that follows. The grams of one packet share their two latest context bytes; all nodes
from depth 2 on are in one packet, and are visited by no other. What packets have in common, the root and the 256
contexts of one byte, is the `Top`: it takes at most 255 sums of each packet (`top_sums`), so its size is fixed.

A text ends with the byte `END`, which UTF-8 never has; a text that has it all the same is escaped, so the
probabilities of all texts sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

DEPTH = 5
END = b"\xff"
#: Depth of the contexts that the grams of a packet share.
SHARED = 2


def escaped(text: bytes) -> bytes:
    """`text` without the byte END, and different for different texts; UTF-8 stays as it is."""
    return text.replace(b"\xfe", b"\xfe\x00").replace(END, b"\xfe\x01") if b"\xfe" in text or END in text else text


def gram_codes(parts: list[bytes], before: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the parts: its context, the latest byte in the highest place, then the byte itself. `before`:
    the DEPTH bytes before each part. Second: the parts' lengths."""
    lengths = np.array([len(t) for t in parts], np.int64)
    stream = np.frombuffer(b"".join(x for pair in zip(before, parts, strict=True) for x in pair), np.uint8)
    codes = np.zeros(max(len(stream) - DEPTH, 0), np.uint64)
    for k in range(1, DEPTH + 1):
        codes = (codes << np.uint64(8)) | stream[DEPTH - k : len(stream) - k]
    codes = (codes << np.uint64(8)) | stream[DEPTH:]
    starts = np.cumsum(lengths + DEPTH)[:-1]  # of what stands before the second part and so on
    inside = np.ones(len(codes), bool)
    for k in range(DEPTH):
        inside[starts - DEPTH + k] = False
    return codes[inside], lengths


def tally(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with their summed weights."""
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    return codes[starts], np.add.reduceat(weights, starts) if len(starts) else weights


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x >= 0.5, by Stirling's series at x + 6."""
    z = x + 6
    over = 1 / z
    square = over * over
    below = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    return (z - 0.5) * np.log(z) - np.log(below) - z + 0.5 * np.log(2 * np.pi) + over * (1 / 12 - square * (1 / 360 - square / 1260))


def _log_kt_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


_SMALL = 64
_TABLE = _log_kt_of(*(x.astype(np.float64) for x in np.indices((_SMALL, _SMALL))))
_TABLE[0, 0] = 0.0


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log Krichevsky-Trofimov probability of that many zeros and ones."""
    out = _TABLE[np.minimum(zeros, _SMALL - 1), np.minimum(ones, _SMALL - 1)]
    large = (zeros >= _SMALL) | (ones >= _SMALL)
    out[large] = _log_kt_of(zeros[large].astype(np.float64), ones[large].astype(np.float64))
    return out


def _keys(codes: np.ndarray, level: int) -> np.ndarray:
    """Context and decision node of `level` (1 to 255) of each gram; ascending if the grams are."""
    return (codes & ~np.uint64(255)) | np.uint64(1 << level) | ((codes & np.uint64(255)) >> np.uint64(8 - level))


def _cut(codes: np.ndarray) -> np.ndarray:
    """Grams without their oldest context byte, which stands just before the byte that follows."""
    return ((codes >> np.uint64(16)) << np.uint64(8)) | (codes & np.uint64(255))


class _Level(NamedTuple):
    """The visited nodes of one level of decisions at one depth: keys, ascending; share: the posterior of the node's own
    estimate; one: that estimate of a one."""

    keys: np.ndarray
    share: np.ndarray
    one: np.ndarray


def mixed_logs(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes with children, and the posterior of their own estimates."""
    own = log_kt(zeros, ones)
    both = np.logaddexp(own, below) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


def levels(codes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, list[_Level], np.ndarray]]:
    """For each level of decisions its nodes at the depths from SHARED on. Third, of those at depth SHARED: numbers of
    zeros and ones and log weighted probabilities, as columns.

    `codes`: distinct grams, ascending, whole packets; `counts`: how often each came in training, never for some."""
    codes, counts = codes[counts > 0], counts[counts > 0]
    grams = [(codes, counts)]
    for _ in range(DEPTH - SHARED):
        grams.insert(0, tally(_cut(grams[0][0]), grams[0][1]))
    for level in range(8):
        nodes, under, sums = [], None, np.zeros((0, 3))
        for held, seen in grams[::-1]:
            keys = _keys(held, level)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
            bit = (held >> np.uint64(7 - level)) & np.uint64(1) > 0
            ones = np.add.reduceat(np.where(bit, seen, 0), starts) if len(starts) else seen
            zeros = (np.add.reduceat(seen, starts) if len(starts) else seen) - ones
            keys = keys[starts]
            if under is None:
                log, share = log_kt(zeros, ones), np.ones(len(keys))
            else:
                log, share = mixed_logs(zeros, ones, np.bincount(np.searchsorted(keys, _cut(under[0])), under[1], len(keys)))
            nodes.insert(0, _Level(keys, share, (ones + 0.5) / (zeros + ones + 1)))
            under, sums = (keys, log), np.stack([zeros, ones, log], 1)
        yield level, nodes, sums


def top_sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What whole packets add to the Top: keys (latest byte, decision), ascending, and rows of zeros, ones, logs."""
    total = np.zeros((1 << 16, 3))
    for _, nodes, sums in levels(codes, counts):
        keys = nodes[0].keys
        at = (((keys >> np.uint64(8 * SHARED)) << np.uint64(8)) | (keys & np.uint64(255))).astype(np.int64)
        for k in range(3):
            total[:, k] += np.bincount(at, sums[:, k], 1 << 16)
    held = np.flatnonzero(total[:, 0] + total[:, 1])
    return held, total[held]


def gram_logs(codes: np.ndarray, counts: np.ndarray, top: Top) -> np.ndarray:
    """log10 of the probability of each gram's last byte after its context; arguments as of `levels`."""
    total = np.zeros(len(codes))
    at = [codes]
    for _ in range(DEPTH - SHARED):
        at.insert(0, _cut(at[0]))
    first = (codes >> np.uint64(8 * DEPTH)).astype(np.int64)
    for level, nodes, _ in levels(codes, counts):
        decision = (_keys(codes, level) & np.uint64(255)).astype(np.int64)
        settled, left, leaf = (x[first, decision] for x in (top.settled, top.left, top.leaf))
        rows = np.arange(len(codes))
        for held, grams in zip(nodes, at, strict=True):
            if not len(held.keys):
                break
            keys = _keys(grams[rows], level)
            place = np.minimum(np.searchsorted(held.keys, keys), len(held.keys) - 1)
            found = held.keys[place] == keys
            rows, place = rows[found], place[found]
            leaf[rows] = settled[rows] + left[rows] * held.one[place]
            settled[rows] += left[rows] * held.share[place] * held.one[place]
            left[rows] *= 1 - held.share[place]
        bit = (codes >> np.uint64(7 - level)) & np.uint64(1) > 0
        total += np.log10(np.where(bit, leaf, 1 - leaf))
    return total


class Top:
    """The root and the contexts of one byte. For each such context and decision: settled: the part of the prediction
    of a one that is settled there; left: the share that is left to mix; leaf: the prediction if nothing deeper is
    visited."""

    def __init__(self, keys: np.ndarray, sums: np.ndarray):
        """What `top_sums` returned, added up over all packets."""
        zeros, ones, below = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((256, 256))
        for at, x in zip((zeros, ones, below), sums.T, strict=True):
            at.reshape(-1)[keys] = x
        log, share = mixed_logs(zeros, ones, below)
        visited, estimate = zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1)
        root = zeros.sum(0), ones.sum(0)
        _, root_share = mixed_logs(*root, np.where(visited, log, 0.0).sum(0))
        root_one = (root[1] + 0.5) / (root[0] + root[1] + 1)
        before = root_share * root_one
        self.leaf = np.where(visited, before + (1 - root_share) * estimate, root_one)
        self.settled = before + (1 - root_share) * share * estimate
        self.left = (1 - root_share) * (1 - share)


def packet_of(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(8 * (DEPTH - SHARED + 1))).astype(np.int64)
