"""Two-stage suffix sorting in numpy, to a fixed depth, and adjacent common prefixes.

Stage one directly sorts only the suffixes that are smaller than their successors (ternary partition around the first of a group
by common prefix length and next byte). Stage two induces all others: a scan over the first-byte buckets in ascending order hands each
placed suffix's predecessor, if that is larger, to the next free place of its own bucket. Order beyond the depth is arbitrary.
"""

from __future__ import annotations

import numpy as np

from .textkit import U64


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each position, its 8 bytes as a big-endian number (zeros beyond the end)."""
    w = np.zeros(len(data) + 8, U64)
    w[: len(data)] = data
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        w[: len(w) - step] = (w[: len(w) - step] << U64(shift)) | w[step:]
    return w[: len(data)]


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to depth. words: eight_bytes with at least depth + 8 zeros behind."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for d in range(0, depth, 8):
        x = words[a[live] + d] ^ words[b[live] + d]
        lead = np.full(len(x), 8, np.int64)
        differs = x != 0
        top = x[differs]
        lead[differs] = (top < U64(1 << 56)).astype(np.int64)
        for k in range(2, 8):
            lead[differs] += top < U64(1 << (64 - 8 * k))
        out[live] += lead
        live = live[~differs]
        if not len(live):
            break
    return np.minimum(out, depth)


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the last isn't)."""
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1].astype(np.int16))
    if n:
        step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return step[np.minimum(following, n - 1)] > 0


def direct_sort(data: np.ndarray, words: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that start at which, sorted by their first depth bytes."""
    order = which[np.argsort(words[which], kind="stable")]
    key = words[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else np.zeros(0, np.int64)
    live = np.arange(len(order))
    while True:
        size = np.bincount(group[live], minlength=int(group.max(initial=-1)) + 1) if len(live) else np.zeros(0, int)
        live = live[size[group[live]] > 1] if len(live) else live
        if not len(live):
            return order
        g = group[live]
        begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        local = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(g))))
        pivot, own = order[live][begins][local], order[live]
        lcp = common_prefix(words, own, pivot, depth)
        a, b = data[np.minimum(own + lcp, len(data) - 1)], data[np.minimum(pivot + lcp, len(data) - 1)]
        less, more = (lcp < depth) & (a < b), (lcp < depth) & (a > b)
        side = np.where(less, lcp, np.where(more, 2 * depth + 1 - lcp, depth)).astype(U64)
        code = (local.astype(U64) << U64(24)) | (side << U64(8)) | np.where(less | more, a, 0).astype(U64)
        place = np.argsort(code, kind="stable")
        order[live] = own[place]
        code = code[place]
        new = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])
        group = np.full(len(order), -1, np.int64)
        group[live] = new
        done = (side[place] == depth) & True  # equal to the pivot as far as the depth
        live = live[~done]
        # keep group numbers ascending along live
        if len(live):
            g = group[live]
            group[live] = np.concatenate([[0], np.cumsum(g[1:] != g[:-1])])


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of data (at least depth + 8 zero bytes at its end) sorted by their first depth bytes."""
    n = len(data)
    words = eight_bytes(data)
    small = smaller_than_successor(data)
    starts = np.flatnonzero(small[: n - depth - 8])
    placed = direct_sort(data, words, starts, depth)
    tail = np.flatnonzero(small[n - depth - 8 :]) + n - depth - 8  # in the padding: none, as zeros only fall or stay
    if len(tail):
        placed = np.concatenate([tail, placed])
    counts = np.bincount(data, minlength=256)
    begin = np.concatenate([[0], np.cumsum(counts)])
    small_of = np.bincount(data[placed], minlength=256)
    out = np.full(n, -1, np.int64)
    at = np.concatenate([[0], np.cumsum(small_of)])
    for c in np.flatnonzero(small_of).tolist():  # the smaller ones take the end of their bucket
        out[begin[c + 1] - small_of[c] : begin[c + 1]] = placed[at[c] : at[c + 1]]
    head = begin[:-1].copy()
    # the last suffix is larger than the empty one after it: first of its bucket
    out[head[data[-1]]] = n - 1
    head[data[-1]] += 1
    for c in np.flatnonzero(counts).tolist():
        done = begin[c]
        while True:
            stop = head[c]
            if done < stop:  # the induced part, in waves as it grows
                wave = out[done:stop]
                done = stop
            elif done < begin[c + 1] and done >= begin[c + 1] - small_of[c]:
                wave = out[done : begin[c + 1]]
                done = begin[c + 1]
            else:
                break
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            if not len(before):
                continue
            chars = data[before]
            order = np.argsort(chars, kind="stable")
            before, chars = before[order], chars[order]
            kinds, first, many = np.unique(chars, return_index=True, return_counts=True)
            out[np.repeat(head[kinds] - first, many) + np.arange(len(before))] = before
            head[kinds] += many
    return out
