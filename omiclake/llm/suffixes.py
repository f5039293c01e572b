"""Suffix sorting by linear grouping: no recursion and no renaming.

Suffixes are grouped by their Lyndon prefix. Groups are processed in descending order: the suffixes just before a group's
runs, found through pointers to the previous smaller suffix, have their prefixes extended by the runs' words
and move to a new group right above their own. Then one pass in ascending order emits each group's order.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of s (numbers of any order), in ascending order; a suffix that is another's prefix comes first."""
    n = len(s)
    if not n:
        return []
    ranks = {c: k for k, c in enumerate(sorted(set(s)))}
    group = [ranks[c] for c in s]
    members: list[list[int]] = [[] for _ in ranks]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(ranks) - 1))  # the next lower group of each
    above = [*range(1, len(ranks)), -1]
    previous, done = [-1] * n, bytearray(n)
    at = len(ranks) - 1
    while at >= 0:
        own = members[at] = [i for i in members[at] if group[i] == at]
        own.sort()
        for i in own:
            done[i] = 1
        count: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        if count:
            by_runs: dict[int, list[int]] = {}
            for j, k in count.items():
                if k in by_runs:
                    by_runs[k].append(j)
                else:
                    by_runs[k] = [j]
            for k in sorted(by_runs, reverse=True):
                moved: dict[int, int] = {}
                for j in by_runs[k]:
                    g = group[j]
                    to = moved.get(g)
                    if to is None:
                        moved[g] = to = len(members)
                        members.append([])
                        up = above[g]
                        below.append(g)
                        above.append(up)
                        above[g] = to
                        below[up] = to  # there is one above: the group at hand
                    members[to].append(j)
                    group[j] = to
        at = below[at]
    first, g, total = [0] * len(members), 0, 1
    while g >= 0:
        first[g] = total
        total += len(members[g])
        g = above[g]
    out, placed = [0] * (n + 1), bytearray(n)
    out[0] = n
    for i in range(n + 1):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[first[g]] = j
            first[g] += 1
            j = previous[j]
    return out[1:]


#: Bytes of a symbol.
STEP = 16


def repeated_windows(pieces: list[tuple[bytes, int, int, int]], lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each length and piece, the starts of its windows of so many bytes that occur twice or more in all pieces.

    pieces: bytes, the phase (equal windows of two pieces lie equally far from it, mod STEP), how often the piece
    itself occurs, and how many starts count. The suffixes sorted, once for all lengths, are those of 16-byte symbols in phase:
    windows have (length - 15) // 16 whole symbols, found by neighbours in the suffix array, and 15 to 30 bytes
    at their ends, which are compared exactly. Lengths must be 31 or more.
    """
    none = [np.zeros(0, np.int64) for _ in pieces]
    most = (max(lengths) - STEP + 1) // STEP
    data = np.frombuffer(b"".join(p[0] for p in pieces) + bytes(max(lengths)), np.uint8)
    size = np.array([len(p[0]) for p in pieces], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    head = np.array([p[1] % STEP for p in pieces], np.int64)
    many = np.maximum(0, (size - head) // STEP)
    owner = np.repeat(np.arange(len(pieces)), many)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    byte = at[owner] + head[owner] + index * STEP
    if not len(byte):
        return [none for _ in lengths]
    symbols = np.ascontiguousarray(data[byte[:, None] + np.arange(STEP)]).view("<u8")
    low, high = (np.unique(symbols[:, k], return_inverse=True)[1].astype(np.int64) for k in (0, 1))
    rank = np.unique(low * (int(high.max()) + 1) + high, return_inverse=True)[1] + len(pieces)
    # Each piece ends with a separator of its own.
    place = np.arange(len(rank)) + owner
    n = len(rank) + len(pieces)
    text = np.full(n + most, -1)
    text[place] = rank
    ends = np.cumsum(many) + np.arange(len(pieces))
    text[ends] = np.arange(len(pieces))
    order = np.array(suffix_array(text[:n].tolist()), np.int64)
    of = np.zeros(n, np.int64)
    of[place] = np.arange(len(rank))
    weight, starts = (np.array([p[k] for p in pieces], np.int64) for k in (2, 3))

    def of_length(length: int) -> list[np.ndarray]:
        whole = (length - STEP + 1) // STEP
        rest = length - whole * STEP
        full = np.zeros(n, bool)
        full[place] = index + whole <= many[owner]
        own = order[full[order]]
        if not len(own):
            return none
        same, a, b = np.ones(len(own) - 1, bool), own[:-1], own[1:]
        for t in range(whole):
            same &= text[a + t] == text[b + t]
        group = np.concatenate([[0], np.cumsum(~same)])
        symbol = of[own]
        keep = np.bincount(group, weight[owner[symbol]])[group] > 1
        symbol, group = symbol[keep], group[keep]
        start = (byte[symbol][:, None] - np.arange(STEP)).ravel()  # the whole symbols begin 0 to 15 bytes into the window
        who = np.repeat(owner[symbol], STEP)
        shift = np.tile(np.arange(STEP), len(symbol))
        key = np.repeat(group, STEP) * STEP + shift
        ok = (start >= at[who]) & (start < at[who] + starts[who]) & (start + length <= at[who + 1])
        start, who, shift, key = start[ok], who[ok], shift[ok], key[ok]
        if not len(start):
            return none
        # The rest: shift bytes before the whole symbols, and rest - shift bytes after them.
        t = np.arange(rest)
        ends_at = start[:, None] + np.where(t[None, :] < shift[:, None], t[None, :], t[None, :] + whole * STEP)
        words = np.pad(data[ends_at], ((0, 0), (0, (-rest) % 8))).view("<u8")
        by = np.lexsort([*words.T, key])
        new = (key[by][1:] != key[by][:-1]) | (words[by][1:] != words[by][:-1]).any(axis=1)
        run = np.concatenate([[0], np.cumsum(new)])
        again = np.zeros(len(by), bool)
        again[by] = np.bincount(run, weight[who[by]])[run] > 1
        who, start = who[again], start[again] - at[who[again]]
        by = np.lexsort([start, who])
        who, start = who[by], start[by]
        cut = np.searchsorted(who, np.arange(len(pieces) + 1))
        return [start[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]

    return [of_length(length) for length in lengths]
