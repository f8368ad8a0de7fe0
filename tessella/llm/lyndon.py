"""Suffix arrays by linear grouping, of many strings at once.

Phase one refines groups of suffixes, the first ones by first letter, until a group holds the suffixes with one Lyndon prefix.
Groups are taken in descending order. Each suffix of the group at hand gets a pointer to the nearest suffix before it that is
in a lower group (its previous smaller one); the suffixes pointed to move to new groups right above their old ones, higher the
more pointers they got. Phase two reads the suffix array from its start: the suffix before the one read, and then those along
its pointers, are the next ones of their groups, until one is met that has its place already. Nothing is renamed or sorted
again at any depth.

All strings are worked on side by side, a group of each (or, in phase two, a suffix of each) at a time, so that every step is
one array operation over thousands of strings. Cost is linear in the total length if the strings of a call are of like length.
"""

from __future__ import annotations

import numpy as np


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for the next."""
    total = int(length.sum())
    return np.arange(total) + np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)


def suffix_arrays(letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix arrays of the strings letters[bounds[k]:bounds[k + 1]], one after the other, as places in letters.

    Each string must end with a letter that is smaller than all its others and occurs once."""
    count, size = len(bounds) - 1, np.diff(bounds)
    string = np.repeat(np.arange(count), size)
    total = len(letters)
    # Place 0 of every string is a stop that is lower than all groups; so places are shifted by the string's number plus 1.
    place = np.arange(total) + string + 1
    stop = bounds[:-1] + np.arange(count)
    code = string * (int(letters.max()) + 1 if total else 1) + letters
    order = np.argsort(code, kind="stable")
    slots = place[order]  # suffixes in the order of their groups
    head = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
    tail = np.concatenate([head[1:], [total]])
    group = np.full(total + count, -1)  # of each place: the first slot of its group
    group[slots] = np.repeat(head, tail - head)
    slot = np.full(total + count, -1)
    slot[slots] = np.arange(total)
    end = np.zeros(total, dtype=np.int64)  # of each group, at its first slot
    end[head] = tail
    pointer = np.full(total + count, -1)

    upto, floor = bounds[1:].copy(), bounds[:-1].copy()
    while len(upto):
        start = group[slots[upto - 1]]
        length = upto - start
        members = slots[_runs(start, length)]
        low = np.repeat(start, length)
        at, open_ = members - 1, np.arange(len(members))
        while len(open_):
            g, bar = group[at[open_]], low[open_]
            over = g >= bar
            open_, g, bar = open_[over], g[over], bar[over]
            here = at[open_]
            at[open_] = np.where(g > bar, pointer[here], here - 1)
        pointer[members] = at
        to = at[group[at] >= 0]
        if len(to):
            hit, times = np.unique(to, return_counts=True)
            of = group[hit]
            by = np.lexsort((times, of))
            hit, times, of = hit[by], times[by], of[by]
            new = np.concatenate([[True], of[1:] != of[:-1]])
            first = np.flatnonzero(new)
            moved = np.diff(np.concatenate([first, [len(of)]]))
            owner = of[first]
            finish = end[owner]
            target = _runs(finish - moved, moved)  # the last slots of each old group
            away = slots[target]
            was = slot[hit]
            # Who stands there without moving takes the slots that movers leave.
            slot[hit] = -2
            stays = away[slot[away] != -2]
            left = was[was < np.repeat(finish - moved, moved)]
            if len(stays):
                left_owner = np.repeat(owner, moved)[was < np.repeat(finish - moved, moved)]
                left = left[np.lexsort((left, left_owner))]
                slots[left] = stays
                slot[stays] = left
            slots[target] = hit
            slot[hit] = target
            end[owner] = finish - moved
            step = np.flatnonzero(new | np.concatenate([[True], times[1:] != times[:-1]]))
            width = np.diff(np.concatenate([step, [len(hit)]]))
            group[hit] = np.repeat(target[step], width)
            end[target[step]] = target[step] + width
        upto = start
        on = upto > floor
        upto, floor = upto[on], floor[on]

    out = np.full(total, -1)
    free = np.arange(total)  # at a group's first slot: its next free one
    done = np.zeros(total + count, dtype=bool)
    done[stop] = True
    last = bounds[1:] + np.arange(count)
    out[bounds[:-1]] = last
    done[last] = True
    read, until, now = bounds[:-1].copy(), bounds[1:], np.full(count, -1)
    while len(read):
        fetch = now < 0
        now = np.where(fetch, out[np.minimum(read, until - 1)] - 1, now)
        read = read + fetch
        fresh = ~done[now]
        put = now[fresh]
        g = group[put]
        out[free[g]] = put
        free[g] += 1
        done[put] = True
        now[fresh] = pointer[put]
        now[~fresh] = -1
        on = (now >= 0) | (read < until)
        if not on.all():
            read, until, now = read[on], until[on], now[on]
    return out - string - 1
