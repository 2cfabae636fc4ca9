"""A suffix array in linear time: suffixes are grouped by their Lyndon prefix, then each group is put in order."""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """The suffixes of ``text`` in order. The last byte must be 0 and stand nowhere else.

    Grouping: groups begin as the suffixes of one first byte and are taken from the highest down. The
    previous smaller suffix of each member is the nearest one to its left that no group so far has
    taken; found along the pointers of those taken before. Such a suffix's prefix goes on with the
    group's prefix, once per member that points to it, so from each group the suffixes pointed to move
    to a new one just above it, a higher one for more members. When all are taken, a group holds the
    suffixes of one Lyndon prefix, and groups stand in order.

    Order: two suffixes of a group compare as what follows their common prefix. Each suffix that is
    emitted, from the lowest on, therefore puts those whose prefix ends where it begins next in their
    groups.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    previous = [-1] * n
    taken = bytearray(n)
    group = [0] * n
    members: list[list[int]] = []  # some may have moved on
    alive: list[int] = []  # how many have not
    length: list[int] = []
    above: list[int] = []  # the group just higher, and just lower, in order
    below: list[int] = []
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in first:
            first[c].append(i)
        else:
            first[c] = [i]
    for c in sorted(first):
        found, g = first[c], len(members)
        for i in found:
            group[i] = g
        members.append(found)
        alive.append(len(found))
        length.append(1)
        below.append(g - 1)
        above.append(g + 1)
    above[-1] = -1
    top = current = len(members) - 1
    while current >= 0:
        size = length[current]
        if alive[current] == 1:  # most groups, towards the end
            own = members[current]
            i = own[0] if len(own) == 1 else next(i for i in own if group[i] == current)
            members[current] = [i]
            taken[i] = 1
            p = i - 1
            while p >= 0 and taken[p]:
                p = previous[p]
            previous[i] = p
            moved = {(1, group[p]): [p]} if p >= 0 and alive[group[p]] > 1 else {}
            if p >= 0 and not moved:
                length[group[p]] += size
        else:
            own = [i for i in members[current] if group[i] == current]
            members[current] = own
            for i in own:
                taken[i] = 1
            moved = {}
            last, times = -1, 0
            for i in own:
                p = i - 1
                while p >= 0 and taken[p]:
                    p = previous[p]
                previous[i] = p
                if p == last:
                    times += 1
                else:
                    if last >= 0:
                        moved.setdefault((times, group[last]), []).append(last)
                    last, times = p, 1
            if last >= 0:
                moved.setdefault((times, group[last]), []).append(last)
        for times, g in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            found = moved[times, g]
            if len(found) == alive[g]:  # all that are left of a group move up where they are
                length[g] += times * size
                continue
            new = len(members)
            for i in found:
                group[i] = new
            members.append(found)
            alive[g] -= len(found)
            alive.append(len(found))
            length.append(length[g] + times * size)
            higher = above[g]
            above.append(higher)
            below.append(g)
            above[g] = new
            if higher >= 0:
                below[higher] = new
        current = below[current]

    # Where each group starts, from the lowest group up.
    lowest = top
    while below[lowest] >= 0:
        lowest = below[lowest]
    slot = [0] * len(members)
    at, g = 0, lowest
    while g >= 0:
        slot[g] = at
        at += len(members[g])
        g = above[g]
    out = [0] * n
    out[0] = n - 1
    for r in range(n):
        s = out[r]
        i = s - 1
        while i >= 0:
            g = group[i]
            if i + length[g] != s:
                break
            out[slot[g]] = i
            slot[g] += 1
            i = previous[i]
    return out
