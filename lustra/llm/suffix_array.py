"""Linear-time suffix sorting by grouping.

Phase 1 gathers suffixes by their Lyndon prefix: groups are processed in descending order, each
suffix of a group follows its previous-smaller pointer, and the suffixes so reached move to new
groups just above their old one.  Phase 2 emits the order inside each group in one ascending scan
along the same pointers.  Nothing is renamed and nothing recurses.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order.  Symbols are integers >= 0.

    An empty text gives an empty list.
    """
    n = len(text)
    if n == 0:
        return []
    symbols = [x + 1 for x in text]
    symbols.append(0)
    n += 1
    # Groups lie side by side in sa; first[i] is where the group of suffix i starts.
    sa = sorted(range(n), key=symbols.__getitem__)
    at = [0] * n
    first = [0] * n
    size = [0] * n
    start, last = 0, symbols[sa[0]]
    for r, i in enumerate(sa):
        if symbols[i] != last:
            start, last = r, symbols[i]
        at[i] = r
        first[i] = start
        size[start] += 1

    smaller = [-1] * n
    hi = n - 1
    while hi >= 0:
        lo = first[sa[hi]]
        group = sa[lo : hi + 1]
        if len(group) > 1:
            group.sort()
        reached: dict[int, int] = {}
        for i in group:
            p = i - 1
            while p >= 0 and first[p] >= lo:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        if len(reached) == 1:
            classes = [list(reached)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, k in reached.items():
                by_count.setdefault(k, []).append(p)
            classes = [by_count[k] for k in sorted(by_count, reverse=True)]
        for members in classes:
            ends: dict[int, int] = {}
            for p in members:
                old = first[p]
                end = ends.get(old)
                if end is None:
                    end = ends[old] = old + size[old]
                # To the tail of its old group, before those that have moved already.
                size[old] -= 1
                tail = old + size[old]
                here, other = at[p], sa[tail]
                sa[here], sa[tail] = other, p
                at[other], at[p] = here, tail
            for old, end in ends.items():
                new = old + size[old]
                if new != old:
                    size[new] = end - new
                    for r in range(new, end):
                        first[sa[r]] = new
                else:
                    size[old] = end - old
        hi = lo - 1

    # first[i] is final; the next free place of each group.
    out = [-1] * n
    free = list(range(n))
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    free[first[n - 1]] += 1
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not done[j]:
            g = first[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = smaller[j]
    return out[1:]
