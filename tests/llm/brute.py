"""Plain versions of the operators over a handful of rows, written without the operators' code."""

from __future__ import annotations

import re


def smallest_reachable(ids, links) -> dict:
    """id -> smallest id that links reach."""
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def shingles(text, k) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def jaccard(rows, k, percent) -> dict:
    """doc_id -> (set size, component) for rows of (doc_id, text) with distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    links = []
    for i, s in sets.items():
        meets = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    meets[j] = meets.get(j, 0) + 1
        links += [(i, j) for j, n in meets.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
    label = smallest_reachable(sets, links)
    return {i: (len(s), label[i]) for i, s in sets.items()}
