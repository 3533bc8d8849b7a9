"""Tables and plain versions that several tests of the text operators share."""

from __future__ import annotations

import collections

from test_llm import LONG, lowered, table, texts, words_of

__all__ = ["LONG", "lowered", "plain_roots", "table", "texts", "words_of"]


def plain_roots(ids, linked):
    """For each row the smallest id that it reaches."""
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        root[find(a)] = find(b)
    members = collections.defaultdict(list)
    for k, i in enumerate(ids):
        members[find(k)].append(i)
    least = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    return [least[find(k)] for k in range(len(ids))]
