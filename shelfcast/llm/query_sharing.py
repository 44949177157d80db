"""Shared term sets among many queries, and the graph along which they combine.

A query is a bag of terms; ``(term, count)`` is one of its literals. Literals
that occur in exactly the same queries form one group (a leaf). Then the two
nodes that most queries have in common become a new node, and take its place in
these queries, until no two are shared. So a sum over a shared set of terms is
computed once for all queries that hold it, and queries with the same terms are
one and the same node.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from typing import NamedTuple

#: Pairs of nodes that mining looks at. It bounds the work of planning; sums that are not shared
#: beyond it are computed query by query, with the same results.
MOST_PAIRS = 2_000_000


class SharingPlan(NamedTuple):
    """Nodes are numbered leaves first; every node stands after those it adds up."""

    #: For each leaf its literals (term, count).
    leaves: list[list[tuple[int, int]]]
    #: The two nodes that each further node adds up.
    sums: list[tuple[int, int]]
    #: For each query the nodes whose sum is its score.
    queries: list[list[int]]


def share(queries: list[list[int]], most_pairs: int = MOST_PAIRS) -> SharingPlan:
    """The plan of these queries, each a list of term numbers, with repeats."""
    holders: dict[tuple[int, int], list[int]] = defaultdict(list)
    for q, terms in enumerate(queries):
        for literal in sorted(Counter(terms).items()):
            holders[literal].append(q)
    groups: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
    for literal, of in holders.items():
        groups[tuple(of)].append(literal)
    members = [set() for _ in queries]
    for node, of in enumerate(groups):
        for q in of:
            members[q].add(node)

    shared: dict[tuple[int, int], set[int]] = defaultdict(set)
    sizes = [len(of) for of in groups]
    room = most_pairs
    for q, nodes in enumerate(members):
        common = sorted(n for n in nodes if sizes[n] > 1)
        if len(common) * (len(common) - 1) // 2 > room:
            continue
        room -= len(common) * (len(common) - 1) // 2
        for i, a in enumerate(common):
            for b in common[i + 1 :]:
                shared[a, b].add(q)
    heap = [(-len(of), pair) for pair, of in shared.items() if len(of) > 1]
    heapq.heapify(heap)
    sums: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        of = {q for q in shared.get(pair, ()) if pair[0] in members[q] and pair[1] in members[q]}
        if len(of) < 2:
            continue
        if len(of) < -count:
            shared[pair] = of
            heapq.heappush(heap, (-len(of), pair))
            continue
        node = len(groups) + len(sums)
        sums.append(pair)
        partners: dict[int, set[int]] = defaultdict(set)
        for q in of:
            members[q] -= set(pair)
            for other in members[q]:
                partners[other].add(q)
            members[q].add(node)
        del shared[pair]
        for other, both in partners.items():
            if len(both) > 1 and room > 0:
                room -= 1
                shared[other, node] = both
                heapq.heappush(heap, (-len(both), (other, node)))
    return SharingPlan(list(groups.values()), sums, [sorted(nodes) for nodes in members])
