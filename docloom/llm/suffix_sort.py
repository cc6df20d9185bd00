"""Deep-shallow string sorting with common-prefix lengths.

Strings are sorted by multikey quicksort (three-way partitions on one byte at a time) down to a shallow
depth. Groups that still agree there are long common prefixes; each is ordered by a blind trie, which
compares a new string with one other string only and keeps nothing but branching depths and bytes.
"""

from __future__ import annotations

SHALLOW = 16


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "sons")

    def __init__(self, depth: int, sons: dict) -> None:
        self.depth, self.sons = depth, sons


def blind_trie(strings: list[bytes], group: list[int], out: list[tuple[int, int]], before: int) -> None:
    """Append (string number, common prefix with the string before) of a group in order; before: that of the first.

    The end of a string is -1, so a string that begins another one comes first. Leaves are lists of equal strings.
    """
    root: _Node | list = [group[0]]
    for i in group[1:]:
        s = strings[i]
        node = root
        while isinstance(node, _Node):  # blindly: branching bytes only
            sons = node.sons
            node = sons.get(s[node.depth] if node.depth < len(s) else -1) or next(iter(sons.values()))
        other = strings[node[0]]
        n = common_prefix(s, other)
        if n == len(s) == len(other):
            node.append(i)
            continue
        parent, edge, node = None, None, root
        while isinstance(node, _Node) and node.depth < n:
            parent, edge = node, s[node.depth]
            node = node.sons[edge]
        key = s[n] if n < len(s) else -1
        if isinstance(node, _Node) and node.depth == n:
            node.sons[key] = [i]
            continue
        split = _Node(n, {(other[n] if n < len(other) else -1): node, key: [i]})
        if parent is None:
            root = split
        else:
            parent.sons[edge] = split
    stack: list[tuple[_Node | list, int]] = [(root, before)]
    while stack:
        node, prefix = stack.pop()
        if isinstance(node, _Node):
            for rank, key in reversed(list(enumerate(sorted(node.sons)))):
                stack.append((node.sons[key], node.depth if rank else prefix))
        else:
            size = len(strings[node[0]])
            out.extend((i, size if rank else prefix) for rank, i in enumerate(node))


def sort_group(strings: list[bytes], group: list[int], depth: int = 0, shallow: int | None = None) -> list[tuple[int, int]]:
    """The numbers of group in string order, each with its common prefix with the one before (-1 for the first).

    depth: a prefix length that all are known to share.
    """
    out: list[tuple[int, int]] = []
    limit = depth + SHALLOW if shallow is None else shallow
    stack = [(group, depth, -1)]
    while stack:
        part, d, before = stack.pop()
        if len(part) == 1:
            out.append((part[0], before))
        elif d >= limit:
            blind_trie(strings, part, out, before)
        else:
            heads = [strings[i][d] if d < len(strings[i]) else -1 for i in part]
            pivot = sorted(heads[:: max(1, len(heads) // 8)])[len(heads[:: max(1, len(heads) // 8)]) // 2]
            lower = [i for i, h in zip(part, heads) if h < pivot]
            same = [i for i, h in zip(part, heads) if h == pivot]
            upper = [i for i, h in zip(part, heads) if h > pivot]
            if upper:
                stack.append((upper, d, d))
            if pivot == -1:  # equal strings, and the least
                out.append((same[0], before))
                out.extend((i, d) for i in same[1:])
            else:
                stack.append((same, d + 1, d if lower else before))
                if lower:
                    stack.append((lower, d, before))
    return out
