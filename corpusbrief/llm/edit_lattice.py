"""The cheapest repair of a conversation, by bidirectional Dijkstra over its edit lattice.

A block of rows is a string: the role's initial (``s``, ``u``, ``a``, else ``o``), in upper case if the row's text is
truncated, or ``x`` for a row that has to go.  A node is (rows used, state); the states are those of
``(s?(ua)+)?``: 0 nothing yet, 1 after s, 2 after u, 3 after a.  Edges: K(eep) 0, R(erole) 2, D(elete) 3, I(nsert) 2;
a truncated row that stays costs 1 more.  At each state just one of user and assistant may follow, so edits need no role.
"""
from __future__ import annotations

from functools import lru_cache
from heapq import heappop, heappush

STATES = range(4)
ACCEPT = (0, 3)
AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
TURN = {0: 2, 1: 2, 2: 3, 3: 2}  # the state after a rerole or an insertion
ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
FAR = float("inf")
Path = tuple[int, str]


def _row_edges(symbol: str) -> list[list[tuple[int, str, int]]]:
    """For each state, (cost, label, next state) of the edits that use a row."""
    out = [[(3, "D", q)] for q in STATES]
    if symbol != "x":
        late, role = int(symbol.isupper()), symbol.lower()
        for q in STATES:
            out[q].append((2 + late, "R", TURN[q]))
            if role in AFTER[q]:
                out[q].append((late, "K", AFTER[q][role]))
    return out


FORWARD = {c: _row_edges(c) for c in "suaoSUAOx"}
BACKWARD = {c: [[(w, label, p) for p in STATES for w, label, r in rows[p] if r == q] for q in STATES] for c, rows in FORWARD.items()}
INTO = [[p for p in STATES if TURN[p] == q] for q in STATES]


@lru_cache(maxsize=1 << 14)
def cheapest(rows: str, start: int, ends: tuple[int, ...]) -> Path | None:
    """(cost, the least audit of that cost) from ``start`` through all rows to one of ``ends``; None if there is no way."""
    n = len(rows)
    if n == 0 and start in ends:
        return 0, ""
    goals = {n * 4 + q for q in ends}

    def onward(node: int):
        i, q = divmod(node, 4)
        yield 2, "I", i * 4 + TURN[q]
        if i < n:
            for w, label, r in FORWARD[rows[i]][q]:
                yield w, label, i * 4 + 4 + r

    def back(node: int):
        i, q = divmod(node, 4)
        for p in INTO[q]:
            yield 2, "I", i * 4 + p
        if i:
            for w, label, p in BACKWARD[rows[i - 1]][q]:
                yield w, label, i * 4 - 4 + p

    far = ({start: 0}, dict.fromkeys(goals, 0))  # least distances so far, from the start and to the goals
    done: tuple[dict, dict] = ({}, {})
    heaps = ([(0, start)], [(0, g) for g in sorted(goals)])
    step = (onward, back)
    best = FAR

    def settle(side: int) -> None:
        nonlocal best
        d, u = heappop(heaps[side])
        if u in done[side]:
            return
        done[side][u] = d
        for w, _, v in step[side](u):
            if d + w < far[side].get(v, FAR):
                far[side][v] = d + w
                heappush(heaps[side], (d + w, v))
            if v in far[1 - side]:
                best = min(best, d + w + far[1 - side][v])

    for side in (0, 1):
        for _ in range(len(heaps[side])):
            settle(side)
    # beyond the first meeting: until no further crossing can be as cheap
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        settle(int(heaps[1][0][0] < heaps[0][0][0]))
    if best == FAR:
        return None

    ahead, behind = done
    crossing = {u for u, d in ahead.items() if any(v in behind and d + w + behind[v] == best for w, _, v in onward(u))}
    marked, todo = set(crossing), list(crossing)  # nodes before a crossing, on a cheapest way
    while todo:
        u = todo.pop()
        for w, _, p in back(u):
            if p not in marked and p in ahead and ahead[p] + w == ahead[u]:
                marked.add(p)
                todo.append(p)

    audit, first, second = [], {start} & marked, set()  # all nodes that the least audit so far may have come to
    while not second & goals:
        options: dict[str, tuple[set, set]] = {}
        for u in first:
            for w, label, v in onward(u):
                if v in marked and ahead[u] + w == ahead[v]:
                    options.setdefault(label, (set(), set()))[0].add(v)
                if u in crossing and v in behind and ahead[u] + w + behind[v] == best:
                    options.setdefault(label, (set(), set()))[1].add(v)
        for u in second:
            for w, label, v in onward(u):
                if v in behind and w + behind[v] == behind[u]:
                    options.setdefault(label, (set(), set()))[1].add(v)
        label = min(options)
        first, second = options[label]
        audit.append(label)
    return best, "".join(audit)


def block_paths(rows: str, begins: bool, ends: bool) -> dict[tuple[int, int], Path]:
    """{(first state, last state): cheapest way} of a block; from 0 alone if the conversation begins with it, to -1
    (any accepting state) if it ends with it."""
    out = {}
    for p in (0,) if begins else STATES:
        for q, goals in [(-1, ACCEPT)] if ends else [(q, (q,)) for q in STATES]:
            if (way := cheapest(rows, p, goals)) is not None:
                out[p, q] = way
    return out


def joined(x: dict[tuple[int, int], Path], y: dict[tuple[int, int], Path]) -> dict[tuple[int, int], Path]:
    """The cheapest ways through one block and the next; of equal costs the least audit.

    Of two ways of equal cost between the same nodes, neither audit begins with the other: they use the same rows,
    so the longer one would have insertions more.  The least whole audit is therefore made of least parts.
    """
    cost: dict[tuple[int, int], int] = {}
    for (p, q), (c, _) in x.items():
        for (r, s), (d, _) in y.items():
            if q == r:
                cost[p, s] = min(cost.get((p, s), c + d), c + d)
    out: dict[tuple[int, int], Path] = {}
    for (p, q), (c, a) in x.items():
        for (r, s), (d, b) in y.items():
            if q == r and c + d == cost[p, s]:
                way = (c + d, a + b)
                out[p, s] = min(out.get((p, s), way), way)
    return out


def whole(blocks: list[tuple[int, dict]]) -> dict[tuple[int, int], Path]:
    """The product of a stack of (blocks in it, ways)."""
    out = blocks[-1][1]
    for _, ways in reversed(blocks[:-1]):
        out = joined(ways, out)
    return out


def push(stack: list[tuple[int, dict]], ways: dict) -> None:
    """Add the next block: neighbours of equal size are joined, so that audits are copied log times."""
    stack.append((1, ways))
    while len(stack) > 1 and stack[-2][0] == stack[-1][0]:
        (n, x), (m, y) = stack[-2:]
        stack[-2:] = [(n + m, joined(x, y))]
