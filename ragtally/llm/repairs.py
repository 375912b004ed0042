"""Kernels of conversation repair (operator 13): the least edits that give a conversation its structure.

A conversation is a list of items (m, kind): m equal rows, kind = role class + 4 * fault.  States of the wanted form
`(s?(ua)+)?`: START (nothing yet), SYSTEM (after s), USER (after u) and ASSISTANT (after a); it may end in START or
ASSISTANT.  Every letter of an audit leads from a state to one state, so the ASCII-least of the cheapest audits is
found by taking the least letter that is tight at each step.

The costs to the end, one vector of four, go backward over the items.  They are kept at checkpoints only (the borders
of blocks of about the square root of the conversation's length): a block's effect on any vector is its (min, +)
matrix, so blocks are measured apart, the checkpoints' vectors follow from the matrices, and a block's own vectors are
computed again when the walk forward comes to it.
"""

from __future__ import annotations

START, SYSTEM, USER, ASSISTANT = range(4)
#: Role classes are SYSTEM, USER, ASSISTANT by the role's initial, and 0 for any other.
OTHER = 0
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
RELABEL, REMOVE, ADD, CUT = 3, 4, 3, 3  # costs; CUT is added for a truncated row that stays
#: No way; sums of it stay below 2^63.
FAR = 1 << 60
#: Costs after the last row: what must still be added.
FINISH = (0, 2 * ADD, ADD, 0)
#: State after an added row, and after a row given the role that its state wants.
NEXT = (USER, USER, ASSISTANT, USER)
#: Adjacent role classes that are in order.
IN_ORDER = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

Costs = tuple[int, int, int, int]
Item = tuple[int, int]


def kept_state(state: int, role: int) -> int:
    """State after a row of a role class stays; -1 if it can't."""
    if role == SYSTEM:
        return SYSTEM if state == START else -1
    return role if role and NEXT[state] == role else -1


def before(after: Costs, item: Item) -> Costs:
    """Costs before an item from those after it."""
    m, kind = item
    role, fault = kind & 3, kind >> 2
    if fault in (BLANK, DUPLICATE):
        return tuple(x + REMOVE * m for x in after)
    a0, a1, a2, a3 = (x + REMOVE * (m - 1) for x in after) if m > 1 else after
    cut = CUT if fault == TRUNCATED else 0
    new = RELABEL + cut + a2
    c0, c1, c2, c3 = min(REMOVE + a0, new), min(REMOVE + a1, new), min(REMOVE + a2, RELABEL + cut + a3), min(REMOVE + a3, new)
    if role == USER:
        stay = cut + a2
        c0, c1, c3 = min(c0, stay), min(c1, stay), min(c3, stay)
    elif role == ASSISTANT:
        c2 = min(c2, cut + a3)
    elif role == SYSTEM:
        c0 = min(c0, cut + a1)
    user, assistant = min(c2, ADD + c3), min(c3, ADD + c2)
    return min(c0, ADD + user), min(c1, ADD + user), user, assistant


def matrix(items: list[Item]) -> list[int]:
    """Least costs from each state before a block to each state after it, by rows."""
    columns = []
    for state in range(4):
        v = tuple(0 if s == state else FAR for s in range(4))
        for item in reversed(items):
            v = before(v, item)
        columns.append([min(x, FAR) for x in v])
    return [columns[t][s] for s in range(4) for t in range(4)]


def through(block: list[int], after: Costs) -> Costs:
    """Costs before a block from those after it."""
    return tuple(min(block[4 * s + t] + after[t] for t in range(4)) for s in range(4))


def walk(items: list[Item], after: Costs, start: int, last: bool) -> tuple[int, list[tuple[str, int, int]]]:
    """The ASCII-least cheapest edits of a block from a state on, given the costs after it: the state after it, and
    (letter, item number or -1, state after the edit, which tells a given role)."""
    costs = [after]
    for item in reversed(items):
        costs.append(before(costs[-1], item))
    costs.reverse()
    state, out = start, []
    for at, (m, kind) in enumerate(items):
        role, fault = kind & 3, kind >> 2
        if fault in (BLANK, DUPLICATE):
            out.append(("D" * m, at, state))
            continue
        rest, cut = REMOVE * (m - 1), CUT if fault == TRUNCATED else 0
        here, then = costs[at], costs[at + 1]
        while True:
            if here[state] == REMOVE + rest + then[state]:
                out.append(("D", at, state))
                break
            if here[state] == ADD + here[NEXT[state]]:
                state = NEXT[state]
                out.append(("I", -1, state))
                continue
            stay = kept_state(state, role)
            if stay >= 0 and here[state] == cut + rest + then[stay]:
                state = stay
                out.append(("K", at, state))
            else:
                state = NEXT[state]
                out.append(("R", at, state))
            break
        if m > 1:
            out.append(("D" * (m - 1), at, state))
    if last:
        while FINISH[state]:
            state = NEXT[state]
            out.append(("I", -1, state))
    return state, out


def out_of_order(items: list[Item]) -> int:
    """Adjacent rows within a block whose role initials are not su, ua or au."""
    bad = sum(m - 1 for m, _ in items)
    return bad + sum((a[1] & 3, b[1] & 3) not in IN_ORDER for a, b in zip(items, items[1:]))
