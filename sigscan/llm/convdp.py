"""Cheapest repairs of many conversations at once: a time-major dynamic programme on NumPy tensors.

A conversation is a string of codes, one byte a row: 3 * role + fault, with roles
user, assistant, system, other and faults none, must go, truncated. States are
those of ``(s?(ua)+)?``: at the start, after the system row, after a user, after
an assistant. Blocks of conversations (whole ones, if short) are bucketed by
length into tensors [turn, block, state]; each turn updates the costs of all
blocks from the last turn backwards, all costs are stored, and the edits are
traced forwards, again for all blocks a turn. A conversation of many blocks takes
one more pass before: costs from each state at a block's start to each state at
its end, which are chained from its last block to its first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

USER, ASSISTANT, SYSTEM, OTHER = range(4)
NONE, GONE, TRUNCATED = range(3)
#: The code of no row, at the end of a block that is shorter than its tensor.
PAD = 12
#: Costs of the edits.
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
DEAD = np.int64(1) << 40
#: Cells (turns x blocks) of a tensor; each holds four costs.
CELLS = 1 << 18

#: The state after a user or assistant that may stand at a state, which is what is inserted or renamed to there.
_NEXT = np.array([2, 2, 3, 2])
#: The state after keeping a row of a role at a state; 4 is none.
_KEEP = np.full((4, 4), 4)
_KEEP[USER, [0, 1, 3]] = 2
_KEEP[ASSISTANT, 2] = 3
_KEEP[SYSTEM, 0] = 1
_code = np.arange(PAD + 1)
_fault, _role = _code % 3, np.minimum(_code // 3, OTHER)
_keep_to = _KEEP[_role]
_late = np.where(_fault == TRUNCATED, UNFINISHED, 0)
_keep_cost = np.where(_fault == GONE, DEAD, _late)
_rerole_cost = _keep_cost + REROLE
#: Costs from each state to the end of a conversation, by insertions alone.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
EDITS = np.frombuffer(b"DKR", np.uint8)


def _backward(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs [turn + 1, block, state] of codes [turn, block], given those after the last turn."""
    turns, blocks = codes.shape
    v = np.empty((turns + 1, blocks, 4), np.int64)
    v[turns] = after
    ahead = np.full((blocks, 5), DEAD, np.int64)
    for t in range(turns - 1, -1, -1):
        c, nxt = codes[t], v[t + 1]
        ahead[:, :4] = nxt
        best = np.minimum(nxt + DELETE, np.take_along_axis(ahead, _keep_to[c], 1) + _keep_cost[c][:, None])
        np.minimum(best, nxt[:, _NEXT] + _rerole_cost[c][:, None], out=best)
        two, three = best[:, 2].copy(), best[:, 3].copy()
        np.minimum(two, three + INSERT, out=best[:, 2])
        np.minimum(three, two + INSERT, out=best[:, 3])
        np.minimum(best[:, :2], best[:, 2:3] + INSERT, out=best[:, :2])
        np.minimum(best, DEAD, out=best)
        v[t] = np.where((c == PAD)[:, None], nxt, best)
    return v


def _forward(codes: np.ndarray, v: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest edits from the given states, of equal ones those least in ASCII: (plan [turn, block], states at the end).

    A byte of the plan is edit + 4 * insertions before it + 16 * the state before those.
    """
    turns, blocks = codes.shape
    plan, state, at = np.zeros((turns, blocks), np.uint8), state.copy(), np.arange(blocks)
    for t in range(turns):
        c, now, nxt = codes[t], v[t], v[t + 1]
        real = c != PAD
        begin, inserted, cost = state.copy(), np.zeros(blocks, np.uint8), now[at, state]
        gone = real & (nxt[at, state] + DELETE == cost)
        while True:
            to = _NEXT[state]
            more = real & ~gone & (now[at, to] + INSERT == cost)
            if not more.any():
                break
            state = np.where(more, to, state)
            inserted += more
            cost = now[at, state]
            gone |= more & (nxt[at, state] + DELETE == cost)
        keep_to = _keep_to[c, state]
        kept = real & ~gone & (keep_to < 4) & (nxt[at, np.minimum(keep_to, 3)] + _keep_cost[c] == cost)
        renamed = real & ~gone & ~kept
        state = np.where(kept, keep_to, np.where(renamed, _NEXT[state], state))
        plan[t] = np.where(kept, 1, np.where(renamed, 2, 0)) + 4 * inserted + 16 * begin
    return plan, state


def _buckets(lengths: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Indices of blocks of like length, as many as a tensor takes."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        # a tensor's padding stays below its rows: lengths within a factor of two
        stop = int(np.searchsorted(lengths[order], 2 * max(1, lengths[order[start]]), "right"))
        while stop - start > 1 and (stop - start) * lengths[order[stop - 1]] > cells:
            stop = start + max(1, (stop - start) // 2)
        yield order[start:stop]
        start = stop


def _tensor(blocks: list[np.ndarray]) -> np.ndarray:
    out = np.full((max(map(len, blocks), default=0), len(blocks)), PAD, np.uint8)
    for k, b in enumerate(blocks):
        out[: len(b), k] = b
    return out


def repair(conversations: list[list[np.ndarray]], cells: int = CELLS) -> list[tuple[int, list[np.ndarray], int]]:
    """For each conversation, given as its blocks of codes: (cost, plan of each block, state at the end)."""
    blocks = [b for c in conversations for b in c]
    lengths = np.array([len(b) for b in blocks], np.int64)
    first = np.cumsum([0, *map(len, conversations)])
    after, entry = np.tile(END, (len(blocks), 1)), np.zeros(len(blocks), np.int64)
    many = [k for k, c in enumerate(conversations) if len(c) > 1]
    parts = np.concatenate([np.arange(first[k], first[k + 1]) for k in many]) if many else np.zeros(0, np.int64)
    goal = np.where(np.eye(4, dtype=bool), 0, DEAD).astype(np.int64)
    through = np.empty((len(blocks) if many else 0, 4, 4), np.int64)
    for chosen in _buckets(lengths[parts], max(1, cells // 4)):
        chosen = parts[chosen]
        codes = _tensor([blocks[k] for k in chosen])
        v = _backward(np.repeat(codes, 4, 1), np.tile(goal, (len(chosen), 1)))
        through[chosen] = v[0].reshape(len(chosen), 4, 4).transpose(0, 2, 1)
    for k in many:
        for b in range(first[k + 1] - 2, first[k] - 1, -1):
            after[b] = (through[b + 1] + after[b + 1]).min(1)
    # where a block of many is left from each state it may be entered at, then from the one it is
    leave = np.empty((len(blocks) if many else 0, 4), np.int64)
    for chosen in _buckets(lengths[parts], max(1, cells // 4)):
        chosen = parts[chosen]
        codes = np.repeat(_tensor([blocks[k] for k in chosen]), 4, 1)
        v = _backward(codes, np.repeat(after[chosen], 4, 0))
        leave[chosen] = _forward(codes, v, np.tile(np.arange(4), len(chosen)))[1].reshape(-1, 4)
    for k in many:
        for b in range(first[k] + 1, first[k + 1]):
            entry[b] = leave[b - 1, entry[b - 1]]
    plans, ends, costs = [None] * len(blocks), np.zeros(len(blocks), np.int64), np.zeros(len(blocks), np.int64)
    for chosen in _buckets(lengths, cells):
        codes = _tensor([blocks[k] for k in chosen])
        v = _backward(codes, after[chosen])
        plan, end = _forward(codes, v, entry[chosen])
        for j, k in enumerate(chosen):
            plans[k] = plan[: lengths[k], j].copy()
        ends[chosen], costs[chosen] = end, v[0, np.arange(len(chosen)), entry[chosen]]
    out = []
    for k, c in enumerate(conversations):
        if not c:
            out.append((0, [], 0))
            continue
        out.append((int(costs[first[k]]), plans[first[k] : first[k + 1]], int(ends[first[k + 1] - 1])))
    return out


def audit(plan: list[np.ndarray], end: int) -> bytes:
    """The initials of a plan's edits in order."""
    return b"".join(map(_initials, plan)) + b"I" * int(END[end] // INSERT)


def _initials(plan: np.ndarray) -> bytes:
    ends = (((plan >> 2) & 3).astype(np.int64) + 1).cumsum()
    out = np.full(ends[-1] if len(ends) else 0, ord("I"), np.uint8)
    out[ends - 1] = EDITS[plan & 3]
    return out.tobytes()


def illegal(codes: list[np.ndarray]) -> int:
    """Adjacent rows whose roles are neither system-user nor user-assistant nor assistant-user."""
    role = np.concatenate([np.minimum(c // 3, OTHER) for c in codes]) if codes else np.zeros(0, np.uint8)
    a, b = role[:-1], role[1:]
    return int((~(((a == SYSTEM) & (b == USER)) | ((a == USER) & (b == ASSISTANT)) | ((a == ASSISTANT) & (b == USER)))).sum())


def steps(plan: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place at the row, edit initial, role) of a plan: insertions at places 0 and 1, the row itself at 2; role is u or a where the edit sets it, else blank."""
    n, state = (plan >> 2) & 3, (plan >> 4).astype(np.int64)
    rows = np.arange(len(plan))
    out = []
    for k in (0, 1):
        has = n > k
        out.append((rows[has], np.full(has.sum(), k), np.full(has.sum(), ord("I"), np.uint8), np.where(state[has] == 2, ord("a"), ord("u")).astype(np.uint8)))
        state = np.where(has, _NEXT[state], state)
    edit = EDITS[plan & 3]
    role = np.where(edit == ord("R"), np.where(state == 2, ord("a"), ord("u")), ord(" ")).astype(np.uint8)
    out.append((rows, np.full(len(plan), 2), edit, role))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
