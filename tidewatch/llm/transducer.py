"""Minimal acyclic transducer over byte strings: states with equal futures are shared, numbers on the arcs add up to the
rank of the word among all words.

Built by adding the words in order (Daciuk et al. 2000), stored as a double array: the arc of a state with a byte lies in
slot state + byte, which is right if the slot names the state. Many strings are followed at once, a byte of each per step.
"""

from __future__ import annotations

import numpy as np

ABSENT = -1


def minimal_states(words: list[bytes]) -> tuple[list[tuple[bool, tuple[tuple[int, int], ...]]], int]:
    """States (final, arcs by byte) of the sorted, different words, targets before sources, and the number of the first."""
    states, known = [], {}

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        state = (final, tuple(arcs))
        at = known.setdefault(state, len(states))
        if at == len(states):
            states.append(state)
        return at

    open_states: list[list] = [[False, []]]
    last = b""

    def close(depth: int) -> None:
        while len(open_states) > depth + 1:
            final, arcs = open_states.pop()
            open_states[-1][1].append((last[len(open_states) - 1], freeze(final, arcs)))

    for word in words:
        shared, least = 0, min(len(word), len(last))
        while shared < least and word[shared] == last[shared]:
            shared += 1
        close(shared)
        open_states.extend([False, []] for _ in range(len(word) - shared))
        open_states[-1][0] = True
        last = word
    close(0)
    return states, freeze(*open_states[0])


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the automaton that maps each of the sorted, different words to its place in the list.

    `owner`, `target` and `skip` by slot; a state is the place of its slots times two, plus one if a word may end there.
    """
    states, root = minimal_states(words)
    below = [0] * len(states)
    for at, (final, arcs) in enumerate(states):
        below[at] = final + sum(below[t] for _, t in arcs)
    place, taken, used = [0] * len(states), set(), bytearray(1024)
    single, several = 256, 256
    for at in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
        arcs = states[at][1]
        if not arcs:
            continue
        first = arcs[0][0]
        slot, tries = (several if len(arcs) > 1 else single), 0
        while True:
            slot = used.find(0, slot)
            if slot < 0 or slot + 512 > len(used):
                slot = len(used) - 512 if slot < 0 else slot
                used += bytes(len(used))
                continue
            base = slot - first
            if base > 0 and base not in taken and not any(used[base + b] for b, _ in arcs):
                break
            slot += 1
            tries += 1
        if len(arcs) > 1:
            several = slot - 64 if tries > 512 else several
        else:
            single = slot
        place[at] = base
        taken.add(base)
        for b, _ in arcs:
            used[base + b] = 1
    size = max(place, default=0) + 512
    owner, target, skip = (np.full(size, v, np.int32) for v in (ABSENT, 0, 0))
    for at, (final, arcs) in enumerate(states):
        before = int(final)
        for b, t in arcs:
            slot = place[at] + b
            owner[slot], target[slot], skip[slot] = place[at], place[t] * 2 + states[t][0], before
            before += below[t]
    longest = max(map(len, words), default=0)
    return {"owner": owner, "target": target, "skip": skip, "start": np.array([place[root] * 2 + states[root][0], longest, len(words)], np.int32)}


def rank(automaton: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each range of bytes its place in the list of words, or -1."""
    owner, target, skip = automaton["owner"], automaton["target"], automaton["skip"]
    start, longest, _ = (int(v) for v in automaton["start"])
    length = np.minimum(ends - starts, longest + 1).astype(np.int16)
    order = np.argsort(-length, kind="stable")
    sorted_length = length[order]
    begins = starts[order]
    state = np.full(len(starts), start, np.int32)
    total = np.zeros(len(starts), np.int32)
    alive = np.searchsorted(-sorted_length, -np.arange(longest + 2), side="left")   # ranges with more bytes than this
    state[:alive[longest]] = 0
    for step in range(longest):
        n, skipped = int(alive[step]), int(alive[longest])
        if n == skipped:
            break
        here = slice(skipped, n)
        base = state[here] >> 1
        slot = base + data[begins[here] + step]
        right = owner[slot] == base
        state[here] = np.where(right, target[slot], 0)
        total[here] += np.where(right, skip[slot], 0)
    out = np.empty(len(starts), np.int32)
    out[order] = np.where(state & 1 == 1, total, ABSENT)
    return out
