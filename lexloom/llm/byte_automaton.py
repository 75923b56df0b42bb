"""A byte automaton as tables, run over many texts at once in numpy.

One state holds what is needed of the bytes before: how many continuation bytes a code point still
has, whether the next byte begins a unit, and how much of a sentinel has been read (a node of the
sentinels' prefix tree). The tables give each state and byte the next state and the marks of that
transition. A state depends on few bytes (`reach`), so a long run of bytes is cut into rows that
start `reach` bytes early, and one step of numpy moves all rows by a byte."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Stands between texts; no UTF-8 text holds it. It leads to the state in which a text begins.
BREAK = 0xFF
#: Marks of a transition: a code point begins, a unit begins, a sentinel ends.
CHAR, UNIT, SENTINEL = 1, 2, 4
#: Bytes that a row of a scan moves over.
ROW = 512


@dataclass(frozen=True)
class Automaton:
    """step, marks: flat tables, 256 entries a state; state 0 begins a text; reach: bytes that decide a state."""

    step: np.ndarray
    marks: np.ndarray
    reach: int


def sentinel_moves(sentinels: tuple[bytes, ...]) -> tuple[list[list[int]], list[bool]]:
    """For each node of the sentinels' prefix tree the node after each byte, and whether a sentinel ends there."""
    nodes = [b""]
    for s in sentinels:
        nodes += [s[:i] for i in range(1, len(s) + 1) if s[:i] not in nodes]
    number = {p: i for i, p in enumerate(nodes)}

    def after(read: bytes) -> int:
        while read not in number:
            read = read[1:]
        return number[read]

    return [[after(p + bytes([b])) for b in range(256)] for p in nodes], [any(p.endswith(s) for s in sentinels) for p in nodes]


@lru_cache(maxsize=8)
def automaton(sentinels: tuple[str, ...], unit_end: str = "\n") -> Automaton:
    """The tables for texts whose units end with the ASCII character `unit_end`."""
    raw = tuple(s.encode() for s in sentinels)
    if len(unit_end) != 1 or ord(unit_end) > 127:
        raise ValueError("a unit ends with one ASCII character")
    if any(not s for s in raw) or any(i != j and a in b for i, a in enumerate(raw) for j, b in enumerate(raw)):
        raise ValueError("a sentinel may neither be empty nor stand in another one")
    moves, ends = sentinel_moves(raw)
    known, todo = {(0, True, 0): 0}, [(0, True, 0)]  # continuation bytes to come, unit to begin, node
    step, marks = [], []
    for left, fresh, node in todo:
        for b in range(256):
            if b == BREAK:
                to, mark = (0, True, 0), 0
            else:
                more = 0x80 <= b < 0xC0
                size = max(left - 1, 0) if more else 0 if b < 0xC0 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                to = (size, b == ord(unit_end), moves[node][b])
                mark = CHAR * (not more) + UNIT * fresh + SENTINEL * ends[moves[node][b]]
            if to not in known:
                known[to] = len(known)
                todo.append(to)
            step.append(known[to])
            marks.append(mark)
    return Automaton(np.array(step, np.intp) * 256, np.array(marks, np.uint8), max([4, *map(len, raw)]))


def scan(data: np.ndarray, table: Automaton) -> np.ndarray:
    """The marks of every byte's transition. data begins with a BREAK."""
    rows = max(1, -(-len(data) // ROW))
    padded = np.full(table.reach + rows * ROW, BREAK, np.uint8)
    padded[table.reach : table.reach + len(data)] = data
    state = np.zeros(rows, np.intp)
    for i in range(table.reach):  # the bytes before each row: breaks for the first
        state = table.step[state + padded[i : i + rows * ROW : ROW]]
    out = np.empty((ROW, rows), np.uint8)
    columns = np.ascontiguousarray(padded[table.reach :].reshape(rows, ROW).T)
    for i in range(ROW):
        at = state + columns[i]
        out[i] = table.marks[at]
        state = table.step[at]
    return np.ascontiguousarray(out.T).reshape(-1)[: len(data)]
