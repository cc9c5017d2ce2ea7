"""Splitting and packing texts by size: small folds over one document, as Arrow functions."""

from __future__ import annotations

import pyarrow as pa

from scrivane.functions.arrow import arrow_function

# Budgets in characters.
CHUNK, TRANSCRIPT = 1800, 1500
WHITE = " \t\r\n\f\x0b"


def cut(text: str, budget: int = CHUNK) -> list[str]:
    """Pieces of at most the budget: cut at the last newline, else the last space, of the second half, else hard."""
    out, rest = [], text.strip(WHITE)
    while len(rest) > budget:
        at = rest.rfind("\n", 0, budget)
        if at < budget // 2:
            at = rest.rfind(" ", 0, budget)
        if at < budget // 2:
            at = budget
        out.append(rest[:at].strip(WHITE))
        rest = rest[at:].strip(WHITE)
    return out + [rest] if rest else out


def packed(pieces: list[str], budget: int, extra: int = 0) -> list[list[str]]:
    """Runs of whole pieces: a run ends before the piece that would exceed the budget; each piece counts `extra` more."""
    out, size = [], 0
    for p in pieces:
        if out and out[-1] and size + len(p) > budget:
            out.append([])
            size = 0
        if not out:
            out.append([])
        out[-1].append(p)
        size += len(p) + extra
        if not extra and size >= budget:
            out.append([])
            size = 0
    return [x for x in out if x]


def recursive(text: str, budget: int = CHUNK) -> list[str]:
    """Split at the coarsest of paragraph, line, sentence and word breaks that makes the pieces fit, then pack neighbours again."""
    text = text.strip(WHITE)
    if len(text) <= budget:
        return [text] if text else []
    for mark in ("\n\n", "\n", ". ", " "):
        parts = [p for p in text.split(mark) if p.strip(WHITE)]
        if len(parts) > 1:
            out, now = [], ""
            for p in parts:
                joined = f"{now}{mark}{p}" if now else p
                if now and len(joined) > budget:
                    out += recursive(now, budget)
                    now = p
                else:
                    now = joined
            return out + recursive(now, budget)
    return [text[i : i + budget] for i in range(0, len(text), budget)]


def viewer_lines(text: str, budget: int = CHUNK) -> list[str]:
    """Stripped lines without empty ones, long ones sliced."""
    lines = [x.strip(WHITE) for x in text.split("\n")]
    return [x[i : i + budget] for x in lines if x for i in range(0, len(x), budget)]


def _texts(values: pa.Array, function) -> pa.Array:
    return pa.array([None if v is None else function(v) for v in values.to_pylist()], pa.list_(pa.string()))


@arrow_function("array<string>")
def legacy_chunks(text: pa.Array) -> pa.Array:
    return _texts(text, lambda t: ["\n\n".join(run) for run in packed(cut(t), CHUNK)])


@arrow_function("array<string>")
def legacy_chunks_of(blocks: pa.Array) -> pa.Array:
    """Chunks of rendered blocks: each is cut, and the pieces are packed across blocks."""
    return _texts(blocks, lambda bs: ["\n\n".join(run) for run in packed([p for b in bs for p in cut(b or "")], CHUNK)])


@arrow_function("array<string>")
def split_parts(text: pa.Array) -> pa.Array:
    return _texts(text, recursive)


@arrow_function("array<string>")
def viewer_chunks(text: pa.Array) -> pa.Array:
    return _texts(text, lambda t: ["\n".join(run) for run in packed(viewer_lines(t), CHUNK, 1)] or [""])


@arrow_function("array<int>")
def cue_groups(lengths: pa.Array) -> pa.Array:
    """The group number of each cue, from their lengths in order."""
    def groups(ns):
        out, group, size = [], 0, 0
        for n in ns:
            if size and size + n > TRANSCRIPT:
                group, size = group + 1, 0
            out.append(group)
            size += n + 1
        return out

    return pa.array([None if v is None else groups(v) for v in lengths.to_pylist()], pa.list_(pa.int32()))
