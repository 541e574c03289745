"""STAR text: blocks of loops."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_LINE_ENDS = re.compile(r"\r\n|\n|\r")
_VALUES = re.compile(r"""(?:"((?:[^"]|"(?=\S))*)"|'((?:[^']|'(?=\S))*)')(?=\s|$)|(\S+)""")


def values(line: str) -> list[str]:
    """The values of a line; one with blanks stands in quotes that are not part of it. A quote ends at a quote before a blank."""
    if '"' not in line and "'" not in line:
        return line.split()
    return [m[1] if m[1] is not None else m[2] if m[2] is not None else m[3] for m in _VALUES.finditer(line)]


@dataclass
class Block:
    """A block of STAR text: rows with a value for each column, and how many rows were cut off."""

    name: str
    columns: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    n_cut: int = 0


def parsed(text: str) -> list[Block]:
    """The blocks of a text. Lines that begin with # are comments; key-value pairs make one row; a row may go on over lines
    until it has a value for each column; one that never does is cut off."""
    out: list[Block] = []
    pending: list[str] = []
    loop = False

    def ended() -> None:
        if pending:
            out[-1].n_cut += 1
            pending.clear()

    for raw in _LINE_ENDS.split(text or ""):
        line = raw.strip()
        if not line or line[0] == "#":
            continue
        low = line[:5].lower()
        if low == "data_":
            ended()
            out.append(Block(line[5:].split()[0] if line[5:].split() else ""))
            loop = False
            continue
        if not out:
            continue
        own = out[-1]
        if low == "loop_":
            ended()
            if own.columns:  # a second loop of the block is not a table of its own here
                out.append(Block(own.name))
            loop = True
        elif line[0] == "_" and not pending and (not own.rows or not loop) and (loop or len(values(line)) >= 2):
            label, *value = values(line)
            own.columns.append(label)
            if not loop:
                own.rows = [(own.rows[0] if own.rows else []) + [value[0] if value else ""]]
        elif loop and own.columns:
            found = values(line)
            if len(found) == len(own.columns):  # a whole row; what was pending before it was cut
                ended()
                own.rows.append(found)
                continue
            pending += found
            if len(pending) == len(own.columns):
                own.rows.append(pending.copy())
                pending.clear()
            elif len(pending) > len(own.columns):
                ended()  # no way to tell where the next row begins but the next line
    ended()
    return out


def blocks(text: str) -> list[tuple[str, list[str], list[list[str]]]]:
    """(name, columns, rows) of each block."""
    return [(b.name, b.columns, b.rows) for b in parsed(text)]


def particles(text: str) -> Block:
    """The particle block: the one named particles, else the first that isn't data_optics; an empty one without either."""
    found = parsed(text)
    named = [b for b in found if b.name.lower() == "particles"] or [b for b in found if b.name.lower() != "optics"]
    return named[0] if named else Block("")


def particle_block(text: str) -> tuple[list[str], list[list[str]]]:
    """Columns and rows of the particle block."""
    block = particles(text)
    return block.columns, block.rows
