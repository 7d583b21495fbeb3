"""Lines of a workflow file that name an action, and changes that do no more than move the commit such a line is pinned to."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A key of a block mapping with its value, perhaps behind the dash of a sequence (fixed values).
KEY = re.compile(rb"( *)(- )?([A-Za-z_][A-Za-z0-9_-]*):(?:[ \t]*(.*))?")
_BLANK = r"[\t-\r ]"
#: A line that names an action pinned to a commit: its lead, the action, the commit and a comment (fixed values).
PINNED = rf"(?s)^({_BLANK}*(?:-{_BLANK}+)?uses:{_BLANK}+)([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*)@([0-9a-f]{{40}})((?:[ \t]+#.*)?[ \t]*)\z"
_SCALAR, _OTHER = (b"|", b">"), (b"&", b"!", b"{", b"[")


def _is_plain(value: bytes) -> bool:
    """Whether a value ends on its line for sure: no anchor, tag or flow collection, and no quote left open."""
    if value.startswith(_OTHER):
        return False
    if value.startswith(b"'"):
        return value.endswith(b"'")
    if value.startswith(b'"'):
        escapes = len(value[:-1]) - len(value[:-1].rstrip(b"\\"))
        return value.endswith(b'"') and escapes % 2 == 0
    return True


def action_lines(source: bytes) -> list[int] | None:
    """Numbers, from 1, of lines whose ``uses`` is a key of a job or of a step of one; None where that can't be told for sure.

    The open levels are a stack of indents: job names, a job's keys, the dashes of its steps. Only block style is understood; anything that could mean
    something else to a full reader of the language (tabs, flow collections, anchors, tags, open quotes, lines that are no key, dashes out of
    place, indents that fit no level) makes the whole file ambiguous.
    """
    found: list[int] = []
    levels: list[int] = []
    in_jobs = in_steps = False
    scalar: int | None = None  # indent of the key whose block scalar is open
    for number, line in enumerate(source.splitlines(), 1):
        body = line.lstrip()
        if b"\t" in line[: len(line) - len(body)]:
            return None
        if not body or body.startswith(b"#"):
            continue
        indent = len(line) - len(line.lstrip(b" "))
        if scalar is not None and indent > scalar:
            continue
        scalar = None
        entry = KEY.fullmatch(line)
        if entry is None:
            if in_jobs and indent:
                return None
            continue
        dash, key, value = entry[2] is not None, entry[3], (entry[4] or b"").strip()
        if not _is_plain(value):
            return None
        if value.startswith(_SCALAR):
            scalar = indent
        if not indent:
            in_jobs, in_steps, levels = key == b"jobs" and not dash, False, []
            continue
        if not in_jobs:
            continue
        if not levels or (len(levels) == 1 and indent > levels[0]):
            if dash:
                return None
            levels.append(indent)
        if indent < levels[0] or (indent == levels[0] and dash):
            return None
        if indent == levels[0]:
            levels, in_steps = levels[:1], False
        elif indent == levels[1]:
            levels, in_steps = levels[:2], key == b"steps" and not dash
            if key == b"uses" and not dash:
                found.append(number)
        elif in_steps:
            if dash and len(levels) == 2:
                levels.append(indent)
            elif dash and indent != levels[2]:
                return None
            if key == b"uses" and (dash or (len(levels) == 3 and indent == levels[2] + 2)):
                found.append(number)
    return found


def action_line_numbers(content: Column) -> Column:
    """``action_lines`` of a file's bytes; null where they are ambiguous or absent."""
    lines = F.pandas_udf(lambda s: pd.Series([None if x is None else action_lines(bytes(x)) for x in s], index=s.index, dtype=object), "array<int>")
    return lines(content.cast("binary"))


def byte_lines(content: Column) -> Column:
    """A file's lines, a character a byte, without their ends; an empty last one is no line."""
    parts = F.split(F.decode(content, "ISO-8859-1"), "\r\n|\n|\r", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def moves_pins_only(before: Column, after: Column, before_actions: Column, after_actions: Column) -> Column:
    """Whether two versions differ in pinned commits (and the comments behind them) alone, in one line at least.

    Both are arrays of lines, beside the numbers of their action lines. They are put side by side over the whole length of the longer: every pair is equal, or an
    action line on both sides with the same lead and action. False where either side's action lines are unknown.
    """
    pairs = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    numbered = F.transform(pairs, lambda p, i: F.struct((i + 1).alias("n"), p["b"].alias("b"), p["a"].alias("a")))
    differing = F.filter(numbered, lambda p: ~p["b"].eqNullSafe(p["a"]))
    part = lambda line, k: F.regexp_extract(line, PINNED, k)
    moved = lambda p: (
        p["b"].isNotNull() & p["a"].isNotNull() & F.array_contains(before_actions, p["n"]) & F.array_contains(after_actions, p["n"])
        & p["b"].rlike(PINNED) & p["a"].rlike(PINNED) & (part(p["b"], 1) == part(p["a"], 1)) & (part(p["b"], 2) == part(p["a"], 2))
    )
    known = before.isNotNull() & after.isNotNull() & before_actions.isNotNull() & after_actions.isNotNull()
    return F.coalesce(known & (F.size(differing) > 0) & F.forall(differing, moved), F.lit(False))
