"""Lines, fences, headings, links and diagrams of Markdown texts as columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatehouse.functions.patterns import ASYMMETRIC_LABEL, CODE_SPAN, DIRECTIVES, FENCE, JAPANESE, LINK, LINK_DESTINATION, MESSAGE_LABEL, NODE_LABEL, PIPE_EDGE_LABEL, SPACE, TABLE_DIVIDER, TEXT_EDGE_LABEL

#: What a table's cell is made of: escaped characters, code spans (an open one runs to the line's end) and others but pipes. Possessive, so no line is too long.
_CELL = r"(?s)\|((?:\\.|\\\z|`(?:\\.|[^`\\])*+(?:`|\\?\z)|[^|`\\])*+)"
#: A block of words (see fence_blocks), or one word that opens none.
_BLOCK = r"(`{3,}+|~{3,}+)o;(?:(?!\1)[`~]++[ox];)*+(?:[`~]++[ox];)?+|[`~]++[ox];"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(text: Column) -> Column:
    """Array of lines; an empty last one is no line."""
    return bound(F.split(text, _BREAK, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def fence_blocks(lines: Column) -> Column:
    """Array of ``(first, last, info, closed)``, a row per fenced block in order; any line that begins with the opening mark closes it, whatever follows.

    Lines that begin with a mark are written as one word each (the mark, and whether it may open a block). One expression cuts the row of words into blocks
    and words outside of any; it goes on where it stopped, and no array grows step by step, so time grows with the lines.
    """
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    marked = F.transform(
        F.filter(numbered, lambda x: x["line"].rlike(f"^[{SPACE}]*(?:```|~~~)")),
        lambda x: F.struct(x["n"].alias("n"), F.regexp_extract(x["line"], f"^[{SPACE}]*(`+|~+)", 1).alias("mark"), x["line"].rlike(FENCE).alias("opens"), stripped(F.regexp_extract(x["line"], FENCE, 2)).alias("info")),
    )

    def ends(block: Column) -> Column:
        """A block's words as 1 for the first, 2 for the one that closes it, and 0."""
        n = F.regexp_count(block, F.lit(";"))
        closed = (n > 1) & F.startswith(F.substring_index(block, ";", -2), F.regexp_extract(block, "^[`~]+", 0))
        return F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), n - 1 - F.when(closed, 1).otherwise(0)), F.when(closed, F.array(F.lit(2))).otherwise(F.expr("cast(array() as array<int>)")))

    def blocks(marks: Column) -> Column:
        words = F.array_join(F.transform(marks, lambda m: F.concat(m["mark"], F.when(m["opens"], "o;").otherwise("x;"))), "")
        cut = F.regexp_extract_all(words, F.lit(_BLOCK), F.lit(0))
        states = F.flatten(F.transform(cut, lambda e: F.when(e.rlike("^[`~]+o"), ends(e)).otherwise(F.array(F.lit(0)))))
        told = F.filter(F.zip_with(marks, states, lambda m, s: F.struct(m["n"].alias("n"), m["info"].alias("info"), s.alias("s"))), lambda x: x["s"] > 0)
        return bound(told, lambda a: F.zip_with(F.filter(a, lambda x: x["s"] == 1), F.filter(a, lambda x: x["s"] == 2), lambda b, e: F.struct(b["n"].alias("first"), F.coalesce(e["n"], F.size(lines)).alias("last"), b["info"].alias("info"), e.isNotNull().alias("closed"))))

    return bound(marked, blocks)


def outside_fences(lines: Column) -> Column:
    """Array of ``(n, line)`` outside fenced blocks. A flag a line is laid out block by block, so a text takes as long as it has lines."""

    def kept(a: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(a["blocks"], lambda b: b["last"]))
        runs = F.zip_with(before, a["blocks"], lambda p, b: F.when(b.isNotNull(), F.concat(F.array_repeat(F.lit(True), b["first"] - p - 1), F.array_repeat(F.lit(False), b["last"] - b["first"] + 1))).otherwise(F.array_repeat(F.lit(True), F.size(a["lines"]) - p)))
        at = F.transform(a["lines"], lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
        flagged = F.zip_with(at, F.flatten(runs), lambda x, out: F.struct(x.alias("x"), out.alias("out")))
        return F.transform(F.filter(flagged, lambda f: f["out"]), lambda f: f["x"])

    return bound(lines, lambda x: bound(F.struct(x.alias("lines"), fence_blocks(x).alias("blocks")), kept))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def mermaid_diagrams(lines: Column) -> Column:
    """Array of the line arrays of every Mermaid block, quoted ones too; a block that nothing closes ends with the text."""

    def inside(a: Column) -> Column:
        found = F.filter(a["blocks"], lambda b: F.lower(b["info"]) == "mermaid")
        return F.transform(found, lambda b: F.slice(a["lines"], b["first"] + 1, b["last"] - b["first"] - F.when(b["closed"], 1).otherwise(0)))

    bare = F.transform(lines, lambda x: F.regexp_replace(x, rf"^[{SPACE}]*(?:>[{SPACE}]?)+", ""))
    return bound(bare, lambda x: bound(F.struct(x.alias("lines"), fence_blocks(x).alias("blocks")), inside))


def row_cells(line: Column) -> Column:
    """Cells of a table's row, split at pipes that are neither escaped nor in a code span; empty first and last cells are none."""
    cells = F.transform(F.regexp_extract_all(F.concat(F.lit("|"), stripped(line)), F.lit(_CELL), F.lit(1)), stripped)
    head = lambda c: F.when(F.try_element_at(c, F.lit(1)) == "", F.slice(c, F.lit(2), F.size(c))).otherwise(c)
    tail = lambda c: F.when(F.try_element_at(c, F.lit(-1)) == "", F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c)
    return bound(bound(cells, head), tail)


def code_width(cell: Column) -> Column:
    """Characters of a cell's code spans."""
    return F.aggregate(F.regexp_extract_all(cell, F.lit(CODE_SPAN), F.lit(0)), F.lit(0), lambda n, x: n + F.length(x))


def table_code_width(outside: Column) -> Column:
    """Width of code in the widest cell of all tables among ``outside``, the ``(n, line)`` outside fences; 0 without any.

    A table is a row above a divider and the rows right after it, all of two cells or more. The fold keeps the line before, no list.
    """
    shape = lambda cells: F.struct((F.size(cells) >= 2).alias("row"), ((F.size(cells) >= 2) & F.forall(cells, lambda c: c.rlike(TABLE_DIVIDER))).alias("divider"), F.coalesce(F.array_max(F.transform(cells, code_width)), F.lit(0)).alias("width"))
    rows = F.transform(outside, lambda x: F.when(F.contains(x["line"], F.lit("|")), bound(row_cells(x["line"]), shape)))
    start = F.expr("named_struct('inside', false, 'before', 0, 'widest', 0)")

    def step(a: Column, x: Column) -> Column:
        row, divider = F.coalesce(x["row"], F.lit(False)), F.coalesce(x["divider"], F.lit(False))
        return F.struct(
            (row & (a["inside"] | divider)).alias("inside"),
            F.when(row, x["width"]).otherwise(0).alias("before"),
            F.greatest(a["widest"], F.when(divider, a["before"]).otherwise(0), F.when(row & a["inside"], x["width"]).otherwise(0)).alias("widest"),
        )

    return F.aggregate(rows, start, step, lambda a: a["widest"])


def lead_summary(prose: Column) -> Column:
    """The first paragraph after the first H1 and before the next H2 of lines outside fences, joined by spaces; '' if there is none."""
    at = lambda a, p: F.coalesce(F.nullif(F.array_position(F.transform(a, p), True), F.lit(0).cast("long")), F.size(a) + 1).cast("int")
    upto = lambda a, k: F.slice(a, F.lit(1), k - 1)
    after = bound(prose, lambda a: F.slice(a, at(a, lambda x: F.startswith(x, F.lit("# "))) + 1, F.size(a)))
    body = F.transform(bound(after, lambda a: upto(a, at(a, lambda x: F.startswith(x, F.lit("## "))))), stripped)
    begun = bound(body, lambda a: F.slice(a, at(a, lambda x: x != ""), F.size(a)))
    return F.array_join(bound(begun, lambda a: upto(a, at(a, lambda x: x == ""))), " ")


def heading_level(line: Column) -> Column:
    """1 to 6, or 0 if the line is no heading."""
    return F.length(F.regexp_extract(line, rf"^(#{{1,6}})[{SPACE}]+[^{SPACE}]", 1))


def heading_title(line: Column) -> Column:
    return F.regexp_extract(line, rf"^#{{1,6}}[{SPACE}]+(.+?)[{SPACE}]*$", 1)


def link_targets(text: Column) -> Column:
    """Local targets of links that are no images: first word, without angle brackets, query and fragment, percent-decoded."""
    raw = F.regexp_extract_all(text, F.lit(LINK), F.lit(1))
    first = F.transform(raw, lambda t: F.regexp_replace(F.regexp_extract(t, rf"^[{SPACE}]*([^{SPACE}]*)", 1), "^[<>]+|[<>]+$", ""))
    local = F.filter(first, lambda t: (t != "") & ~t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^//|^#"))
    # a plus sign and a percent sign before no number stand for themselves
    decoded = lambda t: F.url_decode(F.regexp_replace(F.replace(F.regexp_replace(t, "(?s)[?#].*$", ""), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.filter(F.transform(local, decoded), lambda t: t != "")


def resolved(path: Column, target: Column) -> Column:
    """A target's path seen from a document's path; null if it leaves the repository, as an absolute one does."""
    full = F.when(~F.startswith(target, F.lit("/")), F.concat(F.regexp_replace(path, "[^/]*$", ""), target))
    steps = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    start = F.expr("named_struct('at', cast(array() as array<string>), 'out', false)")

    def step(a: Column, p: Column) -> Column:
        up = p == ".."
        return F.struct(
            F.when(up, F.slice(a["at"], F.lit(1), F.greatest(F.size(a["at"]) - 1, F.lit(0)))).otherwise(F.concat(a["at"], F.array(p))).alias("at"),
            (a["out"] | (up & (F.size(a["at"]) == 0))).alias("out"),
        )

    return F.aggregate(steps, start, step, lambda a: F.when(~a["out"], F.array_join(a["at"], "/")))


def is_japanese(text: Column, least: int = 20, ratio: float = 0.1) -> Column:
    prose = F.regexp_replace(F.regexp_replace(text, CODE_SPAN, ""), LINK_DESTINATION, "")
    n = F.regexp_count(prose, F.lit(JAPANESE))
    size = F.length(F.regexp_replace(prose, f"[{SPACE}]", ""))
    return (n >= least) & (n >= F.lit(ratio) * size)


def diagram_labels(lines: Column) -> Column:
    """Node, edge, relation and message labels of one diagram's lines; its first line that isn't blank names its type."""
    texts = F.filter(F.transform(lines, stripped), lambda x: x != "")
    sequence = F.lower(F.regexp_extract(F.try_element_at(texts, F.lit(1)), f"^[^{SPACE}]+", 0)) == "sequencediagram"
    body = F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0)))
    kept = F.filter(body, lambda x: ~reduce(lambda a, p: a | F.startswith(x, F.lit(p)), DIRECTIVES, F.lit(False)))
    patterns = (NODE_LABEL, ASYMMETRIC_LABEL, PIPE_EDGE_LABEL, TEXT_EDGE_LABEL)
    relation = lambda x: F.when(F.contains(x, F.lit(":")) & x.rlike(r"\|\||o[|{]|[}|]o"), F.array(F.substring_index(x, ":", -1))).otherwise(F.array().cast("array<string>"))
    labels = lambda x: F.concat(*[F.regexp_extract_all(x, F.lit(p), F.lit(1)) for p in patterns], relation(x))
    message = lambda x: F.regexp_extract_all(x, F.lit(MESSAGE_LABEL), F.lit(1))
    found = F.flatten(F.transform(kept, lambda x: F.when(sequence, message(x)).otherwise(labels(x))))
    return F.filter(F.transform(found, stripped), lambda x: x != "")
