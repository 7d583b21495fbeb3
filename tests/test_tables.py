import random

from pyspark.sql import functions as F

from gatehouse.functions.text import outside_fences, row_cells, table_code_width
from gatehouse.operators import readme


def plain_cells(line):
    """Pipes are counted off one by one, by what precedes them."""
    line, cuts, at, code = line.strip(), [-1], 0, False
    while at < len(line):
        if line[at] == "\\":
            at += 2
            continue
        code ^= line[at] == "`"
        if line[at] == "|" and not code:
            cuts.append(at)
        at += 1
    cells = [line[a + 1 : b].strip() for a, b in zip(cuts, [*cuts[1:], len(line)], strict=True)]
    cells = cells[1:] if cells and not cells[0] else cells
    return cells[:-1] if cells and not cells[-1] else cells


def test_cells_by_every_kind_of_pipe(spark):
    rng = random.Random(5)
    lines = ["", "|", "||", "a|b", "|a|b|", "a \\| b | c", "`a|b` | c", "open ` | x", "tail \\", "|　a　|", "a\\`|b`|c"]
    lines += ["".join(rng.choice("ab|`\\ -:") for _ in range(rng.randrange(14))) for _ in range(600)]
    lines.append("`" + "x" * 200_000 + "` | " + "y|" * 3)
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, line string").select("k", row_cells(F.col("line")).alias("c")).collect()
    for r in rows:
        assert r.c == plain_cells(lines[r.k]), lines[r.k]


TEXTS = [
    "| a | b |\n|---|:---:|\n| `xyz` | `a` `bc` |\nno table\n| `far` | away |",
    "```\n| a | b |\n|---|---|\n| `code in a fence` | x |\n```",
    "| `head` | b |\n|---|---|",
    "x | `longer than all`\n\n|---|---|\n| `in` | y |\none cell `not here`\n| `nor` | `here` |",
    "|---|---|\n|---|---|\n| `two` | dividers |",
    "| `no` | divider |\n| -- | -- |\n| `s` | t |",
    "",
    None,
]


def test_code_in_tables(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id int, text string")
    widths = docs.select("doc_id", table_code_width(outside_fences(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("w")).orderBy("doc_id").collect()
    assert [r.w for r in widths] == [7, 0, 6, 4, 5, 0, 0, 0]
    rows = readme.wide_table_rows(docs, 3).orderBy("doc_id", "n").collect()
    assert [(r.doc_id, r.n, r.width) for r in rows] == [(0, 3, 7), (2, 1, 6), (3, 4, 4), (4, 3, 5)]


def test_wide_code_is_a_warning_in_japanese_documents_only(spark):
    table = "| a | b |\n|---|---|\n| `" + "x" * 99 + "` | c |\n"
    body = "# T\nsummary\n## Overview\n## Features\n## Usage\n## Security\n"
    docs = spark.createDataFrame([(0, body + table), (1, body + "これは日本語の文章です" * 3 + "\n" + table), (2, body + "これは日本語の文章です" * 9 + "\n" + table.replace("xx", "", 1))], "doc_id int, text string")
    rows = readme.release_review(docs).orderBy("doc_id").collect()
    assert [r.codes for r in rows] == [[], ["table_command_cell_too_wide"], []]
    assert [r.status for r in rows] == ["pass"] * 3
    assert [r.widest_table_command_cell for r in rows] == [101, 101, 99]
    assert rows[1].recommended == ["Template Creator"]
