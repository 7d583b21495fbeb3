"""Rules for a document that introduces a repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.functions.patterns import JAPANESE, SPACE, TABLE_DIVIDER
from gatehouse.functions.text import code_width, diagram_labels, heading_level, heading_title, is_japanese, lead_summary, lines_of, mermaid_diagrams, outside_fences, row_cells, table_code_width

#: Words of headings that name a section (fixed values).
SECTIONS = {
    "purpose": ("目的", "why", "overview", "概要"),
    "capabilities": ("できること", "what", "features", "機能"),
    "quickstart": ("クイックスタート", "quickstart", "quick start", "使い方", "usage"),
    "limits": ("制約", "限界", "limitations", "limits", "安全境界", "security", "注意"),
}
#: Phrases that say nothing (fixed values).
GENERIC = ("next-generation", "revolutionary", "cutting-edge", "comprehensive solution")
MAX_LINES = 300
MAX_SUMMARY = 240
MAX_TABLE_CODE = 100
_WORD = r"\p{L}\p{N}_"
#: Headings that announce a user interface (fixed values); those of letters stand together behind one word border, which Java has to be told letter by letter.
UI = rf"(?i)(?<![{_WORD}])(?:ui|interface|dashboard|frontend|web app)(?![{_WORD}])|画面|screenshots?"


def headings(docs: DataFrame) -> DataFrame:
    """``doc_id, n, level, title`` of every heading line, fenced or not."""
    lines = docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    return lines.where(heading_level(F.col("line")) > 0).select("doc_id", (F.col("at") + 1).alias("n"), heading_level(F.col("line")).alias("level"), heading_title(F.col("line")).alias("title"))


def level_jumps(docs: DataFrame) -> DataFrame:
    """``doc_id, n, before, level`` of headings more than one level below the heading before them. A row's lines stay where they are."""
    heads = F.filter(F.transform(lines_of(F.col("text")), lambda x, i: F.struct((i + 1).alias("n"), heading_level(x).alias("level"))), lambda h: h["level"] > 0)
    rows = docs.select("doc_id", heads.alias("heads"))
    pairs = F.zip_with(F.slice("heads", F.lit(2), F.greatest(F.size("heads") - 1, F.lit(0))), F.slice("heads", F.lit(1), F.greatest(F.size("heads") - 1, F.lit(0))), lambda h, b: F.struct(h["n"].alias("n"), b["level"].alias("before"), h["level"].alias("level")))
    return rows.select("doc_id", F.inline(F.filter(pairs, lambda x: x["level"] > x["before"] + 1)))


def _names(heads: Column, words: tuple[str, ...]) -> Column:
    return F.exists(heads, lambda h: reduce(lambda a, w: a | F.contains(F.lower(h["title"]), F.lit(w)), words, F.lit(False)))


def review(docs: DataFrame) -> DataFrame:
    """``doc_id, codes, status, japanese`` of ``release_review``."""
    return release_review(docs).select("doc_id", "codes", "status", "japanese")


def release_review(docs: DataFrame) -> DataFrame:
    """``doc_id, codes, status, release_gate, recommended`` and metrics of ``docs(doc_id, text)``; a null text is a missing document.

    All rules. One row's lines are folded where they are; nothing is shuffled.
    """
    rows = docs.select("doc_id", F.col("text").isNull().alias("absent"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n").alias("text")).withColumn("lines", lines_of(F.col("text")))
    # a heading of white space alone counts, as in the reference
    heads = F.transform("lines", lambda x: F.struct(F.length(F.regexp_extract(x, rf"^(#{{1,6}})[{SPACE}]+.", 1)).alias("level"), F.regexp_extract(x, rf"^#{{1,6}}[{SPACE}]+(.*?)[{SPACE}]*$", 1).alias("title")))
    rows = rows.withColumn("heads", F.filter(heads, lambda h: h["level"] > 0)).withColumn("outside", outside_fences(F.col("lines"))).withColumn("diagrams", F.transform(mermaid_diagrams(F.col("lines")), diagram_labels))
    rows = rows.withColumn("table_code", table_code_width(F.col("outside"))).withColumn("prose", F.transform("outside", lambda x: x["line"]))
    rows = rows.withColumn("summary", lead_summary(F.col("prose"))).withColumn("japanese", is_japanese(F.array_join("prose", "")))
    levels = F.transform("heads", lambda h: h["level"])
    jump = F.exists(F.zip_with(levels, F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: b > a + 1), lambda x: F.coalesce(x, F.lit(False)))
    lacks = {k: ~_names(F.col("heads"), words) for k, words in SECTIONS.items()}
    errors = {
        "missing_h1": F.coalesce(F.try_element_at(levels, F.lit(1)) != 1, F.lit(True)),
        "missing_lead_summary": F.col("summary") == "",
        "lead_summary_too_long": F.length("summary") > MAX_SUMMARY,
        "heading_level_jump": jump,
        "readme_too_long": F.size("lines") > MAX_LINES,
        **{f"missing_{k}_section": c for k, c in lacks.items()},
    }
    warnings = {
        "table_command_cell_too_wide": F.col("japanese") & (F.col("table_code") > MAX_TABLE_CODE),
        "generic_marketing_copy": reduce(lambda a, p: a | F.contains(F.lower("text"), F.lit(p)), GENERIC, F.lit(False)),
        "decorative_heading_emoji": F.exists("lines", lambda x: x.rlike(rf"^#{{1,6}}[{SPACE}]+[^{_WORD}`#{SPACE}]")),
        "diagram_labels_not_localized": F.col("japanese") & F.exists("diagrams", lambda d: (F.size(d) > 0) & ~F.exists(d, lambda x: x.rlike(JAPANESE))),
    }
    rows = rows.withColumns({k: c for k, c in (errors | warnings).items()})
    steps = F.regexp_count("text", F.lit(rf"(?dm)^[{SPACE}]*\p{{Nd}}+[.)][{SPACE}]+"))
    image, surface = F.col("text").rlike(r"!\[[^\]]*\]\([^)]+\)"), F.exists("heads", lambda h: h["title"].rlike(UI))
    advice = {
        "Template Creator": F.col("missing_h1") | F.col("table_command_cell_too_wide") | reduce(lambda a, k: a | F.col(f"missing_{k}_section"), SECTIONS, F.lit(False)),
        "Product Design": F.col("missing_lead_summary") | F.col("missing_purpose_section") | F.col("missing_capabilities_section"),
        "Localize Diagram": F.col("diagram_labels_not_localized"),
        "ai-slop-check": F.col("decorative_heading_emoji"),
        "Visualize": (steps >= 4) & (F.size("diagrams") == 0),
        "Figma or frontend-design": surface & ~image,
    }
    listed = lambda names: F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in names.items()])))
    bad = F.col("absent") | reduce(lambda a, k: a | F.col(k), errors, F.lit(False))
    unless_absent = lambda c: F.when(~F.col("absent"), c)
    return rows.select(
        "doc_id",
        F.when(F.col("absent"), F.array(F.lit("readme_missing"))).otherwise(listed({k: F.col(k) for k in (errors | warnings)})).alias("codes"),
        F.when(bad, "blocked").otherwise("pass").alias("status"),
        F.when(F.col("absent"), "blocked_readme_missing").when(bad, "blocked_readme_design").otherwise("passed_readme_design").alias("release_gate"),
        F.when(F.col("absent"), F.array(F.lit("Template Creator"))).otherwise(listed(advice)).alias("recommended"),
        unless_absent(F.size("lines")).alias("line_count"),
        unless_absent(F.size("heads")).alias("heading_count"),
        unless_absent(F.length("summary")).alias("lead_summary_chars"),
        unless_absent(F.col("japanese")).alias("japanese"),
        unless_absent(F.col("table_code")).alias("widest_table_command_cell"),
        unless_absent(F.size("diagrams")).alias("diagram_count"),
        unless_absent(F.size(F.flatten("diagrams"))).alias("diagram_label_count"),
    )


def wide_table_rows(docs: DataFrame, limit: int = MAX_TABLE_CODE) -> DataFrame:
    """``doc_id, n, width`` of table rows outside fences that have a cell with more than ``limit`` characters of code, whatever the document's language.

    Rows are numbered over runs of adjacent rows, so a document's lines meet in one window; other columns of ``docs`` are ignored.
    """
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text")  # before the lines are dealt out
    lines = numbered.select("doc_id", "rid", F.posexplode(outside_fences(lines_of(F.col("text")))).alias("at", "l")).where(F.contains("l.line", F.lit("|")))
    rows = lines.select("doc_id", "rid", "at", "l.n", row_cells(F.col("l.line")).alias("cells")).where(F.size("cells") >= 2)
    rows = rows.select("doc_id", "rid", "at", "n", F.forall("cells", lambda c: c.rlike(TABLE_DIVIDER)).alias("divider"), F.coalesce(F.array_max(F.transform("cells", code_width)), F.lit(0)).alias("width"))
    in_order = Window.partitionBy("rid").orderBy("at")
    rows = rows.withColumn("run", F.col("at") - F.row_number().over(in_order)).withColumn("next", (F.lead("at").over(in_order) == F.col("at") + 1) & F.lead("divider").over(in_order))
    before = Window.partitionBy("rid", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.bool_or("divider").over(before), F.lit(False)) | F.coalesce("next", F.lit(False))
    return rows.withColumn("inside", inside).where(F.col("inside") & (F.col("width") > limit)).select("doc_id", "n", "width")


def fence_free_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(outside_fences(lines_of(F.col("text")))).alias("l")).select("doc_id", "l.n", "l.line")


def labels(docs: DataFrame) -> DataFrame:
    """``doc_id, n, labels`` of every Mermaid diagram in ``docs(doc_id, text)``, numbered from 1."""
    found = docs.select("doc_id", F.posexplode(mermaid_diagrams(lines_of(F.col("text")))).alias("at", "lines"))
    return found.select("doc_id", (F.col("at") + 1).alias("n"), diagram_labels(F.col("lines")).alias("labels"))
