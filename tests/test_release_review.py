from pyspark.sql import functions as F

from gatehouse.functions import text
from gatehouse.operators import readme

SECTIONS = "## Overview\n## What\n## Usage\n## Limits\n"


def review(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in readme.release_review(docs).orderBy("doc_id").collect()]


def test_summary_is_demanded_and_bounded(spark):
    none, short, exact, long, fenced, late, crlf = review(
        spark,
        "# T\n" + SECTIONS,
        "# T\n\nfor whom\n  and why  \n\nmore\n" + SECTIONS,
        "# T\n" + "x" * 240 + "\n" + SECTIONS,
        "# T\n" + "x" * 241 + "\n" + SECTIONS,
        "# T\n  ```sh\ninside\n  ```\n" + SECTIONS,
        "# T\n" + SECTIONS + "late text\n",
        "# T\r\nwhy\r\n" + SECTIONS,
    )
    for r in (none, fenced, late):
        assert (r.codes, r.status, r.recommended, r.lead_summary_chars) == (["missing_lead_summary"], "blocked", ["Product Design"], 0)
    assert (short.codes, short.status, short.release_gate, short.lead_summary_chars) == ([], "pass", "passed_readme_design", len("for whom and why"))
    assert (exact.codes, exact.lead_summary_chars) == ([], 240)
    assert (long.codes, long.status, long.lead_summary_chars) == (["lead_summary_too_long"], "blocked", 241)
    assert (crlf.codes, crlf.line_count) == ([], 6)


def test_absent_and_recommendations(spark):
    absent, steps, drawn, screen, shown, guide = review(
        spark,
        None,
        "# T\nwhy\n" + SECTIONS + "1. a\n 2) b\n3. c\n4. d\n",
        "# T\nwhy\n" + SECTIONS + "1. a\n2. b\n3. c\n4. d\n~~~ Mermaid\ngraph LR\nA[b c]\n",
        "# T\nwhy\n" + SECTIONS + "## The UI\n",
        "# T\nwhy\n" + SECTIONS + "## 画面\n![i](x.png)\n",
        "# T\nwhy\n" + SECTIONS + "## Guide\n",
    )
    assert (absent.codes, absent.release_gate, absent.recommended, absent.line_count) == (["readme_missing"], "blocked_readme_missing", ["Template Creator"], None)
    assert [r.recommended for r in (steps, drawn, screen, shown, guide)] == [["Visualize"], [], ["Figma or frontend-design"], [], []]
    assert (drawn.diagram_count, drawn.diagram_label_count) == (1, 1)


def test_labels_of_a_japanese_document(spark):
    prose = "これは日本語の文章です。" * 9
    plain, local, some = review(spark, *("# T\n" + prose + "\n" + SECTIONS + f"```mermaid\ngraph LR\n{x}\n```\n" for x in ("A[read it]", "A[読む]", "style x")))
    assert (plain.codes, plain.status, plain.recommended) == (["diagram_labels_not_localized"], "pass", ["Localize Diagram"])
    assert local.codes == some.codes == []


def test_diagrams_in_whole_texts(spark):
    given = "a\n```mermaid\n\ngraph LR\nA[in it] --> B>odd one]\n```\n````md\n```mermaid\nA[example]\n```\n````\n> ~~~ MERMAID \n> erDiagram\n> A ||--o{ B : has\n>\n> ~~~\n```mermaid x\nA[info string]\n```\n```mermaid\nsequenceDiagram\nA->>B: hi there"
    docs = spark.createDataFrame([(1, given), (2, "no diagram"), (3, "```mermaid\n```")], "doc_id long, text string")
    assert [tuple(r) for r in readme.labels(docs).orderBy("doc_id", "n").collect()] == [(1, 1, ["in it", "odd one"]), (1, 2, ["has"]), (1, 3, ["hi there"]), (3, 1, [])]
    assert docs.select(text.mermaid_diagrams(text.lines_of(F.col("text"))).alias("d")).count() == 3
