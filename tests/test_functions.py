import fnmatch
import random
import re
import subprocess
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from gatehouse.functions import globs, patterns, text
from gatehouse.operators import checks, consistency, dialogue, readme
from gatehouse.sources import repositories


def column(spark, values, expr):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in df.select("k", expr(F.col("v")).alias("x")).orderBy("k").collect()]


def test_globs_against_the_standard_library(spark):
    rng = random.Random(1)
    words = ["README.md", "docs", "a", "b.md", "x.png", "auth", ".github", "sub"]
    paths = ["/".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    for g in ("README.md", "docs/**", "docs/*.md", "**/auth/**", "**/*.png", "*.md", "a/?.md", "[ab]*", ".github/**", "**/*a*"):
        rx = re.compile(globs.glob_regex(g))
        short = g.replace("**/", "", 1)
        want = [any(fnmatch.fnmatchcase(p, x) or PurePosixPath(p).match(x) for x in (g, short)) for p in paths]
        assert [bool(rx.search(p)) for p in paths] == want, g
        assert column(spark, paths, lambda c, g=g: c.rlike(globs.glob_regex(g))) == want


def test_lines(spark):
    rng = random.Random(2)
    values = ["".join(rng.choice("ab\n\r\x0b\x0c\x1c\x85  ") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    assert column(spark, values, text.lines_of) == [v.splitlines() for v in values]


def test_secrets_near_misses_and_percent_encoding(spark):
    body = "A" * 20
    values = [f"sk-{body}", f"sk-{body[1:]}", f"sk%2D{body}", f"s%6b-{body}", "50% off", "%zz%", None, "AKIA" + "Z" * 16, "xoxb-1234567890", "BEGIN RSA PRIVATE KEY", "BEGIN PUBLIC KEY", f"gho_{body}", f"ghx_{body}"]
    want = [True, False, True, True, False, False, False, True, True, True, False, True, False]
    assert column(spark, values, lambda c: patterns.has_any(c, patterns.SECRETS)) == want


def test_paths_and_white_space(spark):
    assert column(spark, ["/home/x", "/home/ x", "/home/　", "/Users/a b", r"C:\Users\me", "/homes/x"], lambda c: patterns.has_any(c, patterns.HOME_PATHS)) == [True, False, False, True, True, False]


def test_remotes(spark):
    given = ["https://user:pw@host.org/a/b.git?x=1#y", "git@host:team/x.git", "host.org:x", "/srv/x", "user@h:p?t", "", "ssh://git@h:22/x", "C:/x", "https://GitHub.COM/X.git"]
    assert column(spark, given, patterns.redacted_remote) == ["https://host.org/a/b.git", "host:team/x.git", "host.org:x", "/srv/x", "h:p", None, "ssh://h:22/x", "C:/x", "https://github.com/X.git"]


def test_links_and_resolution(spark):
    v = "[a](x)[b](y \"t\") ![i](z.png) [c](<w.md>) [d](http://u/) [e](#f) [g](mailto:a@b) [h](k.md?q#f) [j](my%20f%C3%A9+%zz.md)"
    assert column(spark, [v, "[x]( )", None], text.link_targets) == [["x", "y", "w.md", "k.md", "my fé+%zz.md"], [], None]
    df = spark.createDataFrame([("docs/a.md", "../b.md"), ("a.md", "../b"), ("d/e/f.md", "./g/../h"), ("d/a.md", "/top.md")], "p string, t string")
    assert [r.x for r in df.select(text.resolved(F.col("p"), F.col("t")).alias("x")).collect()] == ["b.md", None, "d/e/h", None]


def fence_free(lines):
    mark, out = None, []
    for n, line in enumerate(lines, 1):
        opens = re.match(r"^\s*(`{3,}|~{3,})([^`]*)$", line)
        if opens and mark is None:
            mark = opens[1]
        elif mark and line.lstrip().startswith(mark):
            mark = None
        elif mark is None:
            out.append((n, line))
    return out


def test_fences(spark):
    rng = random.Random(4)
    pieces = ["a", "```", "```sh", "````", " ~~~", "~~~~ x", "``` x`", "b", ""]
    given = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(400)] + ["```\n# in\n```sh\n# out"]
    found = column(spark, given, lambda c: text.outside_fences(text.lines_of(c)))
    assert [[(x.n, x.line) for x in f] for f in found] == [fence_free(v.splitlines()) for v in given]


def test_review_and_japanese(spark):
    docs = spark.createDataFrame([(1, "# T\nA tool.\n## Overview\n## What\n## Usage\n## Limits\n"), (2, "### x\n"), (3, None), (4, "# 道具\n" + "これは日本語の文章です。" * 4), (5, "# T\n### j\n" + "x\n" * 300), (6, "# T\n## Overview\n## What\n## Usage\n## Limits\n"), (7, "# 道具\n~~~\n" + "これは日本語の文章です。" * 4)], "doc_id long, text string")
    rows = {r.doc_id: r for r in readme.review(docs).collect()}
    assert (rows[1].codes, rows[1].status) == ([], "pass")
    assert "missing_h1" in rows[2].codes
    assert rows[3].codes == ["readme_missing"]
    assert rows[4].japanese and not rows[7].japanese  # fenced text is no prose
    assert {"heading_level_jump", "readme_too_long"} <= set(rows[5].codes)
    assert (rows[6].codes, rows[6].status) == (["missing_lead_summary"], "blocked")


def test_unknown_blocks_and_is_no_pass(spark):
    rows = spark.createDataFrame([("a", "origin", "unknown"), ("a", "secret_scan", "pass"), ("b", "origin", "pass"), ("b", "human_visual_review", "unknown"), ("c", "origin", "fail"), ("c", "secret_scan", "tool_error")], "repo_id string, name string, status string")
    assert {r.repo_id: r.status for r in checks.rollup(rows).collect()} == {"a": "blocked", "b": "pass", "c": "tool_error"}


def test_modes(spark):
    df = spark.createDataFrame([(None, ["f"], [], [], False), ("shadow", ["f"], [], [], False), ("enforce", ["f"], [], [], False), ("ratchet", ["f"], [], ["g"], False), ("ratchet", ["f"], [], [], False), ("shadow", ["f"], [], [], True), ("enforce", [], [], [], False)], "m string, f array<string>, n array<string>, r array<string>, u boolean")
    assert [r.s for r in df.select(consistency.gate_status(*[F.col(c) for c in "mfnru"]).alias("s")).collect()] == ["not_configured", "shadow_findings", "fail", "fail", "pass", "tool_error", "pass"]


def test_dismissals(spark):
    df = spark.createDataFrame([("forever",), ("snooze_7d",), ("30d",), ("8d",)], "m string")
    rows = [r.d for r in df.select(dialogue.record_dismissal(F.col("m"), F.expr("date '2024-01-01'")).alias("d")).collect()]
    assert [(r.mode, str(r.until)) if r else None for r in rows] == [("forever", "None"), ("snooze", "2024-01-08"), ("snooze", "2024-01-31"), None]
    limits = spark.createDataFrame([("security_hold", "recommended"), ("github_baseline", "required"), ("x", "recommended"), ("external_evidence", "required"), ("x", "required"), ("x", "info")], "k string, s string")
    assert [r.m for r in limits.select(dialogue.max_dismissal(F.col("k"), F.col("s")).alias("m")).collect()] == [None, "90d", "forever", "30d", None, "forever"]


def test_git_snapshot_to_status(spark, tmp_path):
    repo = tmp_path / "r"
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=T", "-c", "user.email=t@example.invalid", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    secret = "sk-" + "A" * 24
    (repo / "old.txt").write_text(secret)
    git("add", ".")
    git("commit", "-qm", "one")
    (repo / "old.txt").write_text("clean")
    (repo / "link").symlink_to("old.txt")
    for name in checks.REQUIRED_DOCUMENTS:
        (repo / name).write_text(f"# {name}\n")
    git("add", ".")
    git("commit", "-qm", "two")
    (repo / "new.txt").write_text("untracked")
    repos = spark.createDataFrame([("r", str(repo)), ("none", str(tmp_path / "none"))], "repo_id string, path string")
    files = repositories.read_files(repos)
    assert {(r.path, r.tracked) for r in files.where("error is null").collect()} == {("old.txt", True), ("new.txt", False), *((n, True) for n in checks.REQUIRED_DOCUMENTS)}
    assert [r.repo_id for r in files.where("error is not null").collect()] == ["none"]
    text_ = files.where("error is null").withColumn("content", F.expr("decode(content, 'UTF-8')"))
    old = repositories.read_objects(repos).where("error is null").withColumn("content", F.expr("decode(content, 'UTF-8')"))
    found = checks.secret_scan(text_, old).first()
    assert (found.finding_count, found.status) == (1, "fail")
    assert checks.required_documents(repos.where("repo_id = 'r'"), text_).first().status == "pass"
    facts = {r.repo_id: r for r in repositories.read_repositories(repos).collect()}
    assert facts["r"].dirty
    assert facts["r"].origin is None
    commits = repositories.read_commits(repos).where("error is null")
    assert commits.count() == 1
    assert checks.commit_identity(commits, "T <t@example.invalid>").first().status == "pass"
    assert checks.commit_identity(commits, "other").first().status == "fail"


def test_matched_text_is_never_shown(spark):
    secret = "ghp_" + "b" * 24
    files = spark.createDataFrame([("r", f"{secret}/home.md", f"/home/me {secret}"), ("r", f"x/{secret}", "/home/me")], "repo_id string, path string, content string")
    assert secret not in str(checks.personal_path_scan(files).collect())
    assert secret not in str(checks.secret_scan(files).collect())


@pytest.mark.parametrize("empty", ["repo_id string, path string, content string"])
def test_empty_tables(spark, empty):
    files = spark.createDataFrame([], empty)
    assert checks.secret_scan(files).count() == 0
    assert checks.personal_path_scan(files).count() == 0
    assert consistency.link_findings(files, files).count() == 0


def test_fences_take_linear_time(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("```sh\nx\n```\ny\n" * (n // 4),)], "t string").select(F.size(text.outside_fences(text.lines_of(F.col("t")))))
        best = 9e9
        for _ in range(4):
            began = time.perf_counter()
            assert df.collect()[0][0] == n // 4
            best = min(best, time.perf_counter() - began)
        return best

    seconds(8000)
    assert seconds(64_000) < 20 * seconds(8000)  # eight times the lines; quadratic work would take 64 times as long


def test_blocks_beyond_one_chunk(spark):
    given = "".join(f"~~~ i{k}\nin\n~~~\nout{k}\n" for k in range(700)) + "```\nopen"
    row = spark.createDataFrame([(given,)], "t string").select(text.fence_blocks(text.lines_of(F.col("t"))).alias("b"), text.outside_fences(text.lines_of(F.col("t"))).alias("o")).collect()[0]
    assert [(b["first"], b["last"], b["info"], b["closed"]) for b in row["b"]] == [(4 * k + 1, 4 * k + 3, f"i{k}", True) for k in range(700)] + [(2801, 2802, "", False)]
    assert [tuple(x) for x in row["o"]] == [(4 * k + 4, f"out{k}") for k in range(700)]
