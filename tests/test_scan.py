import json
import subprocess

import pytest

from gatehouse.operators import dialogue, scan
from gatehouse.operators.checks import REQUIRED_DOCUMENTS
from gatehouse.sources import repositories

ME = "T <t@example.invalid>"
SECRET = "ghp_" + "a" * 24


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    root = tmp_path_factory.mktemp("trees")
    git = lambda name, *a: subprocess.run(["git", "-C", str(root / name), *a], check=True, capture_output=True)

    def make(name):
        subprocess.run(["git", "init", "-q", "-b", "main", str(root / name)], check=True)
        for k, v in (("user.name", "T"), ("user.email", "t@example.invalid")):
            git(name, "config", k, v)
        for d in REQUIRED_DOCUMENTS:
            (root / name / d).write_text("# t\nreviewed\n")
        (root / name / ".github/workflows").mkdir(parents=True)
        (root / name / ".github/workflows/ci.yml").write_text("name: x\njobs:\n")
        git(name, "remote", "add", "origin", "https://u:p@Example.com/x.git?q")
        git(name, "add", ".")
        git(name, "commit", "-qm", "one")
        git(name, "update-ref", "refs/remotes/origin/main", "HEAD")

    for name in ("clean", "bad", "other"):
        make(name)
    (root / "bad/key.txt").write_text(SECRET)
    git("bad", "add", ".")
    git("bad", "commit", "-qm", "two")
    (root / "bad/key.txt").unlink()
    git("bad", "rm", "-q", "--cached", "key.txt")
    git("bad", "-c", "user.name=U", "commit", "-qm", "three")
    (root / "bad/notes.md").write_text("see /home/" + "someone/x")
    (root / "bad/LICENSE").unlink()
    git("other", "remote", "remove", "origin")
    git("other", "checkout", "-q", "-b", "side")
    git("other", "commit", "-q", "--allow-empty", "-m", "side")
    git("other", "update-ref", "refs/remotes/origin/side", "HEAD")
    git("other", "checkout", "-q", "main")
    (root / "plain").mkdir()
    return root


def scanned(spark, trees, names=("clean", "bad", "other", "plain"), base=None, revisions="--all", **more):
    repos = spark.createDataFrame([(n, str(trees / n)) for n in names], "repo_id string, path string")
    bases = repositories.read_bases(repos, base) if base else None
    out = scan.scan(repositories.read_repositories(repos), repositories.read_files(repos), repositories.read_commits(repos, revisions), repositories.read_objects(repos, revisions), repositories.read_identities(repos), bases=bases, expected=ME, marker="reviewed", consistency_expected=False, **more)
    return {r.repo_id: r for r in out.collect()}


def test_whole_scans(spark, trees):
    rows = scanned(spark, trees)
    assert {k: r.status for k, r in rows.items()} == {"clean": "pass", "bad": "blocked", "other": "blocked", "plain": "tool_error"}
    assert rows["plain"].issues == ["not_git_repository"] and rows["plain"].checks is None and rows["plain"].exit_code == 2
    assert "checks" not in json.loads(rows["plain"].report)
    bad, text = json.loads(rows["bad"].report)["checks"], rows["bad"].report
    assert SECRET not in text and "someone" not in text
    assert bad["secret_scan"] == {"status": "fail", "finding_count": 1}
    assert bad["personal_path_scan"] == {"status": "fail", "files": ["notes.md"]}
    assert bad["required_documents"] == {"status": "fail", "missing": ["LICENSE"], "invalid": []}
    assert bad["clean_worktree"]["status"] == "fail"
    assert (bad["commit_identity"]["identity_count"], bad["commit_identity"]["mismatch_count"], bad["commit_identity"]["effective_identity"]) == (2, 1, "pass")
    clean = json.loads(rows["clean"].report)
    assert clean["checks"]["origin"] == {"status": "pass", "url": "https://example.com/x.git"}
    assert clean["publication_decision"] == "blocked_human_review_required" and len(clean["head"]) == 40
    assert rows["other"].checks["origin"] == "unknown" and rows["other"].checks["ci_configuration"] == "pass"
    assert rows["clean"].checks["dependency_vulnerability_audit"] == "not_applicable"


def test_scans_since_a_base(spark, trees):
    rows = scanned(spark, trees, ("clean", "other"), "origin/side")
    assert {k: (r.status, r.issues) for k, r in rows.items()} == {k: ("tool_error", ["invalid_non_remote_or_non_ancestor_base_ref"]) for k in ("clean", "other")}
    rows = scanned(spark, trees, ("clean", "bad"), "origin/main", "origin/main..HEAD")
    assert rows["clean"].status == "pass" and rows["clean"].checks["required_documents"] == "not_evaluated"
    assert json.loads(rows["bad"].report)["scan_scope"]["resolved_base_ref"] == "refs/remotes/origin/main"
    local = scanned(spark, trees, ("clean",), "main")
    assert local["clean"].status == "tool_error"  # a branch of its own is no base


def test_releases_and_what_is_asked_after_a_scan(spark, trees):
    rows = scanned(spark, trees, ("clean",), release=True)
    assert rows["clean"].status == "blocked" and rows["clean"].checks["readme_release_design"] == "fail"
    repos = spark.createDataFrame([("clean", str(trees / "clean")), ("bad", str(trees / "bad"))], "repo_id string, path string")
    out = scan.scan(repositories.read_repositories(repos), repositories.read_files(repos), repositories.read_commits(repos))
    props = dialogue.conversation(out, scan.check_rows(out), "push")
    asked = {(r.repo_id, r.id) for r in props.collect()}
    assert ("bad", "create_missing_license") in asked and ("bad", "handle_dirty_worktree") in asked and ("clean", "configure_expected_identity") in asked
    assert not any(i.startswith("create_missing") for r, i in asked if r == "clean")


def test_what_is_unknown_is_no_pass(spark):
    repos = spark.createDataFrame([("a", "h", False, "o", None), ("b", None, None, None, "CalledProcessError"), (None, "h", False, "o", None)], "repo_id string, head string, dirty boolean, origin string, error string")
    files = spark.createDataFrame([("a", "x", None, "OSError")], "repo_id string, path string, content binary, error string")
    commits = spark.createDataFrame([], "repo_id string, author string, committer string, error string")
    rows = {r.repo_id: r for r in scan.scan(repos, files, commits).collect()}
    assert rows["a"].issues == ["git_worktree_inventory_failed"] and rows["b"].issues == ["git_probe_failed"]
    assert rows[None].status == "blocked"
    more = scan.scan(repos, files.limit(0), commits, expected="x").where("repo_id = 'a'").first()
    assert more.checks["commit_identity"] == "unknown"
    assert scan.scan(repos.limit(0), files, commits).count() == 0


def test_reports_with_their_options_and_boundaries(spark, trees):
    repos = spark.createDataFrame([("clean", str(trees / "clean")), ("plain", str(trees / "plain"))], "repo_id string, path string")
    bases = repositories.read_bases(repos, "origin/main")
    out = scan.scan(repositories.read_repositories(repos), repositories.read_files(repos), repositories.read_commits(repos), consistency_bases=bases, consistency_expected=False)
    rows = {r.repo_id: json.loads(r.report) for r in scan.enriched(out, "report/v1", "team", "release", True, ME, ["reads only"], ["no approval"]).collect()}
    assert rows["clean"]["options"] == {"audience": "team", "mode": "release", "expected_identity_configured": True, "intent": "release", "consistency_base_ref": "refs/remotes/origin/main"}
    assert rows["clean"]["schema"] == "report/v1" and rows["clean"]["consistency_scope"]["mode"] == "target_diff" and rows["clean"]["non_guarantees"] == ["no approval"]
    assert rows["plain"]["issues"] == ["not_git_repository"] and rows["plain"]["options"]["mode"] == "release"
