"""What can't be read is never a pass: from git and the disk to a status."""

import json
import os
import subprocess

import pytest

from gatehouse.operators import consistency, scan
from gatehouse.sources import repositories, snapshots

ID = "s/v1"
CONFIG = {"schema": ID, "mode": "enforce", "markdown": {"include": ["docs/**"]}, "impact_map": [{"change": ["src/**", ".github/workflows/**"], "requires_any": ["docs/**"], "allow_github_action_ref_updates": True}]}
FLOW = "jobs:\n  a:\n    steps:\n      - name: x\n        uses: o/r@" + "{}" * 40 + "{}\n"


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    root = tmp_path_factory.mktemp("unknowns")
    git = lambda name, *a, **k: subprocess.run(["git", "-C", str(root / name), "-c", "user.name=T", "-c", "user.email=t@example.invalid", *a], capture_output=True, check=k.get("check", True))

    def make(name):
        subprocess.run(["git", "init", "-q", "-b", "main", str(root / name)], check=True)
        for path, content in (("README.md", "# t\n"), ("docs/a.md", "a\n"), ("src/app.py", "x\n"), ("src/sub/b.py", "y\n"), (".github/workflows/ci.yml", FLOW.format(*"1" * 40, " # v1")), ("conf.json", json.dumps(CONFIG))):
            (root / name / path).parent.mkdir(parents=True, exist_ok=True)
            (root / name / path).write_text(content)
        git(name, "add", ".")
        git(name, "commit", "-qm", "one")
        git(name, "tag", "base")
        git(name, "update-ref", "refs/remotes/origin/main", "HEAD")

    for name in ("fine", "pins", "logic", "mode", "conflict", "linked", "folder", "sparse", "nobase"):
        make(name)
    flow = ".github/workflows/ci.yml"
    for name in ("pins", "logic", "mode"):
        (root / name / flow).write_text(FLOW.format(*"2" * 40, " # v2") + ("      - run: more\n" if name == "logic" else ""))
    os.chmod(root / "mode" / flow, 0o755)
    git("conflict", "checkout", "-q", "-b", "side")
    (root / "conflict/docs/a.md").write_text("side\n")
    git("conflict", "commit", "-qam", "side")
    git("conflict", "checkout", "-q", "main")
    (root / "conflict/docs/a.md").write_text("main\n")
    git("conflict", "commit", "-qam", "main")
    git("conflict", "merge", "-q", "side", check=False)
    (root / "linked/docs/a.md").unlink()
    (root / "linked/docs/a.md").symlink_to("../nowhere")
    (root / "folder/docs/a.md").unlink()
    (root / "folder/docs/a.md").mkdir()
    git("sparse", "update-index", "--skip-worktree", "src/app.py")
    (root / "sparse/src/app.py").unlink()
    git("nobase", "tag", "-d", "base")
    (root / "plain").mkdir()
    return root


def listed(spark, trees, *names):
    return spark.createDataFrame([(n, str(trees / n), "base") for n in names], "repo_id string, path string, base string")


def judged(spark, trees, tmp_path, *names):
    s = snapshots.snapshot(listed(spark, trees, *names), f"file://{tmp_path}/s")
    out = consistency.check(s.repos, s.configs("conf.json"), s.files, ID, s.changes, versions=s.versions)
    return {r.repo_id: (r.status, r.findings) for r in out.collect()}


def test_statuses(spark, trees, tmp_path):
    got = judged(spark, trees, tmp_path, "fine", "pins", "logic", "mode", "conflict", "linked", "folder", "sparse", "nobase", "plain")
    late = ("fail", ["related_docs_update_missing:impact-1"])
    assert got["fine"] == got["pins"] == got["sparse"] == ("pass", []) or got["sparse"] == late
    assert got["logic"] == got["mode"] == late
    assert got["conflict"] == ("tool_error", [consistency.INVENTORY]) == got["plain"]
    assert got["nobase"] == ("tool_error", [consistency.DIFF])
    for name in ("linked", "folder"):
        assert got[name][0] == "tool_error" and "markdown_unreadable:docs/a.md" in got[name][1]


def test_a_subfolder_stands_for_its_repository(spark, trees):
    repos = spark.createDataFrame([("s", str(trees / "fine/src/sub"))], "repo_id string, path string")
    assert {r.path for r in repositories.read_files(repos).collect()} == {"README.md", "docs/a.md", "src/app.py", "src/sub/b.py", ".github/workflows/ci.yml", "conf.json"}
    assert [r.error for r in repositories.read_files(spark.createDataFrame([("p", str(trees / "plain")), ("n", str(trees / "none"))], "repo_id string, path string")).collect()] == ["NotARepository"] * 2


def test_index_and_parts(spark, trees):
    repos = listed(spark, trees, "conflict", "sparse")
    entries = {(r.repo_id, r.path, r.stage, r.tag, r.on_disk) for r in repositories.read_index(repos).collect() if r.path in ("docs/a.md", "src/app.py")}
    assert {x for x in entries if x[0] == "sparse"} == {("sparse", "docs/a.md", 0, "H", True), ("sparse", "src/app.py", 0, "S", False)}
    assert {x[2] for x in entries if x[:2] == ("conflict", "docs/a.md")} == {1, 2, 3}
    one, many = ({(r.repo_id, r.path, r.stage, bytes(r.content)) for r in repositories.read_files(repos, parts).collect()} for parts in (1, 4))
    assert one == many and ("sparse", "src/app.py", 0, b"x\n") not in one


def test_batches_are_bounded_by_bytes(spark, trees, monkeypatch):
    big = trees / "big"
    subprocess.run(["git", "init", "-q", str(big)], check=True)
    for k in range(12):
        (big / f"f{k}").write_bytes(b"x" * 1_000_000)
    monkeypatch.setattr(repositories, "BATCH_BYTES", 3_000_000)
    rows = repositories.read_files(listed(spark, trees, "big"), 2)
    assert sorted(len(r.content) for r in rows.collect()) == [1_000_000] * 12


def test_versions(spark, trees):
    rows = {(r.repo_id, r.path): r for r in repositories.read_versions(listed(spark, trees, "pins", "mode", "linked", "nobase"), matching="yml|a.md").collect()}
    pins, mode, link = rows["pins", ".github/workflows/ci.yml"], rows["mode", ".github/workflows/ci.yml"], rows["linked", "docs/a.md"]
    assert (pins.kind, pins.base_mode, pins.index_mode, pins.disk_mode) == ("M", "100644", "100644", "100644") and b"1" * 40 in bytes(pins.before) and b"2" * 40 in bytes(pins.after)
    assert mode.disk_mode == "100755"
    assert (link.kind, link.disk_mode, bytes(link.before), link.after) == ("T", "120000", b"a\n", None)
    assert rows["nobase", None].error == "CalledProcessError"


def test_scans_name_the_file_that_can_not_be_read(spark, trees, tmp_path):
    s = snapshots.snapshot(listed(spark, trees, "fine", "folder", "plain"), f"file://{tmp_path}/s")
    rows = {r.repo_id: r for r in scan.scan(s.repos, s.files, s.commits, s.objects, s.identities).collect()}
    assert rows["folder"].issues == ["worktree_file_unreadable:docs/a.md"] and rows["plain"].issues == ["not_git_repository"]
    assert rows["fine"].checks["repository_consistency"] == "unknown" and rows["fine"].status == "blocked"
    bases = repositories.read_bases(listed(spark, trees, "fine").drop("base"), "origin/none")
    assert scan.scan(s.repos.where("repo_id = 'fine'"), s.files, s.commits, consistency_bases=bases).first().issues == ["invalid_consistency_base_ref"]


def test_scans_since_a_base_leave_older_findings_out(spark, tmp_path):
    at = tmp_path / "r"
    git = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=T", "-c", "user.email=t@example.invalid", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", "-b", "main", str(at)], check=True)
    (at / "old.txt").write_text("ghp_" + "a" * 24)
    (at / "gone.txt").write_text("x")
    git("add", ".")
    git("commit", "-qm", "old")
    git("update-ref", "refs/remotes/origin/main", "HEAD")
    (at / "new.txt").write_text("fine")
    (at / "new.lnk").symlink_to("new.txt")
    git("rm", "-q", "gone.txt")
    git("add", ".")
    git("commit", "-qm", "new")
    repos = spark.createDataFrame([("r", str(at), "origin/main")], "repo_id string, path string, base string")
    s = snapshots.snapshot(repos, f"file://{tmp_path}/s", since=True)
    files = repositories.files_since(s.files, s.index, s.changes)
    assert [(r.path, r.error) for r in files.collect()] == [("new.txt", None)]
    run = lambda files: json.loads(scan.scan(s.repos, files, s.commits, s.objects, s.identities, bases=s.bases, consistency_expected=False).first().report)["checks"]["secret_scan"]
    assert run(files) == {"status": "pass", "finding_count": 0} and run(s.files)["finding_count"] == 1
    git("rm", "-q", "--cached", "new.txt")
    broken = snapshots.snapshot(repos, f"file://{tmp_path}/t", since=True)
    rows = repositories.files_since(broken.files, broken.index, broken.changes).collect()
    assert [(r.path, r.error) for r in rows] == [(None, "UnknownMode")]


def test_forks_share_what_is_read(spark, tmp_path):
    at = tmp_path / "a"
    subprocess.run(["git", "init", "-q", "-b", "main", str(at)], check=True)
    for k in range(5):
        (at / f"f{k}").write_text(f"{k}" + ("ghp_" + "a" * 24 if k == 3 else ""))
    git = lambda *a: subprocess.run(["git", "-c", "user.name=T", "-c", "user.email=t@example.invalid", *a], check=True, capture_output=True)
    git("-C", str(at), "add", ".")
    git("-C", str(at), "commit", "-qm", "one")
    git("clone", "-q", str(at), str(tmp_path / "b"))
    (tmp_path / "b/own").write_text("see /home/" + "someone/x")
    git("-C", str(tmp_path / "b"), "add", ".")
    git("-C", str(tmp_path / "b"), "commit", "-qm", "two")
    repos = spark.createDataFrame([("a", str(at)), ("b", str(tmp_path / "b"))], "repo_id string, path string")
    inventory = snapshots.stored(repositories.read_inventory(repos), f"file://{tmp_path}/i")
    blobs = snapshots.stored(repositories.read_shared_blobs(repos, inventory, parts=3), f"file://{tmp_path}/blobs")
    assert blobs.count() == 6 and blobs.where("error is not null").count() == 0
    held = scan.history_of(inventory, scan.object_verdicts(blobs))
    whole = scan._history(repositories.read_objects(repos)).collect()
    assert sorted(map(tuple, scan._history(held).collect())) == sorted(map(tuple, whole)) and {(r.repo_id, r.old_secrets, len(r.old_homes)) for r in whole} == {("a", 1, 0), ("b", 1, 1)}
    lost = scan.history_of(inventory, scan.object_verdicts(blobs.limit(2)))
    assert {r.broken_history for r in scan._history(lost).collect()} == {True}
    gone = repositories.read_shared_blobs(spark.createDataFrame([("a", str(tmp_path / "none")), ("b", str(tmp_path / "b"))], "repo_id string, path string"), inventory)
    assert {r.error for r in gone.collect()} == {"NotARepository", None}
