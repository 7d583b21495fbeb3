import json
import subprocess

import pytest

from gatehouse.functions.config import _config
from gatehouse.operators import consistency
from gatehouse.sources import repositories, snapshots

ID = "s/v1"
BASE = {"schema": ID, "mode": "shadow"}
SHA = "0" * 64


@pytest.mark.parametrize(
    ("more", "valid"),
    [
        ({}, True),
        ({"$schema": "x", "markdown": {"include": []}, "ratchet": {"baseline": ["a"]}}, True),
        ({"mode": "off"}, False),
        ({"mode": ["shadow"]}, False),
        ({"schema": "other"}, False),
        ({"extra": 1}, False),
        ({"markdown": {"include": [""]}}, False),
        ({"markdown": []}, False),
        ({"readme_contracts": {"commands": [{"text": "x", "paths": ["a"]}]}}, True),
        ({"readme_contracts": {"commands": [{"paths": ["a"]}]}}, False),
        ({"readme_contracts": {"required_paths": ["../x"]}}, False),
        ({"impact_map": [{"change": ["a"], "requires_any": ["b"], "allow_github_action_ref_updates": True}]}, True),
        ({"impact_map": [{"change": [], "requires_any": ["b"]}]}, False),
        ({"impact_map": [{"change": ["a"], "requires_any": ["b"], "allow_github_action_ref_updates": 1}]}, False),
        ({"generated_artifacts": [{"path": "a", "sha256": SHA}]}, True),
        ({"generated_artifacts": [{"path": "a", "sha256": SHA.replace("0", "G")}]}, False),
        ({"ratchet": {"baseline": ["a", "a"]}}, False),
    ],
)
def test_configurations(more, valid):
    assert _config(ID)(BASE | more) is valid
    assert not _config(ID)([BASE])


def test_a_repository_with_a_rename_from_git_to_status(spark, tmp_path):
    repo = tmp_path / "r"
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=T", "-c", "user.email=t@example.invalid", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    (repo / "src").mkdir()
    (repo / "docs").mkdir()
    (repo / "src/old.py").write_text("print('a long enough line to be seen as a rename')\n" * 5)
    (repo / "docs/a.md").write_text("[there](../README.md) [folder](../src) [out](../../x)")
    (repo / "README.md").write_text("# T\nrun `make`\n")
    (repo / "gone.txt").write_text("x")
    (repo / "bytes.md").write_bytes(b"\xff\xfe\x00bad")
    git("add", ".")
    git("commit", "-qm", "one")
    git("tag", "base")
    git("mv", "src/old.py", "lib.py")
    git("commit", "-qm", "two")
    (repo / "gone.txt").unlink()
    repos = spark.createDataFrame([("r", str(repo))], "repo_id string, path string")
    changes = repositories.read_changes(repos, "base")
    assert {(r.scope, r.kind, r.path, r.old_path) for r in changes.where("scope <> 'base'").collect()} == {("committed", "R", "lib.py", "src/old.py"), ("worktree", "R", "lib.py", "src/old.py"), ("worktree", "D", "gone.txt", None), ("deleted", "D", "gone.txt", None)}
    assert [(r.scope, r.error) for r in repositories.read_changes(repos, "no-such").collect()] == [(None, "CalledProcessError")]
    paths = snapshots.stored(repositories.changed_paths(changes), f"file://{tmp_path}/paths")
    assert {r.path for r in paths.collect()} == {"lib.py", "src/old.py", "gone.txt"}

    files = snapshots.stored(repositories.read_files(repos), f"file://{tmp_path}/files")
    config = BASE | {"markdown": {"include": ["docs/*.md"]}, "readme_contracts": {"required_paths": ["docs", "nowhere"], "commands": [{"text": "make"}, {"text": "make test"}]}, "impact_map": [{"change": ["src/**"], "requires_any": ["docs/**"]}], "generated_artifacts": [{"path": "none.txt", "sources": ["src/**"], "sha256": SHA}]}
    of = lambda c, **more: consistency.check(repos, spark.createDataFrame([("r", json.dumps(c))], "repo_id string, content string"), files, ID, **more).first()
    found = of(config, changes=paths)
    assert found.status == "shadow_findings"
    assert [x.rsplit("-", 1)[0] if "command" in x else x for x in found.findings] == ["generated_artifact_missing:none.txt", "generated_artifact_update_missing:none.txt", "markdown_link_missing:docs/a.md:../src", "markdown_link_outside_repo:docs/a.md:../../x", "readme_command_missing:command-2", "readme_path_missing:nowhere", "related_docs_update_missing:impact-1"]
    assert (of(config).status, of(config).findings) == ("tool_error", ["change_sensitive_scope_unavailable"])
    assert of(config | {"mode": "enforce"}, changes=paths).status == "fail"
    assert of(config, changes=paths, require_mode="enforce").status == "tool_error"
    accepted = of(config | {"mode": "ratchet", "ratchet": {"baseline": [*found.findings, "old"]}}, changes=paths)
    assert (accepted.status, accepted.new, accepted.resolved) == ("fail", [], ["old"])
    unreadable = of(BASE | {"markdown": {"include": ["b*.md"]}})
    assert unreadable.status == "tool_error"
    assert "markdown_unreadable:bytes.md" in unreadable.findings
    assert of(BASE | {"mode": 1}).findings == ["invalid_consistency_config"]
    nothing = consistency.check(repos, spark.createDataFrame([], "repo_id string, content string"), files, ID)
    assert nothing.first().status == "not_configured"
    nothing = consistency.check(repos, spark.createDataFrame([], "repo_id string, content string"), files, ID, require_config=True)
    assert nothing.first().findings == ["required_consistency_config_missing"]
