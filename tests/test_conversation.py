from pyspark.sql import functions as F

from gatehouse.operators import consistency, dialogue


def ids(df):
    return sorted(r.id for r in df.collect())


def test_sources_that_changed_without_their_artifact(spark):
    good = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    rows = [("r", "a.txt", good, ["src/**"]), ("r", "b.txt", "0" * 64, ["src/*.py"]), ("r", "c.txt", good, ["lib/**"]), ("r", "d.txt", good, []), ("r", "e.txt", good, ["src/**"]), ("q", "a.txt", good, ["src/**"]), ("r", "gone", good, ["src/**"])]
    artifacts = spark.createDataFrame(rows, "repo_id string, path string, sha256 string, sources array<string>")
    files = spark.createDataFrame([(r[0], r[1], "abc") for r in rows[:-1]], "repo_id string, path string, content string")
    changes = spark.createDataFrame([("r", "src/x.py"), ("r", "e.txt"), ("q", "lib/x.py")], "repo_id string, path string")
    got = sorted(tuple(r) for r in consistency.artifact_findings(artifacts, files, changes).collect())
    assert got == [("q", "a.txt", "current"), ("r", "a.txt", "update_missing"), ("r", "b.txt", "drift"), ("r", "b.txt", "update_missing"), ("r", "c.txt", "current"), ("r", "d.txt", "current"), ("r", "e.txt", "current"), ("r", "gone", "missing"), ("r", "gone", "update_missing")]


def test_audience_scans_and_new_repositories(spark):
    scans = spark.createDataFrame([("r", "pass")], "repo_id string, status string")
    checks = spark.createDataFrame([("r", "origin", "pass")], "repo_id string, name string, status string")
    assert ids(dialogue.conversation(scans, checks, "publish")) == ["choose_audience"]
    assert dialogue.dialogue_status(scans, dialogue.conversation(scans, checks, "publish")).first().status == "needs_human_input"
    assert ids(dialogue.conversation(scans, checks, "publish", "team")) == []
    assert dialogue.dialogue_status(scans, dialogue.conversation(scans, checks, "publish", "team")).first().status == "ready_after_confirmation"
    assert ids(dialogue.conversation(scans, checks.limit(0), "push")) == ["configure_origin"]
    assert ids(dialogue.conversation(scans, checks, "push", baseline="stale")) == []
    assert ids(dialogue.conversation(scans, checks, "merge", baseline="stale")) == ["refresh_github_settings_baseline"]
    new = ["confirm_repo_identity", "confirm_visibility_private_default", "seed_required_documents"]
    assert ids(dialogue.conversation(scans, checks, "create_repo")) == new
    none = scans.withColumn("status", F.lit(None).cast("string"))
    assert ids(dialogue.conversation(none, checks, "create_repo")) == new
    assert ids(dialogue.conversation(none, checks, "push")) == ["run_scan_first"]
    broken = scans.withColumn("status", F.lit("tool_error"))
    assert ids(dialogue.conversation(broken, checks, "create_repo")) == ["fix_tool_error"]
    assert [(r.id, r.action) for r in dialogue.confirmations(scans, "publish").collect()] == [("confirm_publish", "expand_audience")]


def test_documents_and_identity(spark):
    scans = spark.createDataFrame([("r", "blocked")], "repo_id string, status string")
    rows = [("r", "required_documents", "fail", ["README.md"], ["PREFLIGHT.md"], None), ("r", "commit_identity", "pass", None, None, "not_configured"), ("r", "origin", "fail", None, None, None)]
    checks = spark.createDataFrame(rows, "repo_id string, name string, status string, missing array<string>, invalid array<string>, policy string")
    got = dialogue.conversation(scans, checks, "push")
    assert ids(got) == ["configure_expected_identity", "configure_origin", "create_missing_readme_md", "fix_invalid_preflight_md"]
    assert {r.id for r in got.collect() if not r.blocks_intent} == {"configure_expected_identity"}
    assert "configure_expected_identity" not in ids(dialogue.conversation(scans, checks, "merge"))


def test_one_call_serves_repositories_that_differ(spark):
    scans = spark.createDataFrame([("a", "pass", None, "fresh"), ("b", "pass", "team", "stale"), ("c", "pass", "local", None)], "repo_id string, status string, audience string, baseline string")
    checks = spark.createDataFrame([(r, "origin", "pass") for r in "abc"], "repo_id string, name string, status string")
    got = dialogue.conversation(scans, checks, "publish")
    assert {(r.repo_id, r.id) for r in got.collect()} == {("a", "choose_audience"), ("b", "refresh_github_settings_baseline"), ("c", "choose_audience")}
    offered = {r.repo_id: r for r in dialogue.offers(got, "publish").collect()}
    assert offered["a"].options == ["public", "team", "client", "collaborator", "stop"] and not offered["a"].dismissible
    assert offered["b"].options == ["review_now", "ack_current", "later", "dismiss_30d", "dismiss_90d"] and offered["b"].default == "later" and not offered["b"].auto_apply_safe


def test_every_proposal_has_an_offer(spark):
    for name in [r[2] for r in dialogue.RULES] + [r[0] for r in dialogue.CREATE_REPO] + ["fix_tool_error", "run_scan_first", "choose_audience", "configure_expected_identity", "refresh_github_settings_baseline"]:
        options, default, action = dialogue.OFFERS[name]
        assert default in options and action
    props = spark.createDataFrame([("r", "create_missing_license", "missing_artifact", "required"), ("r", "configure_expected_identity", "optional_policy", "recommended"), ("r", "other", "other", "required")], "repo_id string, id string, kind string, severity string")
    rows = {r.id: r for r in dialogue.offers(props, "release").collect()}
    assert rows["create_missing_license"].default == "yes" and rows["configure_expected_identity"].default == "yes"
    assert {r.default for r in dialogue.offers(props, "push").where("kind = 'optional_policy'").collect()} == {"no"}
    assert rows["other"].options == [] and rows["other"].default is None


def test_approvals_expire(spark):
    now = spark.createDataFrame([(r, "pass", "h1", "origin/main", "b1", None, None) for r in "abcde"], "repo_id string, status string, head string, base_ref string, base_oid string, consistency_base_ref string, consistency_base_oid string")
    asked = dialogue.confirmations(now, "merge")
    assert asked.where("consistency_binding is not null").count() == 0 and asked.where("binding.head_oid = 'h1'").count() == 5
    kind = "struct<base_ref:string,base_oid:string,head_oid:string>"
    bound = lambda base, head: ("origin/main", base, head)
    rows = [("a", bound("b1", "h1")), ("b", bound("b1", "h0")), ("c", bound("b0", "h0")), ("d", None), ("b", bound("b0", "h0"))]
    given = spark.createDataFrame([(r, "confirm_merge", b, None) for r, b in rows], f"repo_id string, id string, binding {kind}, consistency_binding {kind}")
    got = {r.repo_id: (r.due, r.reasons) for r in dialogue.approvals_due(asked, given).collect()}
    assert got == {"a": (False, []), "b": (True, ["head_moved"]), "c": (True, ["head_moved", "base_moved"]), "d": (True, ["head_moved", "base_moved"]), "e": (True, ["never_approved"])}
    published = dialogue.confirmations(now.withColumns({"consistency_base_ref": F.lit("origin/main"), "consistency_base_oid": F.lit("c1")}), "publish").first()
    assert published.binding is None and tuple(published.consistency_binding) == ("origin/main", "c1", "h1")
