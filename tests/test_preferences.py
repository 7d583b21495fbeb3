import json

from pyspark.sql import functions as F

from gatehouse.operators import dialogue, preferences



def day():
    return F.expr("date '2026-03-01'")

DOCS = [
    ("none", None),
    ("bytes", b"\xff\xfe"),
    ("cut", b'{"dismissals": {'),
    ("list", b"[1]"),
    ("null", b"null"),
    ("no map", b'{"dismissals": [1]}'),
    (
        "some",
        json.dumps({"dismissals": {"a": {"mode": "forever"}, "b": {"mode": "snooze", "until": "2026-03-01T10:00"}, "c": {"mode": "snooze", "until": "2026-02-28"}, "d": {"mode": "snooze", "until": "soon"}, "e": "forever", "f": {"mode": "snooze"}, "g": {"mode": 1}}}).encode(),
    ),
]


def test_documents_are_read_leniently(spark):
    prefs = preferences.loaded(spark.createDataFrame(DOCS, "repo_id string, content binary"))
    assert {r.repo_id: r.load_error for r in prefs.collect()} == {"none": None, "bytes": "preferences_unreadable", "cut": "preferences_unreadable", "list": "preferences_invalid", "null": "preferences_invalid", "no map": None, "some": None}
    assert sorted((r.repo_id, r.id) for r in preferences.active(prefs, day()).collect()) == [("some", "a"), ("some", "b")]
    assert preferences.loaded(spark.createDataFrame([], "repo_id string, content binary")).count() == 0


def test_answers_are_written_and_read_again(spark):
    prefs = preferences.loaded(spark.createDataFrame(DOCS, "repo_id string, content binary"))
    answers = spark.createDataFrame([("some", "c", "90d", "later"), ("some", "x", "forever", None), ("some", "x", "7d", "short"), ("some", "a", "never", ""), ("none", "y", "snooze_14d", ""), ("none", "z", "8d", "")], "repo_id string, id string, mode string, reason string")
    out = {r.repo_id: r for r in preferences.answered(prefs, answers, day(), "prefs/v1", "a note").collect()}
    assert out["some"].refused == ["a"] and out["none"].refused == ["z"] and len(out) == 2
    document = json.loads(out["some"].content)
    assert document["schema"] == "prefs/v1" and document["notes"] == "a note"
    assert document["dismissals"]["c"] == {"dismissed_at": "2026-03-01", "reason": "later", "mode": "snooze", "until": "2026-05-30"}
    assert document["dismissals"]["x"]["mode"] == "forever" and document["dismissals"]["a"] == {"mode": "forever"} and document["dismissals"]["e"] == "forever"
    again = preferences.loaded(spark.createDataFrame([(k, r.content) for k, r in out.items()], "repo_id string, content string"))
    assert sorted((r.repo_id, r.id) for r in preferences.active(again, F.expr("date '2026-03-15'")).collect()) == [("none", "y"), ("some", "a"), ("some", "c"), ("some", "x")]


def test_modes_and_options(spark):
    answers = spark.createDataFrame([(a,) for a in ("dismiss_7d", "dismiss_forever", "yes", None)], "a string")
    assert [r.m for r in answers.select(preferences.answer_mode(F.col("a")).alias("m")).collect()] == ["7d", "forever", None, None]
    modes = spark.createDataFrame([(m,) for m in ("7d", "8d", "snooze_8d", "snooze_8", "snooze_", "snooze_x", "forever", None)], "m string")
    got = [r.d and (r.d.mode, r.d.until and str(r.d.until)) for r in modes.select(dialogue.record_dismissal(F.col("m"), day()).alias("d")).collect()]
    assert got == [("snooze", "2026-03-08"), None, ("snooze", "2026-03-09"), ("snooze", "2026-03-09"), None, None, ("forever", None), None]
    props = spark.createDataFrame([("security_hold", "required"), ("github_baseline", "recommended"), ("external_evidence", "required"), ("scaffold", "recommended"), ("scaffold", "required")], "kind string, severity string")
    rows = preferences.enriched(props).collect()
    assert [[o.id for o in r.options] for r in rows] == [[], ["dismiss_30d", "dismiss_90d"], ["dismiss_30d"], ["dismiss_30d", "dismiss_90d", "dismiss_forever"], []]
    assert [r.dismissible for r in rows] == [False, True, True, True, False]


def test_a_guide_by_its_marker(spark):
    marker = "# Guide\n<!-- guide-age\n last_reviewed: {} max_age_days: {}\n-->\n"
    texts = [None, b"\xff", b"# Guide", marker.format("2026-02-30", 5).encode(), marker.format("2026-02-01", 28).encode(), marker.format("2026-02-01", 27).encode(), marker.replace("guide-age", "other").format("2026-02-01", 9).encode()]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, content binary")
    rows = [r.b for r in docs.select("k", preferences.baseline_document(F.col("content"), "guide-age", day()).alias("b")).orderBy("k").collect()]
    assert [r.status for r in rows] == ["unknown"] * 4 + ["fresh", "stale", "unknown"]
    assert [r.reason for r in rows] == ["baseline_document_missing", "baseline_unreadable", "baseline_marker_missing", "baseline_marker_missing", None, None, "baseline_marker_missing"]
    assert (rows[5].age_days, rows[5].max_age_days, str(rows[5].last_reviewed)) == (28, 27, "2026-02-01")


def test_packet(spark):
    scans = spark.createDataFrame([("r", "pass", "h1", "origin/main", "b1"), ("s", None, None, None, None)], "repo_id string, status string, head string, base_ref string, base_oid string")
    checks = spark.createDataFrame([("r", "origin", "pass"), ("r", "ci_runtime_result", "unknown")], "repo_id string, name string, status string")
    props = dialogue.conversation(scans, checks, "merge")
    gone = spark.createDataFrame([("r", "confirm_ci_runtime", "forever", None), ("s", "run_scan_first", "forever", None)], "repo_id string, id string, mode string, until date")
    rows = {r.repo_id: r for r in dialogue.packet(scans, props, gone, "merge", day()).collect()}
    assert (rows["r"].status, rows["r"].visible, rows["r"].suppressed) == ("ready_after_confirmation", [], ["confirm_ci_runtime"])
    assert (rows["s"].status, rows["s"].visible, rows["s"].suppressed) == ("needs_human_input", ["run_scan_first"], [])
    last = json.loads(rows["r"].packet)["confirmations"]
    assert last == [{"id": "confirm_merge", "kind": "intent_confirmation", "severity": "required", "blocks_intent": True, "action": "merge", "options": ["approve", "cancel"], "default": "cancel", "binding": {"base_ref": "origin/main", "base_oid": "b1", "head_oid": "h1"}}]
    assert "binding" not in json.loads(rows["s"].packet)["confirmations"][0]
    assert "binding" not in json.loads(dialogue.packet(scans, props, gone, "publish", day()).where("repo_id = 'r'").first().packet)["confirmations"][0]
