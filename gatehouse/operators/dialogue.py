"""Proposals, dismissals and the status of a dialogue. Dates are compared with an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of proposals that can't be dismissed (fixed values).
NEVER_DISMISSED = ("security_hold", "privacy_hold", "tool_error", "missing_artifact", "invalid_artifact", "worktree_state", "identity_hold", "missing_remote", "missing_scan", "intent_confirmation", "audience", "github_settings")
HOLDS = ("security_hold", "privacy_hold", "tool_error")
#: Check, status that raises it, proposal, kind, severity, intents (none: all) (fixed values).
RULES = (
    ("clean_worktree", "fail", "handle_dirty_worktree", "worktree_state", "required", ("push", "open_pr", "merge", "publish", "release")),
    ("secret_scan", "fail", "resolve_secret_findings", "security_hold", "required", ()),
    ("personal_path_scan", "fail", "resolve_personal_paths", "privacy_hold", "required", ()),
    ("commit_identity", "fail", "resolve_identity_mismatch", "identity_hold", "required", ()),
    ("origin", "unknown", "configure_origin", "missing_remote", "required", ("push", "open_pr", "merge", "publish", "release")),
    ("dependency_vulnerability_audit", "unknown", "run_dependency_audit", "external_evidence", "recommended", ("publish", "release")),
    ("ci_runtime_result", "unknown", "confirm_ci_runtime", "external_evidence", "required", ("merge", "publish", "release")),
    ("ci_runtime_result", "unknown", "confirm_ci_runtime", "external_evidence", "recommended", ("open_pr",)),
    ("readme_release_design", "fail", "fix_readme_release_design", "readme_design", "required", ()),
)


OUTWARD = ("push", "open_pr", "merge", "publish", "release")
#: Proposals for a new repository: id, kind, severity (fixed values).
CREATE_REPO = (("confirm_visibility_private_default", "github_settings", "required"), ("confirm_repo_identity", "github_settings", "required"), ("seed_required_documents", "scaffold", "recommended"))
_PROPOSAL = "array<struct<id:string,kind:string,severity:string>>"
_YES_NO = ("yes", "no")
#: What may be answered, what is proposed by default, and the action meant, by proposal or, for those about one document, by kind (fixed values).
OFFERS = {
    "fix_tool_error": (_YES_NO, "yes", "fix_repository_access_then_rerun_preflight"),
    "missing_artifact": (_YES_NO, "yes", "create_from_template_or_scaffold"),
    "invalid_artifact": (_YES_NO, "yes", "repair_review_record"),
    "handle_dirty_worktree": (("commit", "stop"), "commit", "commit_relevant_changes_then_rerun"),
    "resolve_secret_findings": (("fix", "stop"), "fix", "remove_or_rotate_secrets_then_rerun"),
    "resolve_personal_paths": (("fix", "stop"), "fix", "redact_personal_paths_then_rerun"),
    "resolve_identity_mismatch": (("review_policy", "stop"), "review_policy", "align_identity_without_silent_history_rewrite"),
    "configure_expected_identity": (_YES_NO, "no", "set_expected_identity_and_rescan"),
    "configure_origin": (_YES_NO, "yes", "add_private_origin_remote"),
    "run_dependency_audit": (("done", "later"), "later", "record_external_dependency_audit_evidence"),
    "confirm_ci_runtime": (_YES_NO, "yes", "fetch_current_remote_ci_evidence"),
    "fix_readme_release_design": (_YES_NO, "yes", "improve_readme_then_rerun_release_gate"),
    "choose_audience": (("public", "team", "client", "collaborator", "stop"), "stop", "set_audience_before_expansion"),
    "confirm_visibility_private_default": (("private", "stop"), "private", "visibility_private"),
    "confirm_repo_identity": (_YES_NO, "yes", "confirm_owner_name_and_account"),
    "seed_required_documents": (_YES_NO, "yes", "seed_required_documents_from_templates"),
    "run_scan_first": (_YES_NO, "yes", "run_readiness_scan"),
    "refresh_github_settings_baseline": (("review_now", "ack_current", "later"), "later", "review_and_update_github_settings_guide"),
}
#: Answers that dismiss a proposal, and the longest dismissals that allow each (fixed values).
DISMISSALS = {"dismiss_30d": ("30d", "90d", "forever"), "dismiss_90d": ("90d", "forever"), "dismiss_forever": ("forever",)}
#: Intents whose scan may be of changes since a base, and those whose consistency check may have one of its own (fixed values).
BASED, CONSISTENCY_BASED = ("push", "open_pr", "merge"), ("publish", "release")


def conversation(scans: DataFrame, checks: DataFrame, intent: str, audience: str = "unspecified", baseline: str | None = None) -> DataFrame:
    """``repo_id, id, kind, severity, blocks_intent`` of all proposals for ``scans(repo_id, status)``; a null status is a scan not made.

    ``checks(repo_id, name, status)`` may have ``missing`` and ``invalid`` (arrays of documents) and ``policy``. A broken scan calls for its repair
    alone; a check without a row is as good as none, so a repository without an origin row has no origin. ``baseline`` is the guide's status. ``scans`` may have
    ``audience`` and ``baseline`` of its own for each repository, which then hold instead; a null audience is unspecified.
    """
    own = lambda c, given: F.col(c) if c in scans.columns else F.lit(given)
    has = lambda c, t: F.col(c) if c in checks.columns else F.lit(None).cast(t)
    of = lambda name, c: F.when(F.col("name") == name, c)
    seen = checks.groupBy("repo_id").agg(
        F.collect_set(F.concat_ws(":", "name", "status")).alias("states"),
        *[F.array_distinct(F.flatten(F.collect_list(of("required_documents", has(c, "array<string>"))))).alias(c) for c in ("missing", "invalid")],
        F.bool_or(F.coalesce(of("commit_identity", has("policy", "string")) == "not_configured", F.lit(False))).alias("open_policy"),
    )
    one = lambda i, kind, severity: F.struct((F.lit(i) if isinstance(i, str) else i).alias("id"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    state = lambda c, s: F.coalesce(F.array_contains("states", f"{c}:{s}"), F.lit(False))
    named = lambda c, prefix, kind: F.coalesce(F.transform(c, lambda d: one(F.concat(F.lit(prefix), F.lower(F.replace(d, F.lit("."), F.lit("_")))), kind, "required")), F.array().cast(_PROPOSAL))
    found = [F.when(state(c, s), one(i, k, v)) for c, s, i, k, v, intents in RULES if c != "origin" and (not intents or intent in intents)]
    if intent in OUTWARD:
        found.append(F.when(~state("origin", "pass"), one("configure_origin", "missing_remote", "required")))
    if intent in OUTWARD and intent != "merge":
        found.append(F.when(F.coalesce("open_policy", F.lit(False)) & ~state("commit_identity", "fail"), one("configure_expected_identity", "optional_policy", "recommended")))
    if intent == "publish":
        found.append(F.when(F.coalesce("audience", F.lit("unspecified")).isin("unspecified", "local"), one("choose_audience", "audience", "required")))
    create = [one(*r) for r in CREATE_REPO] if intent == "create_repo" else []
    scanned = F.concat(F.array_compact(F.array(*found, *create)), named("missing", "create_missing_", "missing_artifact"), named("invalid", "fix_invalid_", "invalid_artifact"))
    unscanned = F.array(*create) if create else F.array(one("run_scan_first", "missing_scan", "required"))
    wanted = F.when(F.col("status").isNull(), unscanned).when(F.col("status") == "tool_error", F.array(one("fix_tool_error", "tool_error", "required"))).otherwise(scanned)
    if intent in ("create_repo", "publish", "release", "open_pr", "merge"):
        wanted = F.when(F.col("baseline") == "stale", F.concat(wanted, F.array(one("refresh_github_settings_baseline", "github_baseline", "recommended")))).otherwise(wanted)
    rows = scans.select("repo_id", "status", own("audience", audience).alias("audience"), own("baseline", baseline).cast("string").alias("baseline")).join(seen, "repo_id", "left")
    return rows.select("repo_id", F.explode(wanted).alias("p")).select("repo_id", "p.*", (F.col("p.severity") == "required").alias("blocks_intent"))


def offers(props: DataFrame, intent: str) -> DataFrame:
    """``props(id, kind, severity)`` with ``options`` (ids of answers, those that dismiss last), ``default``, ``action``, ``auto_apply_safe`` (never), ``dismissible`` and ``max_dismissal``.

    A proposal that ``OFFERS`` doesn't know has no options but dismissals, and no default.
    """
    known = F.create_map(*[x for k, (o, d, a) in OFFERS.items() for x in (F.lit(k), F.struct(F.array(*map(F.lit, o)).alias("options"), F.lit("yes" if k == "configure_expected_identity" and intent in ("publish", "release") else d).alias("default"), F.lit(a).alias("action")))])
    most = max_dismissal(F.col("kind"), F.col("severity"))
    away = F.array_compact(F.array(*[F.when(most.isin(*longest), F.lit(i)) for i, longest in DISMISSALS.items()]))
    rows = props.withColumn("offer", F.coalesce(F.try_element_at(known, F.col("id")), F.try_element_at(known, F.col("kind"))))
    return rows.withColumns({"options": F.array_distinct(F.concat(F.coalesce("offer.options", F.array().cast("array<string>")), away)), "default": F.col("offer.default"), "action": F.col("offer.action"), "auto_apply_safe": F.lit(False), "dismissible": most.isNotNull(), "max_dismissal": most}).drop("offer")


def confirmations(scans: DataFrame, intent: str) -> DataFrame:
    """``repo_id, id, kind, severity, blocks_intent, action, options, default, binding, consistency_binding``: the last question before an intent, one a repository.

    Where ``scans`` has ``head``, ``base_ref`` and ``base_oid`` and the intent is none of publishing or creating, the approval is bound to
    them, as to ``consistency_base_ref`` and ``consistency_base_oid`` for any intent: it has to be asked anew once one of them or the head moved.
    """
    kind = "struct<base_ref:string,base_oid:string,head_oid:string>"

    def bound(ref: str, oid: str, wanted: bool = True) -> Column:
        if not wanted or not {"head", ref, oid} <= set(scans.columns):
            return F.lit(None).cast(kind)
        return F.when(F.col(ref).isNotNull() & F.col(oid).isNotNull(), F.struct(F.col(ref).alias("base_ref"), F.col(oid).alias("base_oid"), F.col("head").alias("head_oid")))

    action = {"publish": "expand_audience", "create_repo": "create_private_repository"}.get(intent, intent)
    one = lambda value, name: F.lit(value).alias(name)
    return scans.select(
        "repo_id", one(f"confirm_{intent}", "id"), one("intent_confirmation", "kind"), one("required", "severity"), one(True, "blocks_intent"), one(action, "action"),
        F.array(F.lit("approve"), F.lit("cancel")).alias("options"), one("cancel", "default"),
        bound("base_ref", "base_oid", intent not in ("publish", "create_repo")).alias("binding"), bound("consistency_base_ref", "consistency_base_oid").alias("consistency_binding"),
    )


def approvals_due(asked: DataFrame, approvals: DataFrame) -> DataFrame:
    """``repo_id, id, due, reasons`` of ``confirmations``' rows against ``approvals(repo_id, id, binding, consistency_binding)``, given earlier.

    An approval holds while its bindings are those of now; what moved (head, base, consistency_base) is listed, a confirmation never approved is 'never_approved'.
    Of several approvals for a confirmation one that holds is enough; otherwise the reasons are those of the one with the fewest. An approval bound to
    nothing holds only where nothing is to be bound.
    """
    given = approvals.select("repo_id", "id", F.struct(F.col("binding").alias("b"), F.col("consistency_binding").alias("c")).alias("given"))
    rows = asked.select("repo_id", "id", F.col("binding").alias("b"), F.col("consistency_binding").alias("c")).join(given, ["repo_id", "id"], "left")
    same = lambda side, part: F.col(f"{side}.{part}").eqNullSafe(F.col(f"given.{side}.{part}"))
    moved = {
        "head_moved": (F.col("b").isNotNull() & ~same("b", "head_oid")) | (F.col("c").isNotNull() & ~same("c", "head_oid")),
        "base_moved": ~same("b", "base_ref") | ~same("b", "base_oid"),
        "consistency_base_moved": ~same("c", "base_ref") | ~same("c", "base_oid"),
    }
    reasons = F.when(F.col("given").isNull(), F.array(F.lit("never_approved"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in moved.items()])))
    best = rows.select("repo_id", "id", reasons.alias("reasons")).groupBy("repo_id", "id").agg(F.min(F.struct(F.size("reasons").alias("n"), "reasons")).alias("r"))
    return best.select("repo_id", "id", (F.col("r.n") > 0).alias("due"), F.col("r.reasons").alias("reasons"))


def request_errors(requests: DataFrame) -> DataFrame:
    """``request_id, error`` of ``requests(request_id, repo, intent, base_ref, consistency_base_ref, release)``: the first rule that a request breaks, null if none.

    Nulls and empty texts are options not given; without an intent the request is a bare scan.
    """
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    intent = F.when(given("intent"), F.col("intent"))
    known = F.coalesce(intent.isin(*OUTWARD, "create_repo"), F.lit(True))
    own_base = F.coalesce(intent.isin(*CONSISTENCY_BASED), F.coalesce("release", F.lit(False)))
    error = (
        F.when(~known, "unknown_intent")
        .when(given("base_ref") & given("consistency_base_ref"), "base_refs_are_exclusive")
        .when(given("base_ref") & ~F.coalesce(intent.isin(*BASED), F.lit(False)), "base_ref_requires_push_open_pr_or_merge")
        .when(given("consistency_base_ref") & ~own_base, "consistency_base_ref_requires_publish_or_release")
        .when(~given("repo") & ~F.coalesce(intent == "create_repo", F.lit(False)), "repo_required")
    )
    return requests.select("request_id", error.alias("error"))


def proposals(checks: DataFrame, intent: str) -> DataFrame:
    """``repo_id, id, kind, severity, blocks_intent`` that the checks call for; a short rule table of literals.

    Rules of one check's status only; ``conversation`` has all proposals.
    """
    rules = [r for r in RULES if not r[5] or intent in r[5]]
    wanted = F.array_compact(F.array(*[F.when((F.col("name") == c) & (F.col("status") == s), F.struct(F.lit(i).alias("id"), F.lit(k).alias("kind"), F.lit(v).alias("severity"))) for c, s, i, k, v, _ in rules]))
    return checks.select("repo_id", F.explode(wanted).alias("p")).select("repo_id", "p.*", (F.col("p.severity") == "required").alias("blocks_intent")).distinct()


def max_dismissal(kind: Column, severity: Column) -> Column:
    """forever, 90d, 30d or null (never), by the first rule that fits."""
    return (
        F.when(kind.isin(*NEVER_DISMISSED), F.lit(None).cast("string"))
        .when(kind == "github_baseline", "90d")
        .when(severity == "recommended", "forever")
        .when((kind == "external_evidence") & (severity == "required"), "30d")
        .when(severity == "required", F.lit(None).cast("string"))
        .otherwise("forever")
    )


def is_active(mode: Column, until: Column, as_of: Column) -> Column:
    """A snooze holds through its last day."""
    return F.coalesce((mode == "forever") | ((mode == "snooze") & (as_of <= until)), F.lit(False))


def record_dismissal(mode: Column, as_of: Column) -> Column:
    """Struct (mode, until) of an answer: 7d, 30d, 90d, ``snooze_Nd`` of any N, or forever; null for others, which aren't answers."""
    days = F.regexp_extract(mode, r"^(?:snooze_(?=[0-9]{1,6}d*\z)|(?=(?:7|30|90)d\z))([0-9]+)", 1)
    return F.when(mode == "forever", F.struct(F.lit("forever").alias("mode"), F.lit(None).cast("date").alias("until"))).when(days != "", F.struct(F.lit("snooze").alias("mode"), F.date_add(as_of, days.try_cast("int")).alias("until")))


def with_suppressed(props: DataFrame, dismissals: DataFrame, as_of: Column) -> DataFrame:
    """``props`` with ``suppressed``: an active dismissal of the same id, unless the proposal can't be dismissed."""
    active = dismissals.where(is_active(F.col("mode"), F.col("until"), as_of)).select("repo_id", "id").distinct().withColumn("dismissed", F.lit(True))
    joined = props.join(active, ["repo_id", "id"], "left")
    return joined.withColumn("suppressed", F.col("dismissed").isNotNull() & max_dismissal(F.col("kind"), F.col("severity")).isNotNull()).drop("dismissed")


def baseline_status(last: Column, max_age_days: Column, as_of: Column) -> Column:
    return F.when(last.isNull() | max_age_days.isNull(), "unknown").when(F.datediff(as_of, last) > max_age_days, "stale").otherwise("fresh")


def dialogue_status(scans: DataFrame, props: DataFrame) -> DataFrame:
    """``repo_id, status``: blocked by holds and broken scans, then what needs a human, then ready."""
    open_ = props.groupBy("repo_id").agg(F.bool_or(F.col("kind").isin(*HOLDS)).alias("hold"), F.bool_or(F.col("blocks_intent") & F.col("severity").isin("required", "error")).alias("needs"))
    joined = scans.select("repo_id", F.col("status").alias("scan")).join(open_, "repo_id", "left")
    status = F.when((F.col("scan") == "tool_error") | F.coalesce("hold", F.lit(False)), "blocked").when(F.coalesce("needs", F.lit(False)) | (F.col("scan") == "blocked"), "needs_human_input").otherwise("ready_after_confirmation")
    return joined.select("repo_id", status.alias("status"))


def packet(scans: DataFrame, props: DataFrame, dismissals: DataFrame, intent: str, as_of: Column, audience: str = "unspecified") -> DataFrame:
    """``repo_id, status, visible, suppressed, packet``: what is asked of a repository's people before an intent, as one JSON document each.

    ``scans(repo_id, status)``, with ``head``, ``base_ref``, ``base_oid``, ``consistency_base_ref`` and ``consistency_base_oid`` where approvals are bound, and with ``audience`` and
    ``baseline`` where repositories differ; ``props`` as of ``conversation``, of any further columns; ``dismissals(repo_id, id, mode, until)``. Every proposal comes with its
    options, those that dismiss it last, and a default. Dismissed proposals are listed but decide no status. Every scan has a row.
    """
    marked = offers(with_suppressed(props, dismissals, as_of), intent)
    item = F.struct("id", "kind", "severity", "blocks_intent", "options", "default", "action", "auto_apply_safe", "dismissible", "max_dismissal")
    lists = marked.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.when(~F.col("suppressed"), item))).alias("asked"), F.array_sort(F.collect_set(F.when(F.col("suppressed"), F.col("id")))).alias("suppressed"))
    last = confirmations(scans, intent).select("repo_id", F.array(F.struct("id", "kind", "severity", "blocks_intent", "action", "options", "default", "binding", "consistency_binding")).alias("confirmations"))
    status = dialogue_status(scans, marked.where("not suppressed"))
    facts = scans.select("repo_id", F.coalesce(F.col("audience") if "audience" in scans.columns else F.lit(None), F.lit(audience)).alias("audience"), (F.col("baseline") if "baseline" in scans.columns else F.lit(None).cast("string")).alias("guide"))
    rows = status.join(lists, "repo_id", "left").join(last, "repo_id", "left").join(facts, "repo_id", "left")
    none = F.expr("cast(array() as array<struct<id:string,kind:string,severity:string,blocks_intent:boolean,options:array<string>,default:string,action:string,auto_apply_safe:boolean,dismissible:boolean,max_dismissal:string>>)")
    rows = rows.select("repo_id", "status", "audience", "guide", F.coalesce("asked", none).alias("asked"), F.coalesce("suppressed", F.array().cast("array<string>")).alias("suppressed"), "confirmations")
    body = F.struct(F.lit(intent).alias("intent"), "status", F.lit("blocked_human_review_required").alias("publication_decision"), "audience", "guide", F.col("asked").alias("proposals"), F.col("suppressed").alias("suppressed_proposals"), "confirmations")
    return rows.select("repo_id", "status", F.transform("asked", lambda p: p["id"]).alias("visible"), "suppressed", F.to_json(body).alias("packet"))
