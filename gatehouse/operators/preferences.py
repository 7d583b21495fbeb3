"""Preference documents: what a repository's people asked not to be asked again, and the age of a guide."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.patterns import SPACE
from gatehouse.functions.text import bound
from gatehouse.operators.dialogue import DISMISSALS, baseline_status, is_active, max_dismissal, record_dismissal

#: Answers that dismiss a question, and their modes (fixed values).
ANSWERS = {"dismiss_30d": "30d", "dismiss_90d": "90d", "dismiss_forever": "forever", "dismiss_7d": "7d"}
_ENTRIES = "map<string,variant>"


def iso_date(value: Column) -> Column:
    """The date that a text begins with, as ``YYYY-MM-DD``; null if it doesn't."""
    head = F.substring(value, 1, 10)
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), head.try_cast("date"))


def loaded(documents: DataFrame) -> DataFrame:
    """``repo_id, load_error, entries`` of ``documents(repo_id, content)``, bytes or texts; entries are variants by proposal id.

    A document that is no JSON is preferences_unreadable, one that is no object preferences_invalid; both have no entries, as has one
    without a ``dismissals`` object and a null content (no document, no error). An object that names a key twice counts as unreadable.
    """
    text = F.col("content").cast("string")

    def read(v: Column) -> Column:
        is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
        error = F.when(v.isNull(), "preferences_unreadable").when(~is_object, "preferences_invalid")
        return F.struct(error.alias("error"), F.when(is_object, F.try_variant_get(v, "$.dismissals", _ENTRIES)).alias("entries"))

    parsed = bound(text, lambda t: bound(F.try_parse_json(F.when(F.is_valid_utf8(t), t)), read))
    rows = documents.select("repo_id", F.when(F.col("content").isNotNull(), parsed).alias("r"))
    return rows.select("repo_id", F.col("r.error").alias("load_error"), F.coalesce("r.entries", F.create_map().cast(_ENTRIES)).alias("entries"))


def dismissals(prefs: DataFrame) -> DataFrame:
    """``repo_id, id, mode, until`` of the entries of ``loaded``; an entry that is no object has no mode."""
    rows = prefs.select("repo_id", F.explode("entries").alias("id", "entry"))
    return rows.select("repo_id", "id", F.try_variant_get("entry", "$.mode", "string").alias("mode"), iso_date(F.try_variant_get("entry", "$.until", "string")).alias("until"))


def active(prefs: DataFrame, as_of: Column) -> DataFrame:
    """``repo_id, id`` of dismissals that hold at ``as_of``."""
    return dismissals(prefs).where(is_active(F.col("mode"), F.col("until"), as_of)).select("repo_id", "id")


def answer_mode(answer: Column) -> Column:
    """The mode that an answer asks for, null if it dismisses nothing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ANSWERS.items() for x in pair]), answer)


def dismissal_options(kind: Column, severity: Column, labels: Mapping[str, str] | None = None) -> Column:
    """Array of ``(id, label)`` by which a proposal can be dismissed, empty where it can't. Labels are the caller's words; an answer without one has its id."""
    most = max_dismissal(kind, severity)
    option = lambda i: F.struct(F.lit(i).alias("id"), F.lit((labels or {}).get(i, i)).alias("label"))
    return F.array_compact(F.array(*[F.when(most.isin(*longest), option(i)) for i, longest in DISMISSALS.items()]))


def enriched(props: DataFrame, labels: Mapping[str, str] | None = None) -> DataFrame:
    """``props`` with ``dismissible``, ``max_dismissal`` and ``options``."""
    most = max_dismissal(F.col("kind"), F.col("severity"))
    return props.withColumns({"dismissible": most.isNotNull(), "max_dismissal": most, "options": dismissal_options(F.col("kind"), F.col("severity"), labels)})


def answered(prefs: DataFrame, answers: DataFrame, as_of: Column, schema_id: str, notes: str | None = None) -> DataFrame:
    """``repo_id, content, refused``: the preference document to write after ``answers(repo_id, id, mode, reason)``.

    An answer takes the place of an earlier entry of its id; of several answers for an id the one that holds longest counts. Answers of an
    unknown mode are refused: their ids are listed and their entries stay as they were. Repositories without answers are left out.
    """
    given = answers.select("repo_id", "id", record_dismissal(F.col("mode"), as_of).alias("d"), F.coalesce("reason", F.lit("")).alias("reason"))
    entry = F.parse_json(F.to_json(F.struct(F.date_format(as_of, "yyyy-MM-dd").alias("dismissed_at"), "reason", F.col("d.mode").alias("mode"), F.date_format("d.until", "yyyy-MM-dd").alias("until"))))
    hold = F.struct(F.coalesce("d.until", F.lit("9999-12-31").cast("date")), "reason")
    best = given.groupBy("repo_id", "id").agg(F.max_by(F.when(F.col("d").isNotNull(), F.struct("d", "reason")), F.when(F.col("d").isNotNull(), hold)).alias("best"))
    best = best.select("repo_id", "id", "best.*").withColumn("entry", F.when(F.col("d").isNotNull(), entry))
    fresh = best.groupBy("repo_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("id", "entry")))).alias("fresh"),
        F.array_sort(F.collect_list(F.when(F.col("d").isNull(), F.col("id")))).alias("refused"),
    )
    both = fresh.join(prefs.select("repo_id", "entries"), "repo_id", "left")
    kept = F.map_filter(F.coalesce("entries", F.create_map().cast(_ENTRIES)), lambda k, _: ~F.map_contains_key("fresh", k))
    document = F.struct(F.lit(schema_id).alias("schema"), F.map_concat(kept, "fresh").alias("dismissals"), *([F.lit(notes).alias("notes")] if notes else []))
    return both.select("repo_id", F.to_json(document).alias("content"), "refused")


def baseline_document(content: Column, tag: str, as_of: Column) -> Column:
    """Struct ``(status, reason, last_reviewed, max_age_days, age_days)`` of a guide with a marker comment that begins with ``tag``.

    No document, bytes that aren't UTF-8 and a document without the marker or with no real date are unknown, each with its reason.
    """
    text = content.cast("string")
    marker = rf"<!--[{SPACE}]*{tag}[{SPACE}]+last_reviewed:[{SPACE}]*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})[{SPACE}]+max_age_days:[{SPACE}]*([0-9]+)[{SPACE}]*-->"

    def dated(m: Column) -> Column:
        return F.struct(m["absent"].alias("absent"), m["valid"].alias("valid"), iso_date(F.regexp_extract(m["found"], marker, 1)).alias("last"), F.regexp_extract(m["found"], marker, 2).try_cast("long").alias("most"))

    def judged(m: Column) -> Column:
        reason = F.when(m["absent"], "baseline_document_missing").when(~m["valid"], "baseline_unreadable").when(m["last"].isNull() | m["most"].isNull(), "baseline_marker_missing")
        known = lambda c: F.when(reason.isNull(), c)
        status = F.when(reason.isNotNull(), "unknown").otherwise(baseline_status(m["last"], m["most"], as_of))
        return F.struct(status.alias("status"), reason.alias("reason"), known(m["last"]).alias("last_reviewed"), known(m["most"]).alias("max_age_days"), known(F.datediff(as_of, m["last"])).alias("age_days"))

    # each step's values are bound, so that the text is searched once
    found = bound(text, lambda t: F.struct(t.isNull().alias("absent"), F.is_valid_utf8(t).alias("valid"), F.regexp_substr(t, F.lit(marker)).alias("found")))
    return bound(bound(found, dated), judged)
