"""Personal data: four base kinds by pattern, and further identifiers by bootstrapped context.

All of it is Spark SQL expressions. Base entities are seeds. The letters-only words before an entity or an
identifier-shaped token are its lexical patterns. Patterns and instances form a bipartite graph, on which
scores are passed a fixed number of times: a pattern is as good as the mean of its instances (smoothed, so
that few instances don't suffice), an instance that is no seed is as good as its best pattern. Unseen tokens of
high-scored patterns are found identifiers, of kind ``id``. Patterns of the highest scores then discover what no shape suggests: any other token with a digit or
an underscore behind them, a short number, a user's name or a key of any length, in that place alone.

Matching is linear in a text's length: separators inside digit groups and dots inside domain names are
first replaced by a marker of the same length, so that no pattern repeats a group, and runs are
entered at their first character only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.common import rows_with, staged, text_of

MARK = ""  # one code point in the place of a separator
OTHER = "\ue001"  # in the place of a marker that the text already has; in no class
KINDS = ("email", "ip", "card", "phone")
_LOCAL = rf"A-Za-z0-9._%+\-{MARK}"
_HOST = r"A-Za-z0-9\-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++{MARK}[{_HOST}{MARK}]++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{MARK}]++"
PHONE = r"\+[0-9][ ().0-9\-]+[0-9]"
_TOKEN = r"A-Za-z0-9_.@+\-"
# six to 64 characters, four digits or more
TOKEN = rf"(?<![{_TOKEN}])(?=(?:[A-Za-z_.@+\-]*+[0-9]){{4}})[{_TOKEN}]{{6,64}}+(?![{_TOKEN}])"
# any other token of three characters or more with a digit or an underscore
WIDE = rf"(?<![{_TOKEN}])(?=[A-Za-z.@+\-]*+[0-9_])[{_TOKEN}]{{3,}}+"
SPANS = "array<struct<start:int,end:int,value:string>>"


def _hits(text: Column, pattern: str, when: Column) -> dict[str, Column]:
    """Matches and the text between them (both empty arrays where ``when`` fails)."""
    none = F.array().cast("array<string>")
    return {"hit": F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), "gap": F.when(when, F.split(text, pattern, -1)).otherwise(none)}


def _spans(prefix: str, chunk: int = 256) -> Column:
    """Code point spans of the matches, from the lengths of the gaps and the matches before them.

    Places are summed within chunks of matches and then over the chunks, since a fold that appends
    to one array copies it at every step.
    """
    part = lambda side: f"slice({prefix}_{side}, {chunk} * c + 1, least({chunk}, size({prefix}_hit) - {chunk} * c))"
    within = (
        f"aggregate(zip_with({part('hit')}, {part('gap')}, (h, g) -> named_struct('h', h, 'g', g)), "
        f"named_struct('at', 0, 'found', cast(array() as {SPANS})), "
        "(a, x) -> named_struct('at', a.at + length(x.g) + length(x.h), 'found', "
        "concat(a.found, array(named_struct('start', a.at + length(x.g), 'end', a.at + length(x.g) + length(x.h), 'value', x.h)))))"
    )
    chunks = f"transform(sequence(0, (size({prefix}_hit) - 1) div {chunk}), c -> {within})"
    placed = (
        f"aggregate({chunks}, named_struct('at', 0, 'all', cast(array() as array<{SPANS}>)), "
        "(a, x) -> named_struct('at', a.at + x.at, 'all', concat(a.all, array(transform(x.found, s -> named_struct('start', s.start + a.at, 'end', s.end + a.at, 'value', s.value))))), "
        "a -> flatten(a.all))"
    )
    return F.expr(f"if(size({prefix}_hit) = 0 or size({prefix}_gap) = 0, cast(array() as {SPANS}), {placed})")


_VALID = {
    "email": "true",
    "ip": r"forall(split(s.value, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', ltrim('0', p)) as bigint) <= 255)",
    "card": "length(regexp_replace(s.value, '[^0-9]', '')) between 16 and 19 and luhn_check(regexp_replace(s.value, '[^0-9]', ''))",
    "phone": "length(regexp_replace(s.value, '[^0-9]', '')) between 8 and 15",
}


#: A maximal token that ``TOKEN`` has, too.
_SHAPED = "(length(t.value) between 6 and 64 and length(regexp_replace(t.value, '[^0-9]', '')) >= 4)"


def base_spans(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds array columns ``email, ip, card, phone`` of valid spans, and ``token`` of identifier-shaped and ``wide`` of other tokens outside them."""
    clean = F.translate(F.col(text_col), MARK, OTHER)
    has_digit = F.col("clean").rlike("[0-9]")
    out = rows.withColumn("clean", clean).withColumns(
        {
            "dotted": F.when(F.instr("clean", "@") > 0, F.regexp_replace("clean", rf"(?<=[{_HOST}])\.(?=[{_HOST}])", MARK)).otherwise(F.lit("")),
            "grouped": F.when(has_digit, F.regexp_replace("clean", "(?<=[0-9])[ -](?=[0-9])", MARK)).otherwise(F.lit("")),
        }
    )
    for kind, text, pattern, when in (
        ("email", "dotted", EMAIL, F.instr("dotted", "@") > 0),
        ("ip", "clean", IP, has_digit),
        ("card", "grouped", CARD, F.length("grouped") > 0),
        ("phone", "clean", PHONE, F.instr("clean", "+") > 0),
        ("token", "clean", TOKEN, has_digit),
        ("wide", "clean", WIDE, has_digit | (F.instr("clean", "_") > 0)),
    ):
        out = out.withColumns({f"{kind}_{k}": c for k, c in _hits(F.col(text), pattern, when).items()})
    out = out.withColumns({k: _spans(k) for k in (*KINDS, "token", "wide")})
    out = out.withColumns({k: F.expr(f"filter({k}, s -> {v})") for k, v in _VALID.items()})
    overlaps = " or ".join(f"exists({k}, b -> b.start < t.end and t.start < b.end)" for k in KINDS)
    out = out.withColumn("token", F.expr(f"filter(token, t -> not ({overlaps}))"))
    out = out.withColumn("wide", F.expr(f"filter(wide, t -> not ({_SHAPED} or {overlaps}))"))
    return out.drop("clean", "dotted", "grouped", *(f"{k}_{x}" for k in (*KINDS, "token", "wide") for x in ("hit", "gap")))


def _listed(*kinds: str) -> Column:
    """``kind:start:end`` of the spans of the kinds in order, comma-joined."""
    return F.concat_ws(",", F.concat(*[F.expr(f"transform({k}, s -> concat('{k}:', s.start, ':', s.end))") for k in kinds]))


_BEFORE = r"filter(split(regexp_replace(lower(left), '[^\\p{L}]+', ' '), ' '), w -> w != '')"
_TWO_WORDS = "if(size(w) > 1, concat(w[size(w) - 2], ' ', w[size(w) - 1]), null)"


def contexts(seen: DataFrame) -> DataFrame:
    """``instance, seed, pattern`` edges, each once; ``seen`` has the arrays ``seeds`` and ``tokens``, each entry with the text left of it."""
    rows = seen.select(F.explode(F.expr("concat(transform(seeds, s -> named_struct('instance', s.value, 'left', s.left, 'seed', true)), transform(tokens, s -> named_struct('instance', s.value, 'left', s.left, 'seed', false)))")).alias("m")).select("m.*")
    words = rows.select("instance", "seed", F.expr(_BEFORE).alias("w")).where("size(w) > 0")
    patterns = F.expr(f"array_compact(array({_TWO_WORDS}, if(length(w[size(w) - 1]) >= 4, w[size(w) - 1], null)))")
    return words.select("instance", "seed", F.explode(patterns).alias("pattern")).distinct()


def discovered(seen: DataFrame, patterns: DataFrame) -> DataFrame:
    """``doc_id, th, span`` of other tokens that stand behind two words of ``patterns(pattern)``."""
    rows = seen.where("size(others) > 0").select("doc_id", "th", F.explode("others").alias("t")).select("doc_id", "th", F.struct(*[F.col(f"t.{c}").alias(c) for c in ("start", "end", "value")]).alias("span"), F.col("t.left").alias("left"))
    keyed = rows.select("doc_id", "th", "span", F.expr(_BEFORE).alias("w")).select("doc_id", "th", "span", F.expr(_TWO_WORDS).alias("pattern"))
    return keyed.join(patterns, "pattern", "left_semi").select("doc_id", "th", "span")


def bootstrap(edges: DataFrame, rounds: int = 3, smoothing: float = 2.0, threshold: float = 0.6, min_seeds: int = 3) -> tuple[DataFrame, DataFrame]:
    """``instance`` of every non-seed whose best pattern scores at least ``threshold`` after ``rounds`` passes, and ``pattern, quality`` of the last pass.

    A pattern counts only with ``min_seeds`` distinct seeds.
    """
    induced = edges.groupBy("pattern").agg(F.count_if("seed").alias("seeds")).where(F.col("seeds") >= min_seeds).select("pattern")
    graph = staged(edges.join(induced, "pattern"), "pii-graph")
    scores = None
    for _ in range(rounds):
        known = graph if scores is None else graph.join(scores, "instance", "left")
        own = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.lit(0.0) if scores is None else F.coalesce("score", F.lit(0.0)))
        patterns = known.groupBy("pattern").agg((F.sum(own) / (F.count("*") + smoothing)).alias("quality"))
        scores = graph.where("not seed").join(patterns, "pattern").groupBy("instance").agg(F.max("quality").alias("score"))
    return scores.where(F.col("score") >= threshold).select("instance"), patterns


def find(docs: DataFrame, rounds: int = 3, threshold: float = 0.6, min_seeds: int = 3, wide_threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every document: doc_id, text_hash, arrays email, ip, card, phone and id of spans (code points).

    Null and empty texts have none; rows that repeat an id are judged by their own texts; null ids stay;
    an empty table gives no rows; further columns are ignored. Whole texts of any length are matched, in time that grows with them. An instance
    is found if its best pattern reaches the threshold exactly; equal scores need no order, since nothing is ranked.
    """
    text = text_of(text_col)
    rows = base_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")))
    left = lambda k: f"transform({k}, s -> named_struct('value', s.value, 'start', s.start, 'end', s.end, 'left', substring(text, greatest(1, s.start - 59), least(60, s.start))))"
    seen = staged(rows.select("doc_id", "th", *KINDS, F.expr(left("concat(email, ip, card, phone)")).alias("seeds"), F.expr(left("token")).alias("tokens"), F.expr(left("wide")).alias("others")), "pii-spans")
    found, patterns = bootstrap(contexts(seen), rounds, threshold=threshold, min_seeds=min_seeds)
    placed = seen.where(F.size("tokens") > 0).select("doc_id", "th", F.explode("tokens").alias("t")).select("doc_id", "th", F.col("t.value").alias("instance"), F.struct(F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("t.value").alias("value")).alias("span"))
    known = placed.join(found, "instance", "left_semi").select("doc_id", "th", "span")
    both = known.unionByName(discovered(seen, patterns.where(F.col("quality") >= wide_threshold).select("pattern")))
    per_text = both.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("span")).alias("id"))
    joined = seen.alias("s").join(per_text.alias("p"), F.expr("s.doc_id <=> p.doc_id and s.th = p.th"), "left")
    return joined.select("s.doc_id", F.col("s.th").alias("text_hash"), *KINDS, F.coalesce("id", F.array().cast(SPANS)).alias("id"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, base digest and all spans in one string per document."""
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_listed(*KINDS), 256).alias("base_sha256"), _listed(*KINDS, "id").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **settings: object) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; a span that overlaps an earlier one joins it.

    Other columns stay as they are, whatever their names; null texts stay null, empty ones empty. Rows that repeat an id, with equal texts or others, are
    each redacted by their own text; an empty table stays empty. Whole texts of any length are rebuilt span by span.
    """
    spans = F.array_sort(F.concat(*[F.expr(f"transform({k}, s -> named_struct('start', s.start, 'end', s.end, 'kind', '{k}'))") for k in (*KINDS, "id")]))
    found = find(docs, id_col=id_col, text_col=text_col, **settings).select("doc_id", "text_hash", spans.alias("spans")).where(F.size("spans") > 0).distinct()
    rows = rows_with(docs, own_id=F.col(id_col).cast("long"), own_hash=F.xxhash64(text_of(text_col)), own_text=text_of(text_col))
    joined = rows.join(found, F.expr("own_id <=> doc_id and own_hash = text_hash"), "left")
    built = F.expr(
        """concat(aggregate(spans, named_struct('text', '', 'at', 0),
            (a, s) -> if(s.start < a.at, named_struct('text', a.text, 'at', greatest(a.at, s.end)),
                named_struct('text', concat(a.text, substring(own_text, a.at + 1, s.start - a.at), '<', upper(s.kind), '>'), 'at', s.end)), a -> a.text),
            substring(own_text, aggregate(spans, 0, (a, s) -> greatest(a, s.end)) + 1))"""
    )
    return joined.select(*[F.when(F.col("spans").isNotNull(), built).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
