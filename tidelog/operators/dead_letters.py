"""Dead-letter analysis: parse, classify, rank root causes, advise, replay.

Every function works on the whole dead-letter table. Reports with a ``top`` argument are
top-k reports; the rows behind them are never sampled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.columns import band, percent, total
from tidelog.model import HEADER_FIELDS, HEADER_PREFIX
from tidelog.operators import dlq_rules as rules
from tidelog.operators import events as ev

UNKNOWN = "UNKNOWN"
ORDER = ["part", "off"]

_DEFAULTS = {"exception_message": "", "stacktrace": "", "partition": "-1", "offset": "-1", "task_id": "-1"}


def header(df: DataFrame, name: str) -> Column:
    """Value of a header, from a map or from a list of key/value pairs (the last one counts)."""
    key = HEADER_PREFIX + name
    if isinstance(df.schema["headers"].dataType, T.MapType):
        return F.try_element_at("headers", F.lit(key))
    found = F.filter("headers", lambda h: h["key"] == key)
    return F.try_element_at(found, F.lit(-1))["value"]


def parse_dlq(df: DataFrame) -> DataFrame:
    """Error headers as columns, with defaults for those that are missing."""
    return df.withColumns(
        {c: F.coalesce(header(df, h), F.lit(_DEFAULTS.get(c, "unknown"))) for c, h in HEADER_FIELDS.items()}
    )


def dlq_table(parsed: DataFrame, fallback: bool = True) -> DataFrame:
    """Add ``table_name``: last part of a topic with three parts or more, else the topic.

    Without a topic the first of two places in the payload that names a table is used; each
    record counts for one table only.
    """
    parts = F.split("original_topic", r"\.")
    from_topic = F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(F.col("original_topic"))
    from_payload = F.coalesce(
        F.nullif(F.regexp_extract("value", r'"table"\s*:\s*"([^"]+)"', 1), F.lit("")),
        F.nullif(F.regexp_extract("value", r"\b\w+\.\w+\.(\w+)", 1), F.lit("")),
        F.lit("unknown"),
    )
    known = F.col("original_topic") != "unknown"
    return parsed.withColumn("table_name", F.when(known, from_topic).otherwise(from_payload if fallback else F.lit("unknown")))


def dlq_fields(parsed: DataFrame) -> DataFrame:
    """Add ``problematic_fields``, the names after ``field`` or ``fields`` in the message."""
    pattern = F.lit(r"(?i)fields?\s+['\"`]?(\w+)['\"`]?")
    return parsed.withColumn("problematic_fields", F.regexp_extract_all("exception_message", pattern, F.lit(1)))


def _any_pattern(lower: Column, patterns: Sequence[str]) -> Column:
    """Does any pattern occur in the lower-cased text: plain words by search, the others by
    regular expression, and that only when their first word is there."""
    words = [p for p in patterns if ".*" not in p]
    tests = [lower.contains(w.lower()) for w in words]
    for p in (p for p in patterns if ".*" in p):
        tests.append(lower.contains(p.split(".*")[0].strip().lower()) & lower.rlike(p.lower()))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def classify_dlq(parsed: DataFrame) -> DataFrame:
    """Add ``category, score, confidence`` from patterns, keywords and stage.

    A category gets 15 for any of its patterns, its weight for every keyword found and the
    stage hint. The highest score wins; equal scores go to the category found first: by
    pattern, then by keyword, then by stage, each in rule order. Confidence is five times the
    score, at most 100. A record that scores nowhere is UNKNOWN.
    """
    text = F.concat_ws(" ", "exception_class", "exception_message", "stage")
    keyword_rank = {c: i for i, c in enumerate(rules.KEYWORD_SCORES)}
    prepared = parsed.withColumn("_lower", F.lower(text))
    found: dict[str, Column] = {}
    for category, patterns in rules.EXCEPTION_PATTERNS.items():
        found[f"_hit_{category}"] = _any_pattern(F.col("_lower"), patterns)
        weight, words = rules.KEYWORD_SCORES[category]
        counts = [F.when(F.col("_lower").contains(w.lower()), weight).otherwise(0) for w in words]
        found[f"_words_{category}"] = sum(counts[1:], counts[0])
    candidates = []
    for i, category in enumerate(rules.EXCEPTION_PATTERNS):
        hit, words = F.col(f"_hit_{category}"), F.col(f"_words_{category}")
        score = F.when(hit, rules.PATTERN_SCORE).otherwise(0) + words
        for stage, (hinted, extra) in rules.STAGE_HINTS.items():
            if hinted == category:
                score = score + F.when(F.col("stage") == stage, extra).otherwise(0)
        rank = F.when(hit, i).when(words > 0, 10 + keyword_rank[category]).otherwise(20)
        candidates.append(F.struct(score.alias("score"), (-rank).alias("order"), F.lit(category).alias("category")))
    # Exploding the one winner keeps filters on the result above the scoring: pushed below, a
    # filter on ``category`` would repeat every rule in its condition.
    best = F.explode(F.array(F.array_max(F.array(*candidates)))).alias("_best")
    scored = prepared.withColumns(found).select(*parsed.columns, best)
    hit = F.col("_best.score") > 0
    return scored.withColumns(
        {
            "category": F.when(hit, F.col("_best.category")).otherwise(UNKNOWN),
            "score": F.col("_best.score"),
            "confidence": F.least(F.lit(100), F.col("_best.score") * 5),
        }
    ).drop("_best")


def analyse(df: DataFrame) -> DataFrame:
    """Parsed, located and classified dead letters: the input of the reports below."""
    return classify_dlq(dlq_fields(dlq_table(parse_dlq(df))))


def dlq_categories(errors: DataFrame) -> DataFrame:
    """Records and share of all records per category."""
    counts = errors.groupBy("category").agg(F.count("*").alias("n"))
    return counts.withColumn("share", percent(F.col("n"), total(counts, F.sum("n"))))


def known(errors: DataFrame) -> DataFrame:
    return errors.where(F.col("category") != UNKNOWN)


def confirm_missing(errors: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables named by missing-table errors that the target catalog really lacks."""
    named = errors.where((F.col("category") == "MISSING_TABLE") & (F.col("table_name") != "unknown"))
    return named.select("table_name").distinct().join(tables.select("table_name"), "table_name", "left_anti")


def confirm_schema(errors: DataFrame, tables: DataFrame) -> DataFrame:
    """Fields named by schema errors of existing tables, with the first message."""
    mismatch = errors.where(F.col("category") == "SCHEMA_MISMATCH")
    rows = mismatch.select("table_name", F.explode("problematic_fields").alias("field"), "exception_message", *ORDER)
    first = F.min_by("exception_message", F.struct(*ORDER))
    fields = rows.groupBy("table_name", "field").agg(F.count("*").alias("n"), first.alias("first_message"))
    there = fields.join(tables.select("table_name").distinct(), "table_name", "left_semi")
    return there.select(F.concat_ws(".", "table_name", "field").alias("table_field"), "n", "first_message")


def first_rows(report: DataFrame, top: int | None) -> DataFrame:
    """The first ``top`` rows of a sorted report, all of them if no limit is given."""
    return report if top is None else report.limit(top)


def dlq_tables(errors: DataFrame, top: int | None = None) -> DataFrame:
    """Tables with most classified errors and their most common category (ties: found first)."""
    per = known(errors).groupBy("table_name", "category").agg(
        F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("_first")
    )
    # one row per table and category is left here; the earliest record breaks ties
    order = F.struct("n", -F.col("_first.part"), -F.col("_first.off"))
    out = per.groupBy("table_name").agg(F.sum("n").alias("n_errors"), F.max_by("category", order).alias("primary_category"))
    return first_rows(out.orderBy(F.col("n_errors").desc(), "table_name"), top)


def dlq_fields_top(errors: DataFrame, top: int | None = None) -> DataFrame:
    """Fields named most often by classified errors."""
    fields = known(errors).select(F.explode("problematic_fields").alias("field"))
    return first_rows(fields.groupBy("field").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "field"), top)


def root_causes(errors: DataFrame, samples: int = 3) -> DataFrame:
    """One row per category: errors, share, tables, fields, first messages and impact.

    Two passes: one counts per category, table and field, so that lists of names are as long
    as the schema, not as the dead letters; one ranks the first messages, with the limit
    applied before the shuffle as well. Persist ``errors`` to classify only once.
    """
    per = (
        errors.select(
            "category", "table_name", F.posexplode_outer("problematic_fields").alias("_pos", "field"), "exception_message"
        )
        .groupBy("category", "table_name", "field")
        .agg(
            F.count_if(F.coalesce("_pos", F.lit(0)) == 0).alias("n"),
            F.max(F.col("exception_message").contains("Date")).alias("has_date"),
        )
    )
    # ``per`` has one row per category, table and field: schema-sized from here on
    causes = known(per).groupBy("category").agg(
        F.sum("n").alias("error_count"),
        F.array_sort(F.collect_set("table_name")).alias("affected_tables"),
        F.array_sort(F.collect_set("field")).alias("affected_fields"),
        F.max("has_date").alias("has_date"),
    )
    by = Window.partitionBy("category").orderBy(*ORDER)
    first = (
        known(errors).select("category", F.col("exception_message").alias("message"), *ORDER)
        .withColumn("position", F.row_number().over(by))
        .where(F.col("position") <= samples)
        .groupBy("category")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "message"))), lambda s: s["message"])
             .alias("sample_messages"))
    )
    return causes.join(first, "category", "left").withColumns(
        {
            "percentage": percent(F.col("error_count"), total(per, F.sum("n"))),
            "impact_score": F.col("error_count") * F.size("affected_tables"),
        }
    )


def _of(table: Mapping[str, object], key: Column, default: object) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, key), F.lit(default))


def prioritise(causes: DataFrame) -> DataFrame:
    """Add ``fix_complexity`` and ``priority`` (errors times tables times weight)."""
    dated = (F.col("category") == "SCHEMA_MISMATCH") & F.col("has_date")
    complexity = F.when(dated, rules.DATE_COMPLEXITY).otherwise(_of(rules.COMPLEXITY, F.col("category"), UNKNOWN))
    out = causes.withColumn("fix_complexity", complexity)
    weight = _of(rules.COMPLEXITY_WEIGHTS, F.col("fix_complexity"), 0.5)
    return out.withColumn("priority", F.col("impact_score").cast("double") * weight)


def severity(causes: DataFrame, share: str = "percentage") -> DataFrame:
    """CRITICAL from 50 percent, HIGH from 20, MEDIUM from 5, else LOW."""
    return causes.withColumn("severity", band(F.col(share), [(50, "CRITICAL"), (20, "HIGH"), (5, "MEDIUM")], "LOW"))


def recommend(causes: DataFrame) -> DataFrame:
    """Advice and a suggested sink setting per root cause."""
    advice = {c: "; ".join(lines) for c, lines in rules.ADVICE.items()}
    settings = {c: "=".join(kv) for c, kv in rules.SETTINGS.items()}
    return causes.withColumns(
        {
            "advice": _of(advice, F.col("category"), "inspect the sample messages"),
            "setting": _of(settings, F.col("category"), ""),
        }
    )


def suggest_alters(errors: DataFrame) -> DataFrame:
    """Statements that widen date and time columns named by schema errors of a table."""
    mismatch = errors.where(F.col("category") == "SCHEMA_MISMATCH")
    pairs = mismatch.select("table_name", F.explode("problematic_fields").alias("field")).distinct()
    timed = pairs.where(F.lower("field").rlike("date|time") | F.lower("field").endswith("_at"))
    text = F.concat(F.lit("ALTER TABLE `"), "table_name", F.lit("` ALTER COLUMN `"), "field", F.lit("` TYPE TIMESTAMP"))
    return timed.select("table_name", "field", text.alias("statement"))


def dlq_error_types(errors: DataFrame) -> DataFrame:
    """Records per exception class and per topic, as ``kind, name, n``."""
    pairs = F.explode(
        F.array(
            F.struct(F.lit("class").alias("kind"), F.col("exception_class").alias("name")),
            F.struct(F.lit("topic").alias("kind"), F.col("original_topic").alias("name")),
        )
    )
    return errors.select(pairs.alias("p")).groupBy("p.kind", "p.name").agg(F.count("*").alias("n"))


def error_codes(errors: DataFrame, by: Sequence[str] = ("table_name",)) -> DataFrame:
    """Engine error codes in the messages, counted per table and described."""
    code = F.regexp_extract("exception_message", r"Code:\s*(\d+)", 1)
    rows = errors.withColumn("code", code).where(F.col("code") != "")
    counts = rows.groupBy(*by, "code").agg(F.count("*").alias("n"))
    return counts.withColumn("description", _of(rules.ERROR_CODES, F.col("code"), "Unknown error"))


def error_type(errors: DataFrame) -> DataFrame:
    """Add ``error_type`` by the first rule that applies to the message."""
    m, low = F.col("exception_message"), F.lower("exception_message")
    kind = (
        F.when(m.contains("Code: 16") | m.contains("TOO_MANY_COLUMNS"), "column_count")
        .when(m.contains("Code: 47") | m.contains("UNKNOWN_IDENTIFIER"), "unknown_column")
        .when(m.contains("Code: 53") | m.contains("TYPE_MISMATCH"), "type_mismatch")
        .when(low.contains("does not exist"), "table_not_found")
        .when(low.contains("null"), "null_violation")
        .otherwise("unknown")
    )
    return errors.withColumn("error_type", kind)


def extrapolate(sample: DataFrame, total_rows: Column, by: Sequence[str] = ("table_name",)) -> DataFrame:
    """Counts in a sample and what they stand for in all records."""
    counts = sample.groupBy(*by).agg(F.count("*").alias("n_sample"))
    size = total(counts, F.sum("n_sample"))
    estimate = F.round(F.try_divide(F.col("n_sample"), F.try_divide(size, total_rows))).cast("bigint")
    return counts.withColumn("n_estimated", estimate)


def dlq_share(errors: DataFrame, top: int | None = None) -> DataFrame:
    """Records per table and share of all, largest first."""
    counts = errors.groupBy("table_name").agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", percent(F.col("n"), total(counts, F.sum("n")), 2))
    return first_rows(shares.orderBy(F.col("n").desc(), "table_name"), top)


def dlq_bands(dlq: DataFrame, source_rows: Column) -> DataFrame:
    """Volume band (none, few below 1000, moderate below 100000, high) and rate against the source."""
    n = F.col("dlq_rows")
    level = F.when(n == 0, "none").when(n < 1000, "few").when(n < 100000, "moderate").otherwise("high")
    out = dlq.agg(F.count("*").alias("dlq_rows")).withColumn("source_rows", source_rows)
    return out.withColumns({"level": level, "rate": percent(n, F.col("source_rows"), 2)})


def failure_scope(errors: DataFrame, counts: DataFrame) -> DataFrame:
    """Per failing table: some rows arrive, none do, or the table does not exist.

    ``counts`` has ``table_name, n_rows`` of the target tables.
    """
    failing = errors.groupBy("table_name").agg(F.count("*").alias("n_errors"))
    joined = failing.join(counts.select("table_name", "n_rows"), "table_name", "left")
    scope = F.when(F.col("n_rows").isNull(), "table_missing").when(F.col("n_rows") > 0, "some_rows_fail").otherwise("all_rows_fail")
    return joined.select("table_name", "n_errors", scope.alias("scope"))


def replay(
    dlq: DataFrame, types: Mapping[str, str], required: Sequence[str] = (), exclude: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Run dead letters through the pipeline again after a fix.

    Returns the rows that now fit and the records that still fail, whose ``attempt`` is one
    higher. Tables in ``exclude`` are left where they are (neither replayed nor counted); a record
    without a topic belongs to none of them.
    """
    if exclude:
        located = ev.route_topic(dlq, out="_table")
        dlq = located.where(~F.coalesce(F.col("_table").isin(*exclude), F.lit(False))).drop("_table")
    messages = dlq.select("topic", "part", "off", "msg_key", "value", (F.col("attempt") + 1).alias("attempt"))
    rows = ev.normalise_values(ev.unwrap(ev.parse_envelope(messages, types)), types)
    return ev.split_valid(rows, required)


def dlq_report(errors: DataFrame, path: str) -> None:
    """Write the result frames as JSON folders: categories, tables, fields and root causes."""
    frames = {
        "categories": dlq_categories(errors),
        "tables": dlq_tables(errors),
        "fields": dlq_fields_top(errors),
        "root_causes": recommend(severity(prioritise(root_causes(errors)))),
    }
    for name, frame in frames.items():
        frame.write.mode("error").json(f"{path.rstrip('/')}/{name}")
