"""Registered queries: dead-letter analysis over records derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import load
from tidelog.model import HEADER_PREFIX, ORDER_TYPES, RECORD_SCHEMA
from tidelog.operators import bi
from tidelog.operators import dead_letters as dl
from tidelog.operators import dlq_rules as rules
from tidelog.operators import events as ev
from tidelog.plans.queries_events import typed_rows
from tidelog.plans.queries_sources import change_batch, written
from tidelog.registry import percent_sql, query
from tidelog.session import work_dir
from tidelog.sources import read
from tidelog.streaming import jobs

_HEADERS = {
    "h_topic": "topic",
    "h_partition": "partition",
    "h_offset": "offset",
    "h_stage": "stage",
    "h_class": "exception.class.name",
    "h_message": "exception.message",
}


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters as a sink writes them: a list of header pairs, absent ones left out."""
    rows = load(spark, sf_dir, "dead_letters")
    pairs = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(HEADER_PREFIX + h).alias("key"), F.col(c).alias("value")))
        for c, h in _HEADERS.items()
    ]
    return rows.select("off", "part", "ts", "msg_key", "value", F.array_compact(F.array(*pairs)).alias("headers"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.analyse(letters(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target tables: one per event type, but views and clicks were never created."""
    types = load(spark, sf_dir, "events").select(F.col("event_type").alias("table_name")).distinct()
    return types.where(~F.col("table_name").isin("view", "click"))


_CATALOG = "SELECT DISTINCT event_type AS table_name FROM events WHERE event_type NOT IN ('view', 'click')"

# --- the definitions as SQL ------------------------------------------------------------

_PARSED = """SELECT *, coalesce(h_topic, 'unknown') AS topic, h_class || ' ' || h_message || ' ' || h_stage AS txt,
    CASE WHEN h_topic IS NULL THEN regexp_extract(value, '"table":"([^"]+)"', 1)
         WHEN h_topic LIKE '%.%.%' THEN split_part(h_topic, '.', 3) ELSE h_topic END AS table_name,
    regexp_extract_all(h_message, '(?i)fields?\\s+[''"`]?(\\w+)[''"`]?', 1) AS fields
    FROM dead_letters"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hit(category: str) -> str:
    return "(" + " OR ".join(
        f"regexp_matches(txt, {_sql_text(p)}, 'i')" for p in rules.EXCEPTION_PATTERNS[category]
    ) + ")"


def _words(category: str) -> str:
    weight, words = rules.KEYWORD_SCORES[category]
    return " + ".join(f"CASE WHEN contains(lower(txt), {_sql_text(w.lower())}) THEN {weight} ELSE 0 END" for w in words)


def _scores() -> str:
    """One row per record and category with its score and the order it is found in."""
    keyword_order = list(rules.KEYWORD_SCORES)
    parts = []
    for i, c in enumerate(rules.EXCEPTION_PATTERNS):
        stage = " + ".join(
            f"CASE WHEN h_stage = '{s}' THEN {n} ELSE 0 END" for s, (cat, n) in rules.STAGE_HINTS.items() if cat == c
        ) or "0"
        parts.append(
            f"""SELECT off, '{c}' AS category, CASE WHEN {_hit(c)} THEN 15 ELSE 0 END + {_words(c)} + {stage} AS score,
                CASE WHEN {_hit(c)} THEN {i} WHEN {_words(c)} > 0 THEN {100 + keyword_order.index(c)} ELSE 200 END AS found
                FROM parsed"""
        )
    return " UNION ALL ".join(parts)


_ERRORS = f"""
    parsed AS ({_PARSED}),
    scores AS ({_scores()}),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY off ORDER BY score DESC, found) AS rn
                            FROM scores WHERE score > 0) r WHERE rn = 1),
    errs AS (SELECT p.*, coalesce(b.category, 'UNKNOWN') AS category, coalesce(b.score, 0) AS score
             FROM parsed p LEFT JOIN best b ON p.off = b.off)"""


@query(
    "f01_parse_headers",
    """SELECT off, coalesce(h_topic, 'unknown') AS original_topic, h_partition AS partition, h_offset AS "offset",
          h_stage AS stage, h_class AS exception_class, h_message AS exception_message, '' AS stacktrace,
          'unknown' AS connector_name, '-1' AS task_id FROM dead_letters""",
)
def parse_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.parse_dlq(letters(spark, sf_dir)).drop("part", "ts", "msg_key", "value", "headers")


def letter_topic(spark: SparkSession, sf_dir: str) -> str:
    """The dead letters as record files, standing in for their topic."""
    path = work_dir(spark, "dlq-topic")
    rows = letters(spark, sf_dir).withColumns({"topic": F.lit("dlq.shop"), "ts": F.col("ts").cast("timestamp")})
    rows.select(*RECORD_SCHEMA.names).write.json(path)
    return path


@query(
    "f01_dlq_topic",
    """SELECT off, part, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS seen_at, coalesce(h_topic, 'unknown') AS original_topic,
          h_class AS exception_class, h_stage AS stage, '-1' AS task_id FROM dead_letters""",
)
def dlq_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters read from their topic as a batch: headers and time are those of the records."""
    records = read.read_records(spark, r"dlq\..*", path=letter_topic(spark, sf_dir))
    return dl.parse_dlq(records).select(
        "off", "part", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"), "original_topic", "exception_class", "stage", "task_id"
    )


@query("f02_dlq_table", f"SELECT off, table_name FROM ({_PARSED}) p")
def dlq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.dlq_table(dl.parse_dlq(letters(spark, sf_dir))).select("off", "table_name")


@query("f03_dlq_fields", f"SELECT off, array_to_string(fields, ',') AS fields FROM ({_PARSED}) p")
def dlq_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dl.dlq_fields(dl.parse_dlq(letters(spark, sf_dir)))
    return out.select("off", F.array_join("problematic_fields", ",").alias("fields"))


@query("f04_classify", f"WITH {_ERRORS} SELECT off, category, score, least(100, score * 5) AS confidence FROM errs")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors(spark, sf_dir).select("off", "category", "score", "confidence")


@query(
    "f05_tied_scores",
    f"""WITH {_ERRORS}, top AS (SELECT off, max(score) AS s FROM scores WHERE score > 0 GROUP BY off)
        SELECT e.category, count(*) AS n, count(CASE WHEN t.k > 1 THEN 1 END) AS n_tied
        FROM errs e LEFT JOIN (SELECT s.off, count(*) AS k FROM scores s JOIN top ON s.off = top.off AND s.score = top.s GROUP BY s.off) t
          ON e.off = t.off GROUP BY e.category""",
)
def tied_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a category won a tie (the runner-up is the best score without the winner's rules); UNKNOWN wins none."""
    found = errors(spark, sf_dir)
    text = F.concat_ws(" ", "exception_class", "exception_message", "stage")
    rivals = []
    for c, patterns in rules.EXCEPTION_PATTERNS.items():
        weight, words = rules.KEYWORD_SCORES[c]
        score = F.when(text.rlike("(?i)(?:" + "|".join(patterns) + ")"), 15).otherwise(0)
        for w in words:
            score = score + F.when(F.lower(text).contains(w.lower()), weight).otherwise(0)
        for s, (cat, n) in rules.STAGE_HINTS.items():
            if cat == c:
                score = score + F.when(F.col("stage") == s, n).otherwise(0)
        rivals.append(F.when((score == F.col("score")) & (F.col("category") != c), 1).otherwise(0))
    tied = (F.col("score") > 0) & (sum(rivals[1:], rivals[0]) > 0)
    return found.groupBy("category").agg(F.count("*").alias("n"), F.count_if(tied).alias("n_tied"))


@query(
    "f06_categories",
    f"""WITH {_ERRORS} SELECT category, count(*) AS n,
          CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM errs) * 100 AS share FROM errs GROUP BY category""",
)
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.dlq_categories(errors(spark, sf_dir))


@query(
    "f07_confirm_missing",
    f"""WITH {_ERRORS} SELECT DISTINCT table_name FROM errs WHERE category = 'MISSING_TABLE' AND table_name <> 'unknown'
          AND table_name NOT IN ({_CATALOG})""",
)
def confirm_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.confirm_missing(errors(spark, sf_dir), catalog(spark, sf_dir))


@query(
    "f08_confirm_schema",
    f"""WITH {_ERRORS}, x AS (SELECT table_name, unnest(fields) AS field, h_message, part, off FROM errs WHERE category = 'SCHEMA_MISMATCH')
        SELECT table_name || '.' || field AS table_field, count(*) AS n,
               min_by(h_message, part * 1000000000 + off) AS first_message
        FROM x WHERE table_name IN ({_CATALOG}) GROUP BY table_name, field""",
)
def confirm_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.confirm_schema(errors(spark, sf_dir), catalog(spark, sf_dir))


@query(
    "f09_tables",
    f"""WITH {_ERRORS}, k AS (SELECT table_name, category, count(*) AS n, min(part * 1000000000 + off) AS first
                             FROM errs WHERE category <> 'UNKNOWN' GROUP BY table_name, category)
        SELECT k.table_name, CAST(sum(n) AS BIGINT) AS n_errors, max(CASE WHEN rn = 1 THEN category END) AS primary_category
        FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY n DESC, first) AS rn FROM k) k
        GROUP BY k.table_name ORDER BY n_errors DESC, k.table_name LIMIT 20""",
)
def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.dlq_tables(errors(spark, sf_dir), top=20)


@query(
    "f10_fields_top",
    f"""WITH {_ERRORS} SELECT field, count(*) AS n FROM (SELECT unnest(fields) AS field FROM errs WHERE category <> 'UNKNOWN') f
        GROUP BY field ORDER BY n DESC, field LIMIT 20""",
)
def fields_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.dlq_fields_top(errors(spark, sf_dir), top=20)


_CAUSES = f"""{_ERRORS},
    c AS (SELECT category, count(*) AS error_count, count(DISTINCT table_name) AS n_tables,
                 bool_or(contains(h_message, 'Date')) AS has_date FROM errs WHERE category <> 'UNKNOWN' GROUP BY category),
    ft AS (SELECT category, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS affected_tables
           FROM errs WHERE category <> 'UNKNOWN' GROUP BY category),
    ff AS (SELECT category, string_agg(DISTINCT field, ',' ORDER BY field) AS affected_fields
           FROM (SELECT category, unnest(fields) AS field FROM errs WHERE category <> 'UNKNOWN') u GROUP BY category),
    fm AS (SELECT category, string_agg(h_message, ' / ' ORDER BY part, off) AS sample_messages
           FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY part, off) AS rn FROM errs) r
           WHERE rn <= 3 GROUP BY category),
    causes AS (SELECT c.*, ft.affected_tables, coalesce(ff.affected_fields, '') AS affected_fields, fm.sample_messages,
                 CAST(c.error_count AS DOUBLE) / (SELECT count(*) FROM errs) * 100 AS percentage,
                 c.error_count * c.n_tables AS impact_score
               FROM c JOIN ft ON c.category = ft.category JOIN fm ON c.category = fm.category
               LEFT JOIN ff ON c.category = ff.category)"""


@query(
    "f11_root_causes",
    f"""WITH {_CAUSES} SELECT category, error_count, percentage, affected_tables, affected_fields, sample_messages, impact_score
        FROM causes""",
)
def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dl.root_causes(errors(spark, sf_dir))
    return out.select(
        "category", "error_count", "percentage", "impact_score",
        F.array_join("affected_tables", ",").alias("affected_tables"),
        F.array_join("affected_fields", ",").alias("affected_fields"),
        F.array_join("sample_messages", " / ").alias("sample_messages"),
    )


_COMPLEXITY = """CASE category WHEN 'MISSING_TABLE' THEN 'EASY (Create tables)' WHEN 'PRIMARY_KEY' THEN 'EASY (Config change)'
    WHEN 'TRANSFORM' THEN 'MEDIUM (Fix transform pattern)' WHEN 'CONNECTION' THEN 'MEDIUM (Config/network fix)'
    WHEN 'SCHEMA_MISMATCH' THEN CASE WHEN has_date THEN 'MEDIUM (Alter column types)' ELSE 'MEDIUM-HARD (Schema alignment)' END
    ELSE 'UNKNOWN' END"""


@query(
    "f12_prioritise",
    f"""WITH {_CAUSES} SELECT category, fix_complexity, CAST(impact_score AS DOUBLE) *
          CASE WHEN fix_complexity LIKE 'EASY%' THEN 1.5::DOUBLE WHEN fix_complexity LIKE 'MEDIUM (%' THEN 1.0::DOUBLE
               WHEN fix_complexity LIKE 'MEDIUM-HARD%' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS priority
        FROM (SELECT *, {_COMPLEXITY} AS fix_complexity FROM causes) x""",
)
def prioritise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.prioritise(dl.root_causes(errors(spark, sf_dir))).select("category", "fix_complexity", "priority")


@query(
    "f13_severity",
    f"""WITH {_ERRORS} SELECT category, n, CASE WHEN share >= 50 THEN 'CRITICAL' WHEN share >= 20 THEN 'HIGH'
          WHEN share >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity
        FROM (SELECT category, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM errs) AS share
              FROM errs GROUP BY category) s""",
)
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.severity(dl.dlq_categories(errors(spark, sf_dir)), "share").drop("share")


def _advice() -> str:
    cases = " ".join(f"WHEN '{c}' THEN '{'; '.join(lines)}'" for c, lines in rules.ADVICE.items())
    return f"CASE category {cases} ELSE 'inspect the sample messages' END"


@query(
    "f14_recommend",
    f"""WITH {_CAUSES} SELECT category, {_advice()} AS advice,
          CASE category WHEN 'PRIMARY_KEY' THEN 'primary.key.mode=record_value' WHEN 'SCHEMA_MISMATCH' THEN 'schema.evolution=basic'
               ELSE '' END AS setting FROM causes""",
)
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.recommend(dl.root_causes(errors(spark, sf_dir))).select("category", "advice", "setting")


@query(
    "f14_suggest_alters",
    f"""WITH {_ERRORS} SELECT DISTINCT table_name, field,
          'ALTER TABLE `' || table_name || '` ALTER COLUMN `' || field || '` TYPE TIMESTAMP' AS statement
        FROM (SELECT table_name, unnest(fields) AS field FROM errs WHERE category = 'SCHEMA_MISMATCH') f
        WHERE field ILIKE '%date%' OR field ILIKE '%time%' OR field ILIKE '%\\_at' ESCAPE '\\'""",
)
def suggest_alters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.suggest_alters(errors(spark, sf_dir))


@query(
    "f15_error_types",
    """SELECT 'class' AS kind, h_class AS name, count(*) AS n FROM dead_letters GROUP BY h_class
       UNION ALL SELECT 'topic', coalesce(h_topic, 'unknown'), count(*) FROM dead_letters GROUP BY h_topic""",
)
def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.dlq_error_types(dl.parse_dlq(letters(spark, sf_dir)))


@query(
    "f16_error_codes",
    f"""SELECT table_name, code, count(*) AS n, CASE code WHEN '1001' THEN 'Generic exception (std::exception)'
          WHEN '60' THEN 'Database does not exist' WHEN '44' THEN 'Cannot insert NULL' WHEN '27' THEN 'Type mismatch'
          WHEN '16' THEN 'Table does not exist' ELSE 'Unknown error' END AS description
        FROM (SELECT *, regexp_extract(h_message, 'Code:\\s*(\\d+)', 1) AS code FROM ({_PARSED}) p) c
        WHERE code <> '' GROUP BY table_name, code""",
)
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.error_codes(dl.dlq_table(dl.parse_dlq(letters(spark, sf_dir))))


@query(
    "f17_error_type",
    """SELECT error_type, count(*) AS n FROM (SELECT CASE
          WHEN h_message LIKE '%Code: 16%' OR h_message LIKE '%TOO_MANY_COLUMNS%' THEN 'column_count'
          WHEN h_message LIKE '%Code: 47%' OR h_message LIKE '%UNKNOWN_IDENTIFIER%' THEN 'unknown_column'
          WHEN h_message LIKE '%Code: 53%' OR h_message LIKE '%TYPE_MISMATCH%' THEN 'type_mismatch'
          WHEN h_message ILIKE '%does not exist%' THEN 'table_not_found' WHEN h_message ILIKE '%null%' THEN 'null_violation'
          ELSE 'unknown' END AS error_type FROM dead_letters) t GROUP BY error_type""",
)
def error_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dl.error_type(dl.parse_dlq(letters(spark, sf_dir)))
    return out.groupBy("error_type").agg(F.count("*").alias("n"))


@query(
    "f18_extrapolate",
    f"""WITH s AS (SELECT table_name FROM ({_PARSED}) p ORDER BY md5('3|' || off), off LIMIT 1000),
        g AS (SELECT table_name, count(*) AS n_sample FROM s GROUP BY table_name)
        SELECT table_name, n_sample, CAST(round(n_sample / ((SELECT count(*) FROM s) / (SELECT count(*) FROM dead_letters)::DOUBLE)) AS BIGINT)
                 AS n_estimated FROM g""",
)
def extrapolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand records stand for the whole queue: the sample is the feature."""
    found = dl.dlq_table(dl.parse_dlq(letters(spark, sf_dir)))
    sample = bi.sample_rows(found, ["off"], n=1000, seed=3)
    return dl.extrapolate(sample, letters(spark, sf_dir).agg(F.count("*")).scalar())


@query(
    "f19_share",
    f"""SELECT table_name, count(*) AS n, {percent_sql("count(*)", "(SELECT count(*) FROM dead_letters)", 2)} AS share
        FROM ({_PARSED}) p GROUP BY table_name ORDER BY n DESC, table_name LIMIT 50""",
)
def share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.dlq_share(dl.dlq_table(dl.parse_dlq(letters(spark, sf_dir))), top=50)


@query(
    "f20_bands",
    """SELECT dlq_rows, source_rows, CASE WHEN dlq_rows = 0 THEN 'none' WHEN dlq_rows < 1000 THEN 'few'
          WHEN dlq_rows < 100000 THEN 'moderate' ELSE 'high' END AS level,
          """ + percent_sql("dlq_rows", "source_rows", 2) + """ AS rate
       FROM (SELECT (SELECT count(*) FROM dead_letters) AS dlq_rows, (SELECT count(*) FROM lineitem) AS source_rows) x""",
)
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = load(spark, sf_dir, "lineitem").agg(F.count("*")).scalar()
    return dl.dlq_bands(letters(spark, sf_dir), source)


@query(
    "f21_failure_scope",
    f"""SELECT p.table_name, count(*) AS n_errors, CASE WHEN min(c.n) IS NULL THEN 'table_missing'
          WHEN min(c.n) > 0 THEN 'some_rows_fail' ELSE 'all_rows_fail' END AS scope
        FROM ({_PARSED}) p LEFT JOIN (SELECT event_type AS table_name, count(CASE WHEN event_type <> 'view' THEN 1 END) AS n
                                      FROM events WHERE event_type <> 'click' GROUP BY event_type) c ON c.table_name = p.table_name
        GROUP BY p.table_name""",
)
def failure_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = (
        load(spark, sf_dir, "events").where("event_type <> 'click'")
        .groupBy(F.col("event_type").alias("table_name"))
        .agg(F.count_if(F.col("event_type") != "view").alias("n_rows"))
    )
    return dl.failure_scope(dl.dlq_table(dl.parse_dlq(letters(spark, sf_dir))), counts)


@query(
    "f22_replay",
    """SELECT 'fixed' AS outcome, arrival AS off, 1 AS attempt FROM order_log WHERE arrival % 97 <> 5 AND arrival % 89 = 7
       UNION ALL SELECT 'failed', arrival, 1 FROM order_log WHERE arrival % 97 = 5""",
)
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer keys may now be text: those records pass, broken JSON fails a second time."""
    _, dlq = ev.split_valid(typed_rows(spark, sf_dir), ["o_orderkey"])
    ok, failed = dl.replay(dlq, {**ORDER_TYPES, "o_custkey": "string"}, ["o_orderkey"])
    fixed = ok.select(F.lit("fixed").alias("outcome"), "off", "attempt")
    return fixed.unionByName(failed.select(F.lit("failed").alias("outcome"), "off", "attempt"))


@query(
    "f23_replay_exclude",
    """SELECT table_name, count(*) AS n
       FROM (SELECT CASE WHEN h_topic LIKE 'mysql.shop.%' THEN substr(h_topic, 12) ELSE h_topic END AS table_name FROM dead_letters) t
       WHERE table_name IS NULL OR table_name NOT IN ('click', 'signup') GROUP BY table_name""",
)
def replay_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables set aside; every record of the others, and of no table, is replayed (and here fails again)."""
    dlq = load(spark, sf_dir, "dead_letters").select(
        F.col("h_topic").alias("topic"), "part", "off", "msg_key", F.concat(F.lit("not json "), "value").alias("value"),
        F.lit(0).alias("attempt"),
    )
    ok, failed = dl.replay(dlq, {"event_id": "bigint"}, exclude=["click", "signup"])
    again = ev.route_topic(failed).groupBy("table_name").agg(F.count("*").alias("n"))
    return again.unionByName(ok.groupBy("topic").agg(F.count("*").alias("n")).withColumnRenamed("topic", "table_name"))


@query(
    "f24_dlq_alert",
    """SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, failures FROM (
         SELECT date_trunc('hour', ts) AS h, count(*) AS failures FROM dead_letters GROUP BY 1) w
       WHERE failures > 10 AND h < (SELECT date_trunc('hour', max(ts)) FROM events)""",
)
def dlq_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with more than ten failures, from a stream; the hour still open is not judged."""
    stream = change_batch(spark, sf_dir, "dead_letters").withColumn("ts", F.col("ts").cast("timestamp"))
    alerts = jobs.dlq_alert(stream, "ts", "1 hour", threshold=10, delay="0 seconds")
    out = work_dir(spark, "alerts")
    jobs.append_to(alerts, out, work_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return written(spark, out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "failures")


@query(
    "f24_dlq_topic_alert",
    """SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, failures FROM (
         SELECT date_trunc('hour', ts) AS h, count(*) AS failures FROM dead_letters GROUP BY 1) w
       WHERE failures > 5 AND h < (SELECT date_trunc('hour', max(ts)) FROM events)""",
)
def dlq_topic_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with more than five failures, from the dead-letter topic by the time of its records."""
    stream = read.read_records(spark, r"dlq\..*", path=letter_topic(spark, sf_dir), stream=True)
    alerts = jobs.dlq_alert(stream, "ts", "1 hour", threshold=5, delay="0 seconds")
    out = work_dir(spark, "alerts")
    jobs.append_to(alerts, out, work_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return written(spark, out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "failures")


@query(
    "f25_report",
    f"""WITH {_ERRORS} SELECT category, count(*) AS n FROM errs GROUP BY category""",
)
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "dlq-report")
    dl.dlq_report(errors(spark, sf_dir), path)
    return spark.read.schema("category string, n bigint").json(f"{path}/categories")
