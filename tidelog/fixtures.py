"""Test inputs derived from the driver tables.

Each fixture is one SELECT over driver tables or other fixtures, written so that
both Spark and DuckDB run it. ``compose`` turns a query that names fixtures into
one statement with the needed common table expressions. Every fixture reads its
driver table whole, in one scan: variants of a row come from exploding an array,
not from a union of scans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02"


@dataclass(frozen=True)
class Dialect:
    name: str

    def array(self, items: list[str]) -> str:
        joined = ",\n    ".join(items)
        return f"array({joined})" if self.name == "spark" else f"list_value({joined})"

    def explode(self, items: list[str], alias: str) -> str:
        arr = self.array(items)
        if self.name == "spark":
            return f"LATERAL VIEW explode({arr}) x_{alias} AS {alias}"
        return f"CROSS JOIN unnest({arr}) AS x_{alias}({alias})"

    def join_texts(self, items: list[str], sep: str) -> str:
        """Concatenate texts, leaving out NULL ones."""
        return f"concat_ws({sep}, {', '.join(items)})"


SPARK = Dialect("spark")
DUCK = Dialect("duckdb")

Fixture = Callable[[Dialect], str]
FIXTURES: dict[str, Fixture] = {}


def fixture(fn: Fixture) -> Fixture:
    FIXTURES[fn.__name__] = fn
    return fn


# --- change logs -------------------------------------------------------------


@fixture
def user_changes(d: Dialect) -> str:
    return """
    SELECT event_id, ts, user_id, event_type, value, props,
           CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
           CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS _is_deleted
    FROM events"""


@fixture
def order_log(d: Dialect) -> str:
    kinds = d.explode(
        [
            "'snap'",
            "CASE WHEN o_orderkey % 25 = 4 THEN 'dup' END",
            "CASE WHEN o_orderkey % 10 = 3 THEN 'upd' END",
            "CASE WHEN o_orderkey % 40 = 9 THEN 'move' END",
            "CASE WHEN o_orderkey % 100 = 11 THEN 'new' END",
            "CASE WHEN o_orderkey % 50 = 7 THEN 'del' END",
            "CASE WHEN o_orderkey % 200 = 107 THEN 'back' END",
        ],
        "kind",
    )
    return f"""
    SELECT CASE WHEN kind = 'new' THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey,
           o_custkey, o_orderstatus,
           CAST(CAST(o_totalprice AS DECIMAL(16, 2))
                + CASE WHEN kind = 'upd' THEN 10 ELSE 0 END AS DECIMAL(18, 2)) AS o_totalprice,
           CASE WHEN kind = 'move' THEN o_orderdate + INTERVAL 40 DAY ELSE o_orderdate END AS o_orderdate,
           o_orderpriority,
           CASE kind WHEN 'snap' THEN 'r' WHEN 'dup' THEN 'r' WHEN 'upd' THEN 'u'
                     WHEN 'move' THEN 'u' WHEN 'del' THEN 'd' ELSE 'c' END AS op,
           CAST(CASE kind WHEN 'snap' THEN 0 WHEN 'dup' THEN 0 WHEN 'del' THEN 2
                          WHEN 'back' THEN 3 ELSE 1 END AS BIGINT) AS _version,
           CASE WHEN kind = 'del' THEN 1 ELSE 0 END AS _is_deleted,
           o_orderkey * 8 + CASE kind WHEN 'snap' THEN 0 WHEN 'dup' THEN 1 WHEN 'upd' THEN 2
                                      WHEN 'move' THEN 3 WHEN 'new' THEN 4 WHEN 'del' THEN 5
                                      ELSE 6 END AS arrival
    FROM orders {kinds}
    WHERE kind IS NOT NULL"""


_ROW_JSON = (
    """concat('{"o_orderkey":', CAST(o_orderkey AS STRING), ',"o_custkey":', custkey_text, """
    """',"o_orderstatus":"', o_orderstatus, '","o_totalprice":', CAST(o_totalprice AS STRING), """
    """',"o_orderdate":"', CAST(o_orderdate AS STRING), '","o_orderpriority":"', o_orderpriority, '"}')"""
)


@fixture
def envelopes(d: Dialect) -> str:
    """Change messages of ``order_log``: a 97th cut in half, an 89th with text in a number,
    and one empty message (tombstone) after each delete."""
    kinds = d.explode(["'event'", "CASE WHEN op = 'd' THEN 'tombstone' END"], "part_kind")
    return f"""
    SELECT topic, part, off, msg_key,
           CASE WHEN part_kind = 'tombstone' THEN NULL
                WHEN off % 97 = 5 THEN substr(full_value, 1, CAST(floor(length(full_value) / 2.0) AS INT))
                ELSE full_value END AS value,
           part_kind
    FROM (
      SELECT 'mysql.shop.orders' AS topic, o_orderkey % 4 AS part, arrival AS off,
             concat('{{"o_orderkey":', CAST(o_orderkey AS STRING), '}}') AS msg_key, op,
             concat('{{"before":', CASE WHEN op IN ('u', 'd') THEN row_json ELSE 'null' END,
                    ',"after":', CASE WHEN op = 'd' THEN 'null' ELSE row_json END,
                    ',"source":{{"db":"shop","table":"orders","snapshot":"',
                    CASE WHEN op = 'r' THEN 'true' ELSE 'false' END,
                    '","server_id":1,"file":"binlog.', CAST(999998 + _version AS STRING),
                    '","pos":', CAST(arrival AS STRING),
                    ',"ts_ms":', CAST(1700000000000 + arrival AS STRING),
                    '}},"op":"', op, '","ts_ms":', CAST(1700000000500 + arrival AS STRING), '}}') AS full_value
      FROM (
        SELECT *, {_ROW_JSON} AS row_json
        FROM (SELECT *, CASE WHEN arrival % 89 = 7 THEN '"abc"' ELSE CAST(o_custkey AS STRING) END AS custkey_text
              FROM order_log) l0) l1) l2 {kinds}
    WHERE part_kind IS NOT NULL"""


@fixture
def sign_rows(d: Dialect) -> str:
    """+1 for each order; for one key in seven a cancelling -1 and a changed +1."""
    kinds = d.explode(
        ["'add'"] + [f"CASE WHEN o_orderkey % 7 = 2 THEN '{k}' END" for k in ("cancel", "redo")]
        + ["CASE WHEN o_orderkey % 11 = 5 AND o_orderkey % 7 <> 2 THEN 'cancel' END"],
        "kind",
    )
    return f"""
    SELECT o_custkey, o_orderkey,
           CAST(CAST(o_totalprice AS DECIMAL(16, 2)) + CASE WHEN kind = 'redo' THEN 5 ELSE 0 END
                AS DECIMAL(18, 2)) AS amount,
           CASE WHEN kind = 'redo' THEN 2 ELSE 1 END AS version,
           CASE WHEN kind = 'cancel' THEN -1 ELSE 1 END AS sign
    FROM orders {kinds}
    WHERE kind IS NOT NULL"""


# --- two sides of a replication ------------------------------------------------

_TABLE_NAME = "concat(lower(l_returnflag), '_', lower(l_linestatus), '_', CAST(year(l_shipdate) AS STRING))"
_TABLE_RULE = (
    "((year(l_shipdate) - 1990) * 3 + ascii(l_returnflag) + 2 * ascii(l_linestatus)) % 10"
)


@fixture
def side_rows(d: Dialect) -> str:
    """Line items tagged with a table name, the table's defect rule and the sides holding the row.

    Rules: 0 and 9 equal; 1 missing in target; 2 empty in target; 3 half dropped; 4 few dropped;
    5 some repeated; 6 only in target; 7 empty on both sides; 8 equal counts, some values changed.
    """
    sides = d.explode(
        [
            "CASE WHEN rule NOT IN (6, 7) THEN 'src' END",
            """CASE WHEN rule IN (1, 2, 7) THEN NULL
                    WHEN rule = 3 AND l_orderkey % 2 = 0 THEN NULL
                    WHEN rule = 4 AND l_orderkey % 200 = 1 THEN NULL
                    ELSE 'tgt' END""",
            "CASE WHEN rule = 5 AND l_orderkey % 3 = 0 THEN 'tgt' END",
        ],
        "side",
    )
    return f"""
    SELECT table_name, rule, side, l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(l_quantity AS DECIMAL(10, 2))
             + CASE WHEN rule = 8 AND side = 'tgt' AND l_orderkey % 50 = 1 THEN 1 ELSE 0 END AS l_quantity,
           CAST(l_extendedprice AS DECIMAL(16, 2)) AS l_extendedprice,
           l_shipdate
    FROM (SELECT *, {_TABLE_NAME} AS table_name, {_TABLE_RULE} AS rule FROM lineitem) t {sides}
    WHERE side IS NOT NULL"""


@fixture
def side_tables(d: Dialect) -> str:
    """The table inventory: which side has the table, empty or not."""
    return f"""
    SELECT DISTINCT {_TABLE_NAME} AS table_name, {_TABLE_RULE} AS rule,
           1 AS in_source, CASE WHEN {_TABLE_RULE} = 1 THEN 0 ELSE 1 END AS in_target
    FROM lineitem"""


@fixture
def side_counts(d: Dialect) -> str:
    """Rows per table and side; a table missing in the target has NULL target rows."""
    return """
    SELECT i.table_name, coalesce(c.source_rows, 0) AS source_rows,
           CASE WHEN i.in_target = 1 THEN coalesce(c.target_rows, 0) END AS target_rows
    FROM side_tables i LEFT JOIN (
      SELECT table_name,
             count(CASE WHEN side = 'src' THEN 1 END) AS source_rows,
             count(CASE WHEN side = 'tgt' THEN 1 END) AS target_rows
      FROM side_rows GROUP BY table_name) c ON i.table_name = c.table_name"""


# --- dead letters --------------------------------------------------------------

_DLQ_TEMPLATES = [
    ("DataException", "Cannot convert value for field ''created_at'' to DateTime (Code: 27)"),
    ("ClassCastException", 'Type mismatch on fields "amount": incompatible source type'),
    ("SQLException", "Table shop.orders_v2 does not exist (Code: 60)"),
    ("SQLException", "Unknown table orders_archive, no such table"),
    ("ConnectException", "null key for field ''id'', key cannot be null (Code: 44)"),
    ("DataException", "primary key constraint: key is required on field `id`"),
    ("SocketTimeoutException", "network timeout after 30 s"),
    ("ConnectException", "connection refused, unable to connect"),
    ("TransformException", "regex failed while applying transform to field ''topic''"),
    ("PatternSyntaxException", "route error: bad replacement"),
    ("SQLException", "field ''score'' out of range, exceeds maximum (Code: 1001)"),
    ("ArithmeticException", "overflow: too large for field ''score''"),
    ("CharacterCodingException", "invalid character, bad encoding of field ''name''"),
    ("SQLException", "unsupported charset, TOO_MANY_COLUMNS (Code: 16)"),
    ("RuntimeException", "value out of range, then unable to connect"),
    ("RuntimeException", "failure without detail"),
]


def _template(pos: int) -> str:
    cases = " ".join(f"WHEN {i} THEN '{t[pos]}'" for i, t in enumerate(_DLQ_TEMPLATES))
    return f"CASE event_id % 16 {cases} END"


@fixture
def dead_letters(d: Dialect) -> str:
    """Failed records; a few have no topic header, a few a topic without a database part."""
    return f"""
    SELECT event_id AS off, user_id % 3 AS part, ts,
           concat('{{"event_id":', CAST(event_id AS STRING), '}}') AS msg_key,
           concat('{{"event_id":', CAST(event_id AS STRING),
                  ',"user_id":', CASE WHEN event_id % 5 = 0 THEN '"n/a"' ELSE CAST(user_id AS STRING) END,
                  ',"source":{{"db":"shop","table":"', event_type, '"}}}}') AS value,
           CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 53 = 1 THEN 'legacy'
                ELSE concat('mysql.shop.', event_type) END AS h_topic,
           CAST(user_id % 8 AS STRING) AS h_partition,
           CAST(event_id AS STRING) AS h_offset,
           CASE event_id % 3 WHEN 0 THEN 'VALUE_CONVERTER' WHEN 1 THEN 'TRANSFORMATION'
                             ELSE 'TASK_PUT' END AS h_stage,
           {_template(0)} AS h_class,
           {_template(1)} AS h_message
    FROM events"""


# --- schema corpus ---------------------------------------------------------------

_SLOTS = [
    "'id|bigint unsigned NOT NULL AUTO_INCREMENT'",
    "'object_id|varchar(64) DEFAULT NULL'",
    "CASE WHEN p_partkey % 2 = 0 THEN 'country|char(2) DEFAULT NULL' ELSE 'country_code|varchar(2) NOT NULL' END",
    "'phone_number|varchar(20) DEFAULT NULL'",
    "CASE WHEN p_partkey % 3 = 0 THEN 'total_amount|double DEFAULT NULL' "
    "WHEN p_partkey % 3 = 1 THEN 'total_amount|decimal(20,8) NOT NULL' ELSE 'credit_limit|int unsigned DEFAULT ''0''' END",
    "'discount|double DEFAULT ''0'''",
    "CASE WHEN p_size % 2 = 0 THEN 'order_status|enum(''new'',''done'') DEFAULT ''new''' "
    "ELSE 'status|varchar(16) NOT NULL' END",
    "CASE p_partkey % 4 WHEN 0 THEN 'updated_at|datetime DEFAULT NULL' "
    "WHEN 1 THEN 'event_date|datetime(3) NOT NULL' ELSE 'created_at|datetime(6) NOT NULL' END",
    "'last_login|timestamp DEFAULT CURRENT_TIMESTAMP'",
    "'is_active|tinyint(1) DEFAULT ''1'''",
    "CASE WHEN p_partkey % 5 = 0 THEN 'row_uuid|char(36) DEFAULT NULL' ELSE 'token|char(32) NOT NULL' END",
    "'props|json DEFAULT NULL'",
    "'best_score|int unsigned DEFAULT NULL'",
    "CASE p_size % 6 WHEN 0 THEN 'qty|smallint unsigned NOT NULL' WHEN 1 THEN 'qty|mediumint DEFAULT NULL' "
    "WHEN 2 THEN 'born|year DEFAULT NULL' WHEN 3 THEN 'opens|time(6) NOT NULL' "
    "WHEN 4 THEN 'payload|longblob' ELSE 'rate|float DEFAULT ''1.5''' END",
    "concat(lower(p_type), '_note|longtext')",
    "'birthday|date DEFAULT NULL'",
    "CASE WHEN p_partkey % 7 = 0 THEN 'flags|set(''a'',''b'') DEFAULT NULL' END",
]


@fixture
def ddl_columns(d: Dialect) -> str:
    """The columns each part's table is declared with; table key columns are marked."""
    slots = d.explode(
        [f"'{i + 1}|' || {s}" for i, s in enumerate(_SLOTS)],
        "slot",
    )
    return f"""
    SELECT table_name, ordinal, column_name, column_def,
           CASE WHEN keys = 'none' THEN 0 WHEN column_name = 'id' THEN 1
                WHEN keys = 'pair' AND column_name = 'object_id' THEN 2 ELSE 0 END AS key_position
    FROM (
      SELECT concat('t_', lower(p_type), '_', CAST(p_partkey AS STRING)) AS table_name,
             CASE WHEN p_partkey % 10 = 9 THEN 'none' WHEN p_partkey % 6 = 1 THEN 'pair' ELSE 'single' END AS keys,
             CAST(split_part(slot, '|', 1) AS INT) AS ordinal,
             split_part(slot, '|', 2) AS column_name, split_part(slot, '|', 3) AS column_def
      FROM part {slots}
      WHERE slot IS NOT NULL) c"""


@fixture
def ddl_texts(d: Dialect) -> str:
    """One table-definition dump per part: warning line, header line, escaped newlines."""
    lines = [
        f"('  \"' || split_part({s}, '|', 1) || '\" ' || split_part({s}, '|', 2))" for s in _SLOTS
    ] + [
        "CASE WHEN p_partkey % 10 = 9 THEN NULL WHEN p_partkey % 6 = 1 "
        "THEN '  PRIMARY KEY (\"id\",\"object_id\")' ELSE '  PRIMARY KEY (\"id\")' END",
        "'  KEY \"idx_phone\" (\"phone_number\")'",
        "'  CONSTRAINT \"chk_props\" CHECK (json_valid(\"props\"))'",
    ]
    body = d.join_texts(lines, "',\\\\n'" if d.name == "spark" else "',\\n'")
    esc = "\\\\n" if d.name == "spark" else "\\n"
    nl, tab = ("'\\n'", "'\\t'") if d.name == "spark" else ("chr(10)", "chr(9)")
    return f"""
    SELECT concat(table_name, '.sql') AS file_name,
           concat('mysql: [Warning] password on the command line', {nl}, 'Table', {tab}, 'Create Table', {nl},
                  table_name, {tab}, 'CREATE TABLE "', table_name, '" ({esc}', {body}, '{esc})') AS text
    FROM (SELECT *, concat('t_', lower(p_type), '_', CAST(p_partkey AS STRING)) AS table_name FROM part) p"""


@fixture
def target_columns(d: Dialect) -> str:
    """A drifted copy of ``ddl_columns`` with the three metadata columns.

    One table in 13 is absent; one in 5 lacks ``discount``; one in 11 has an extra column;
    one in 17 holds ``props`` with another type.
    """
    extra = d.explode(
        [
            "'keep'",
            "CASE WHEN ordinal = 1 THEN '_version|bigint|100' END",
            "CASE WHEN ordinal = 1 THEN '_is_deleted|tinyint|101' END",
            "CASE WHEN ordinal = 1 THEN '_extracted_at|datetime|102' END",
            "CASE WHEN ordinal = 1 AND num % 11 = 0 THEN 'legacy_flag|varchar(8)|103' END",
        ],
        "slot",
    )
    return f"""
    SELECT table_name,
           CASE WHEN slot = 'keep' THEN column_name ELSE split_part(slot, '|', 1) END AS column_name,
           CASE WHEN slot <> 'keep' THEN split_part(slot, '|', 2)
                WHEN num % 17 = 0 AND column_name = 'props' THEN 'varchar(100)' ELSE column_def END AS column_def,
           CASE WHEN slot = 'keep' THEN ordinal ELSE CAST(split_part(slot, '|', 3) AS INT) END AS ordinal,
           CASE WHEN slot = 'keep' THEN key_position ELSE 0 END AS key_position
    FROM (SELECT *, CAST(split_part(table_name, '_', 3) AS INT) AS num FROM ddl_columns) c {extra}
    WHERE slot IS NOT NULL AND num % 13 <> 12
      AND NOT (slot = 'keep' AND column_name = 'discount' AND num % 5 = 0)"""


# --- pipeline metrics --------------------------------------------------------------


@fixture
def log_lines(d: Dialect) -> str:
    return """
    SELECT event_id AS line_no, ts, concat('worker-', CAST(user_id % 12 AS STRING)) AS worker,
           CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'java.lang.OutOfMemoryError: Java heap space'
                WHEN event_type = 'error' AND event_id % 7 = 1 THEN 'Connection refused by broker'
                WHEN event_type = 'error' AND event_id % 7 = 2 THEN 'Insert failed, Code: 1001 from engine'
                WHEN event_type = 'error' AND event_id % 7 = 3 THEN 'WorkerSinkTask orders failed'
                WHEN event_type = 'error' AND event_id % 7 = 4 THEN 'possible deadlock in pool'
                WHEN event_type = 'error' THEN 'java.net.ConnectException: no route'
                WHEN event_type = 'signup' AND event_id % 50 = 0 THEN 'Starting Kafka Connect'
                WHEN event_type = 'signup' THEN concat('Snapshot chunk ', CAST(event_id AS STRING), ' read')
                WHEN event_type = 'purchase' AND event_id % 40 = 0
                  THEN concat('Snapshot ', CAST(event_id AS STRING), ' completed')
                ELSE concat('Committed offsets for user ', CAST(user_id AS STRING)) END AS line
    FROM events"""


@fixture
def offsets(d: Dialect) -> str:
    return """
    SELECT event_type AS topic, user_id % 8 AS part, count(*) AS high_water,
           count(CASE WHEN event_id % 13 <> 0 THEN 1 END) AS committed
    FROM events GROUP BY event_type, user_id % 8"""


@fixture
def samples(d: Dialect) -> str:
    """Hourly readings of the cumulative row count per table (purchases pause every fifth hour)."""
    return """
    SELECT table_name, sample_ts,
           CAST(sum(n) OVER (PARTITION BY table_name ORDER BY sample_ts) AS BIGINT) AS row_total
    FROM (SELECT event_type AS table_name, date_trunc('hour', ts) AS sample_ts,
                 count(CASE WHEN event_type = 'purchase' AND hour(ts) % 5 = 0 THEN NULL ELSE 1 END) AS n
          FROM events GROUP BY event_type, date_trunc('hour', ts)) h"""


@fixture
def access_policy(d: Dialect) -> str:
    """Which regions each analyst may see."""
    users = d.explode(
        ["concat('analyst_', CAST(r_regionkey AS STRING))", "CASE WHEN r_regionkey < 2 THEN 'lead' END"],
        "user_name",
    )
    return f"SELECT user_name, r_regionkey FROM region {users} WHERE user_name IS NOT NULL"


# --- composition -------------------------------------------------------------------

#: A part becomes sixteen columns or a whole table definition: a file of parts is small to read, but long to work on,
#: and the row group that one task reads grows with the table.
PART_FIXTURES = {"ddl_columns", "ddl_texts"}
PARTS_PER_TASK = 20_000

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def _needed(sql: str, d: Dialect, seen: list[str]) -> list[str]:
    for word in dict.fromkeys(_WORD.findall(sql)):
        if word in seen:
            continue
        if word in FIXTURES:
            _needed(FIXTURES[word](d), d, seen)
            seen.append(word)
        elif word in BASE_TABLES:
            seen.append(word)
    return seen


def compose(sql: str, dialect: Dialect, sf_dir: str | None = None, tasks: Mapping[str, int] | None = None) -> str:
    """``sql`` with the fixtures it names as CTEs; base tables too when ``sf_dir`` is given.

    ``tasks`` names base tables whose rows are dealt to so many tasks after reading.
    """
    ctes = []
    for name in _needed(sql, dialect, []):
        if name in FIXTURES:
            ctes.append(f"{name} AS ({FIXTURES[name](dialect)})")
        elif sf_dir is not None:
            hint = f"/*+ REPARTITION({tasks[name]}) */ " if tasks and name in tasks else ""
            ctes.append(f"{name} AS (SELECT {hint}* FROM parquet.`{sf_dir}/{name}.parquet`)")
    if not ctes:
        return sql
    head = ",\n".join(ctes)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def load(spark: SparkSession, sf_dir: str, name: str, tasks: Mapping[str, int] | None = None) -> DataFrame:
    """A fixture or driver table as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return run(spark, f"SELECT * FROM {name}", sf_dir, tasks)


def run(spark: SparkSession, sql: str, sf_dir: str, tasks: Mapping[str, int] | None = None) -> DataFrame:
    """A query over fixtures and driver tables. Where it names the columns of the parts' tables, parts are dealt to tasks."""
    if tasks is None and PART_FIXTURES & set(_needed(sql, SPARK, [])) and (dealt := part_tasks(spark, sf_dir)):
        tasks = {"part": dealt}
    return spark.sql(compose(sql, SPARK, sf_dir, tasks))


def part_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """The tasks that parts are dealt to; None where one task has few enough."""
    parts = load(spark, sf_dir, "part").count()
    return -(-parts // PARTS_PER_TASK) if parts > PARTS_PER_TASK else None
