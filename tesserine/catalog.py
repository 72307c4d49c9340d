"""All queries of the expression and event-state operators, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.numbers import number_text, whole_text
from tesserine.operators import equations as eq
from tesserine.operators import five_state as five
from tesserine.operators import kinematics as kin
from tesserine.operators import seven_state as seven
from tesserine.plans import derived as d
from tesserine.schema import DELAYS_FIVE_MS, FIVE_BUTTONS, FIVE_DECLARED, FIVE_STATES, SEVEN_STATES
from tesserine.sinks import write_line_file
from tesserine.sources.long_text import read_long_text
from tesserine.storage import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- equations ----

_OPERANDS = """
ops AS (SELECT *, CAST(l_quantity AS BIGINT) AS a, (['+','-','*','/','%','//','^'])[l_linenumber] AS sign, CAST(round(l_discount * 100) AS BIGINT) AS b FROM lineitem)"""
_TOKENS = _OPERANDS + """,
docs AS (
  SELECT l_orderkey AS doc_id, string_agg(a || ' ' || sign || ' ' || b, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)
         || CASE WHEN any_value(o_orderstatus) = 'P' THEN ' 1 +' ELSE '' END AS raw
  FROM ops JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey),
toks AS (SELECT doc_id, list_filter(regexp_split_to_array(raw, '[,\\s\\p{Z}]+'), lambda t: t <> '') AS tokens FROM docs)"""
_CHUNKS = """,
chunks AS (SELECT doc_id, i::INTEGER AS eq_idx, tokens[3 * i + 1 : 3 * i + 3] AS c FROM toks, unnest(range(0, CAST(ceil(len(tokens) / 3.0) AS BIGINT))) AS u(i))"""
_PARSED = """,
parsed AS (
  SELECT doc_id, eq_idx, c,
    CASE WHEN len(c) <> 3 THEN 'MalformedEquation' WHEN NOT regexp_matches(c[1], '^[0-9]+$') THEN 'InvalidOperand'
         WHEN c[2] NOT IN ('+','-','*','/','%','//') THEN 'InvalidOperator' WHEN NOT regexp_matches(c[3], '^[0-9]+$') THEN 'InvalidOperand' END AS err_kind,
    CASE WHEN len(c) <> 3 THEN 'expected 3 tokens but got ' || len(c) || ': ''' || array_to_string(c, ' ') || ''''
         WHEN NOT regexp_matches(c[1], '^[0-9]+$') THEN '''' || c[1] || ''' is not a valid number'
         WHEN c[2] NOT IN ('+','-','*','/','%','//') THEN '''' || c[2] || ''' is not a recognized operator'
         WHEN NOT regexp_matches(c[3], '^[0-9]+$') THEN '''' || c[3] || ''' is not a valid number' END AS err_msg
  FROM chunks)"""
_DOCS = _TOKENS + _CHUNKS + _PARSED


@query(f"WITH {_DOCS} SELECT doc_id, len(tokens)::INTEGER AS n_tokens, array_to_string(tokens, '|') AS tokens FROM toks")
def calc_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eq.tokenize(d.documents(spark, sf_dir)).select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens"))


@query(f"WITH {_DOCS} SELECT doc_id, eq_idx, len(c)::INTEGER AS arity, array_to_string(c, ' ') AS chunk FROM parsed")
def calc_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = eq.chunk(eq.tokenize(d.documents(spark, sf_dir)))
    return out.select("doc_id", "eq_idx", F.size("chunk").alias("arity"), F.array_join("chunk", " ").alias("chunk"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eq.parse(eq.chunk(eq.tokenize(d.documents(spark, sf_dir))))


@query(f"WITH {_DOCS} SELECT doc_id, eq_idx, c[1]::DOUBLE AS lhs, c[2] AS op, c[3]::DOUBLE AS rhs FROM parsed WHERE err_kind IS NULL")
def calc_parse_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).filter("err_kind IS NULL").select("doc_id", "eq_idx", "lhs", "op", "rhs")


@query(f"WITH {_DOCS} SELECT doc_id, eq_idx, err_kind, err_msg, 'error: ' || err_msg AS label FROM parsed WHERE err_kind IS NOT NULL")
def calc_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).filter("err_kind IS NOT NULL").select("doc_id", "eq_idx", "err_kind", "err_msg", F.concat(F.lit("error: "), "err_msg").alias("label"))


_VALUE = {
    "+": "a::DOUBLE + b", "-": "a::DOUBLE - b", "*": "a::DOUBLE * b", "/": "CASE WHEN b <> 0 THEN a::DOUBLE / b END",
    "%": "CASE WHEN b <> 0 THEN a::DOUBLE % b::DOUBLE END", "//": "CASE WHEN b <> 0 THEN floor(a::DOUBLE / b) END",
}


def _arithmetic(name: str, sign: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = d.operands(spark, sf_dir).filter(F.col("sign") == sign)
        out = eq.evaluate_columns(rows, F.col("a"), F.col("sign"), F.col("b"))
        return out.select("l_orderkey", "lhs", "rhs", "result", "err_kind")

    run.__name__ = name
    zero = "CASE WHEN b = 0 THEN 'DivisionByZero' END" if sign in ("/", "%", "//") else "NULL::VARCHAR"
    query(f"WITH {_OPERANDS} SELECT l_orderkey, a::DOUBLE AS lhs, b::DOUBLE AS rhs, {_VALUE[sign]} AS result, {zero} AS err_kind FROM ops WHERE sign = '{sign}'")(run)


for _name, _sign in (("calc_add", "+"), ("calc_sub", "-"), ("calc_mul", "*"), ("calc_div", "/"), ("calc_mod", "%"), ("calc_floordiv", "//")):
    _arithmetic(_name, _sign)


@query(f"WITH {_OPERANDS} SELECT sign AS op, count(*) AS n FROM ops WHERE sign IN ('/','%','//') AND b = 0 GROUP BY sign")
def calc_div_by_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.operands(spark, sf_dir)
    return eq.evaluate_columns(rows, F.col("a"), F.col("sign"), F.col("b")).filter("err_kind = 'DivisionByZero'").groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_DOCS}, vals AS (
  SELECT *, c[1]::BIGINT AS a, c[2] AS sign, c[3]::BIGINT AS b FROM parsed WHERE err_kind IS NULL AND c[2] <> '/')
SELECT doc_id, eq_idx, 'error: ' || err_msg || ' = error: ' || err_msg AS line FROM parsed WHERE err_kind IS NOT NULL
UNION ALL
SELECT doc_id, eq_idx, a || ' ' || sign || ' ' || b || ' = ' || CASE WHEN sign IN ('%','//') AND b = 0 THEN 'error: division by zero'
  WHEN sign = '+' THEN (a + b)::VARCHAR WHEN sign = '-' THEN (a - b)::VARCHAR WHEN sign = '*' THEN (a * b)::VARCHAR
  WHEN sign = '%' THEN (a % b)::VARCHAR ELSE floor(a::DOUBLE / b)::BIGINT::VARCHAR END AS line FROM vals""")
def calc_pipeline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all equations but divisions (whose results have fractions: calc_all_lines has them)."""
    rows = eq.evaluate(_parsed(spark, sf_dir)).filter("err_stage = 'parse' OR op <> '/'")
    return eq.render(rows, whole_text).select("doc_id", "eq_idx", "line")


def _number_sql(v: str) -> str:
    """Text of a double as the lines have it: whole numbers without a point, others without an exponent."""
    t = f"({v})::VARCHAR"
    digits = f"replace(regexp_replace(split_part({t}, 'e-', 1), '^-|\\.0$', '', 'g'), '.', '')"
    small = f"CASE WHEN {v} < 0 THEN '-' ELSE '' END || '0.' || repeat('0', split_part({t}, 'e-', 2)::INTEGER - 1) || {digits}"
    return f"CASE WHEN {v} = floor({v}) THEN ({v})::BIGINT::VARCHAR WHEN {t} LIKE '%e-%' THEN {small} ELSE {t} END"


_RESULT = "CASE sign " + " ".join(f"WHEN '{s}' THEN {x}" for s, x in (("+", "a + b"), ("-", "a - b"), ("*", "a * b"), ("/", "a / b"), ("%", "a % b"), ("//", "floor(a / b)"))) + " END"
_LINE = f"""{_number_sql('a')} || ' ' || sign || ' ' || {_number_sql('b')} || ' = ' || CASE WHEN sign IN ('/', '%', '//') AND b = 0 THEN 'error: division by zero' ELSE {_number_sql('r')} END"""


_ALL_LINES = f""", vals AS (SELECT doc_id, eq_idx, c[1]::DOUBLE AS a, c[2] AS sign, c[3]::DOUBLE AS b FROM parsed WHERE err_kind IS NULL),
res AS (SELECT *, CASE WHEN sign IN ('/', '%', '//') AND b = 0 THEN NULL ELSE {_RESULT} END AS r FROM vals)
SELECT doc_id, eq_idx, 'error: ' || err_msg || ' = error: ' || err_msg AS line FROM parsed WHERE err_kind IS NOT NULL
UNION ALL SELECT doc_id, eq_idx, {_LINE} AS line FROM res"""


@query(f"WITH {_DOCS} {_ALL_LINES}")
def calc_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run: lines of all equations, divisions and zero divisors included, with the text of fractions."""
    return eq.run(d.documents(spark, sf_dir)).select("doc_id", "eq_idx", "line")


@query(f"WITH {_DOCS} SELECT doc_id, count(*) AS n_equations, bool_or(err_kind IS NULL) AS any_valid FROM parsed GROUP BY doc_id")
def calc_document_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eq.gate(d.documents(spark, sf_dir))


@query(f"""WITH {_OPERANDS}, vals AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, sign, l_tax AS b FROM ops),
res AS (SELECT *, CASE WHEN sign IN ('/', '%', '//') AND b = 0 THEN NULL ELSE {_RESULT} END AS r FROM vals) SELECT l_orderkey, l_linenumber,
CASE WHEN sign = '^' THEN 'error: ''^'' is not a recognized operator = error: ''^'' is not a recognized operator' ELSE {_LINE} END AS line FROM res""")
def calc_result_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of equations over prices and taxes: text of fractions; operators that aren't known are errors."""
    rows = d.operands(spark, sf_dir)
    out = eq.evaluate_columns(rows, F.col("l_extendedprice"), F.col("sign"), F.col("l_tax"))
    return eq.render(out, number_text).select("l_orderkey", "l_linenumber", "line")


_ONE_TEXT = """,
flat AS (
  SELECT t, row_number() OVER (ORDER BY doc_id, i) - 1 AS k
  FROM (SELECT doc_id, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM toks)),
chunks AS (SELECT 0 AS doc_id, k // 3 AS eq_idx, list(t ORDER BY k) AS c FROM flat GROUP BY k // 3)"""


@query(f"SELECT eq_idx, line FROM (WITH {_TOKENS}{_ONE_TEXT}{_PARSED} {_ALL_LINES})")
def calc_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one text, written to one file and read by many tasks; its half equations move all triples that
    follow."""
    texts = d.documents(spark, sf_dir).orderBy("doc_id").select(F.col("raw").alias("line"), F.lit(True).alias("valid"))
    path = f"{shared_dir(spark)}/long-{uuid.uuid4().hex}.txt"
    write_line_file(texts, path)
    return eq.run_pieces(read_long_text(spark, path, split=1 << 20)).select("eq_idx", "line")


# ---- five-state machine ----

_FIVE_EVENTS = """
presses AS (
  SELECT user_id AS device_id, ts, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'test' WHEN 'view' THEN 'enable' WHEN 'click' THEN 'ready' WHEN 'purchase' THEN 'launch'
         WHEN 'error' THEN CASE WHEN value >= 50 THEN 'cu_cancel' ELSE 'lpu_cancel' END END AS button FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq)::INTEGER AS step FROM presses)"""
_FIVE_NEXT = """CASE WHEN n.button = 'test' AND {s} = 'IDLE' THEN 'CIRCUIT_TESTED' WHEN n.button = 'enable' AND {s} = 'CIRCUIT_TESTED' THEN 'ENABLED'
    WHEN n.button = 'ready' AND {s} = 'ENABLED' THEN 'READY' WHEN n.button = 'launch' AND {s} = 'READY' THEN 'LAUNCHED'
    WHEN n.button = 'lpu_cancel' THEN 'IDLE' WHEN n.button = 'cu_cancel' AND {s} IN ('ENABLED', 'READY') THEN 'IDLE' ELSE {s} END"""
_FIVE = _FIVE_EVENTS + f""",
path(device_id, ts, seq, step, button, state, next_state) AS (
  SELECT device_id, ts, seq, step, button, 'IDLE', {_FIVE_NEXT.format(s="'IDLE'")} FROM numbered n WHERE step = 1
  UNION ALL
  SELECT n.device_id, n.ts, n.seq, n.step, n.button, p.next_state, {_FIVE_NEXT.format(s="p.next_state")}
  FROM path p JOIN numbered n ON n.device_id = p.device_id AND n.step = p.step + 1)"""


def _five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five.trajectory(d.presses(spark, sf_dir))


@query(f"WITH RECURSIVE {_FIVE} SELECT device_id, max(step)::BIGINT AS n_events, arg_max(next_state, step) AS state FROM path GROUP BY device_id")
def five_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five.final_state(d.presses(spark, sf_dir))


@query(f"WITH RECURSIVE {_FIVE} SELECT device_id, ts, seq, step, button, state, next_state FROM path")
def five_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _five(spark, sf_dir)


_ONE_DEVICE = _FIVE.replace("user_id AS device_id", "0::BIGINT AS device_id")


@query(f"WITH RECURSIVE {_ONE_DEVICE} SELECT device_id, ts, seq, step, button, state, next_state FROM path")
def five_hot_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events on one device, its ranges side by side."""
    return five.trajectory(d.presses(spark, sf_dir, one_device=True))


@query(f"""WITH {_FIVE_EVENTS}, s(state) AS (VALUES ('IDLE'), ('CIRCUIT_TESTED'), ('ENABLED'), ('READY'), ('LAUNCHED')),
n AS (SELECT button, count(*) AS presses FROM presses WHERE button IS NOT NULL GROUP BY button)
SELECT s.state, n.button, """ + _FIVE_NEXT.format(s="s.state") + " AS next_state, presses FROM s, n")  # fmt: skip
def five_transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each button that was pressed does in each state, and how often it was pressed."""
    pressed = d.presses(spark, sf_dir).filter("button IS NOT NULL").groupBy("button").agg(F.count(F.lit(1)).alias("presses"))
    pairs = pressed.select("button", "presses", F.explode(F.array(*map(F.lit, FIVE_STATES))).alias("state"))
    return pairs.select("state", "button", five.step(F.col("state"), F.col("button")).alias("next_state"), "presses")


@query(f"""WITH RECURSIVE {_FIVE} SELECT device_id, step, next_state <> 'IDLE' AS lpu_green, next_state IN ('ENABLED', 'READY', 'LAUNCHED') AS lpu_red,
  next_state IN ('READY', 'LAUNCHED') AS cu_red, next_state = 'LAUNCHED' AS cu_green FROM path""")
def five_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _five(spark, sf_dir).select("device_id", "step", *five.lights(F.col("next_state")))


@query(f"""WITH RECURSIVE {_FIVE} SELECT device_id, step, next_state = 'IDLE' AS can_test, next_state = 'CIRCUIT_TESTED' AS can_enable, next_state = 'ENABLED' AS can_ready,
  next_state = 'READY' AS can_launch, next_state <> 'IDLE' AS can_lpu_cancel, next_state IN ('ENABLED', 'READY') AS can_cu_cancel FROM path""")
def five_buttons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _five(spark, sf_dir).select("device_id", "step", *five.buttons(F.col("next_state")))


@query(f"WITH RECURSIVE {_FIVE} SELECT device_id, step, 'STATE:  ' || next_state AS label FROM path")
def five_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _five(spark, sf_dir).select("device_id", "step", five.label(F.col("next_state")).alias("label"))


def _texts(texts: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


_FIVE_LOG = "CASE button " + " ".join(f"WHEN '{b}' THEN {_texts(m)}" for b, m in five.MESSAGES.items()) + " END"


@query(f"""WITH RECURSIVE {_FIVE}, rows AS (SELECT *, {_FIVE_LOG} AS msgs FROM path WHERE state <> next_state)
SELECT device_id, ts, seq, i::INTEGER - 1 AS log_seq, msgs[i] AS msg, '[' || strftime(ts, '%H:%M:%S') || '] ' || msgs[i] AS line FROM rows, unnest(range(1, len(msgs) + 1)) AS u(i)""")
def five_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five.event_log(_five(spark, sf_dir))


@query(f"WITH RECURSIVE {_FIVE} SELECT state, next_state, count(*) AS n FROM path WHERE state <> next_state GROUP BY ALL")
def five_transition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed transitions, counted; one that isn't declared stops the query (see undeclared)."""
    seen = five.transitions(_five(spark, sf_dir))
    wrong = five.undeclared(seen).select("state", "next_state", F.lit(True).alias("wrong"))
    failed = F.raise_error(F.concat(F.lit("undeclared transition: "), "state", F.lit(" to "), "next_state")).cast("long")
    return seen.join(F.broadcast(wrong), ["state", "next_state"], "left").select("state", "next_state", F.when(F.col("wrong"), failed).otherwise(F.col("n")).alias("n"))


@query(f"""WITH RECURSIVE {_FIVE}, seen AS (SELECT state, next_state, count(*) AS n FROM path WHERE state <> next_state GROUP BY ALL),
declared(state, next_state) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, to in FIVE_DECLARED.items() for b in to)})
SELECT seen.*, declared.state IS NOT NULL AS declared FROM seen LEFT JOIN declared USING (state, next_state)""")
def five_adjacency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed transitions with whether they are declared."""
    return five.adjacency(five.transitions(_five(spark, sf_dir)))


def _queue(numbered: str, cols: str, carry: str, start: str, acted: str, waits: str, kind: str) -> str:
    """A recursive query of a machine with delays: each step takes the earliest pending result, if it is due
    by the next press, or that press. Of the arguments, cols names the state's columns, start and carry give
    their first and next values, acted says whether a press has a result, which comes after waits ms."""
    return f"""{numbered},
steps(device_id, step, k, "at", kind, name, pending, {cols}) AS (
  SELECT DISTINCT device_id, 0, 0, NULL::TIMESTAMP, NULL::VARCHAR, NULL::VARCHAR, []::STRUCT(due TIMESTAMP, i INTEGER, name VARCHAR)[], {start} FROM numbered
  UNION ALL
  SELECT device_id, step + 1, CASE WHEN ack THEN k ELSE k + 1 END, CASE WHEN ack THEN pending[1].due ELSE ts END, CASE WHEN ack THEN '{kind}' ELSE 'press' END,
    CASE WHEN ack THEN pending[1].name ELSE input END,
    CASE WHEN ack THEN pending[2:] WHEN {acted} THEN list_sort(list_append(pending, {{'due': ts + to_milliseconds({waits}), 'i': step, 'name': input}})) ELSE pending END, {carry}
  FROM (SELECT p.*, n.* EXCLUDE (device_id, step, seq), len(p.pending) > 0 AND (n.ts IS NULL OR p.pending[1].due <= n.ts) AS ack
        FROM steps p LEFT JOIN numbered n ON n.device_id = p.device_id AND n.step = p.k + 1 WHERE len(p.pending) > 0 OR n.step IS NOT NULL) x)"""


_FIVE_WAITS = "(input = 'test' AND next_state = 'IDLE' OR input = 'ready' AND next_state = 'ENABLED' OR input = 'launch' AND next_state = 'READY')"
_FIVE_TIMED = _queue(
    _FIVE_EVENTS.replace("user_id AS device_id", "0::BIGINT AS device_id").replace("END AS button", "END AS input"), "state, next_state",
    f"""next_state, CASE WHEN ack THEN {_FIVE_NEXT.format(s="next_state").replace("n.button", "pending[1].name")} WHEN input IN ('test', 'ready', 'launch') THEN next_state
      ELSE {_FIVE_NEXT.format(s="next_state").replace("n.button", "input")} END""",
    "'IDLE', 'IDLE'", _FIVE_WAITS, "CASE input WHEN 'test' THEN 600 WHEN 'ready' THEN 400 ELSE 500 END", "ack",
)


@query(f"""WITH RECURSIVE {_FIVE_TIMED} SELECT device_id, step, "at", kind, name, state, next_state FROM steps WHERE step > 0""")
def five_timed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events on one device, with delays: races of acknowledgements."""
    return five.timed(d.presses(spark, sf_dir, one_device=True))


_TIMED_TEXTS = "CASE kind WHEN 'press' THEN CASE " + " ".join(
    f"WHEN name = '{b}' AND state IN ({', '.join(repr(x) for x in froms)}) THEN {_texts(five.MESSAGES[b][:1] if b in DELAYS_FIVE_MS else five.MESSAGES[b])}" for b, (froms, _) in five.MOVES.items()
) + " END ELSE CASE WHEN state <> next_state THEN CASE name " + " ".join(f"WHEN '{b}' THEN {_texts(five.MESSAGES[b][1:])}" for b in DELAYS_FIVE_MS) + " END END END"


@query(f"""WITH RECURSIVE {_FIVE_TIMED}, rows AS (SELECT *, {_TIMED_TEXTS} AS msgs FROM steps WHERE step > 0)
SELECT device_id, step, "at", i::INTEGER - 1 AS log_seq, msgs[i] AS msg, '[' || strftime("at", '%H:%M:%S') || '] ' || msgs[i] AS line FROM rows, unnest(range(1, len(msgs) + 1)) AS u(i)""")
def five_timed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with delays: repeated presses log again while an acknowledgement is pending."""
    return five.timed_log(five_timed_state(spark, sf_dir))


# ---- seven-state machine ----

_SEVEN_NEXT = {
    "state": """CASE WHEN n.input = 'test' AND {s} = 'IDLE' AND {g} THEN CASE WHEN {c} THEN 'TEST_PASS' ELSE 'IDLE' END
      WHEN n.input = 'enable' AND {s} = 'TEST_PASS' THEN 'ENABLED' WHEN n.input = 'ready' AND {s} = 'ENABLED' THEN 'READY'
      WHEN n.input = 'launch' AND {s} = 'READY' THEN 'LAUNCHED' WHEN n.input IN ('lp_cancel', 'cu_cancel') AND {s} IN ('TEST_PASS', 'ENABLED', 'READY') THEN 'IDLE'
      WHEN n.input = 'full_reset' THEN 'IDLE' ELSE {s} END""",
    "igniter": """CASE WHEN n.input = 'igniter' AND {s} = 'IDLE' THEN NOT {g} WHEN n.input = 'full_reset' THEN false
      WHEN n.input IN ('lp_cancel', 'cu_cancel') AND {s} IN ('TEST_PASS', 'ENABLED', 'READY') THEN false ELSE {g} END""",
    "circuit": """CASE WHEN n.input = 'circuit' THEN n.arg WHEN n.input = 'full_reset' THEN true
      WHEN n.input IN ('lp_cancel', 'cu_cancel') AND {s} IN ('TEST_PASS', 'ENABLED', 'READY') THEN true ELSE {c} END""",
}
_FIRST = {"s": "'IDLE'", "g": "false", "c": "true"}
_LATER = {"s": "p.next_state", "g": "p.next_igniter", "c": "p.next_circuit"}
_SEVEN = f"""
inputs AS (
  SELECT user_id AS device_id, ts, event_id AS seq, CASE event_type
      WHEN 'signup' THEN CASE WHEN event_id % 8 < 5 THEN 'test' ELSE 'igniter' END WHEN 'view' THEN CASE WHEN event_id % 8 < 6 THEN 'enable' ELSE 'igniter' END
      WHEN 'click' THEN 'ready' WHEN 'purchase' THEN 'launch'
      WHEN 'error' THEN (['lp_cancel','cu_cancel','circuit','circuit','igniter','igniter','circuit','full_reset'])[event_id % 8 + 1] END AS input,
    CASE WHEN event_type = 'error' AND event_id % 8 IN (2, 3, 6) THEN event_id % 8 <> 2 END AS arg FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, seq)::INTEGER AS step FROM inputs),
path(device_id, ts, seq, step, input, arg, state, igniter, circuit, next_state, next_igniter, next_circuit) AS (
  SELECT device_id, ts, seq, step, input, arg, 'IDLE', false, true, {", ".join(x.format(**_FIRST) for x in _SEVEN_NEXT.values())} FROM numbered n WHERE step = 1
  UNION ALL
  SELECT n.device_id, n.ts, n.seq, n.step, n.input, n.arg, p.next_state, p.next_igniter, p.next_circuit, {", ".join(x.format(**_LATER) for x in _SEVEN_NEXT.values())}
  FROM path p JOIN numbered n ON n.device_id = p.device_id AND n.step = p.step + 1)"""


def _seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seven.trajectory(d.inputs(spark, sf_dir))


@query(f"WITH RECURSIVE {_SEVEN} SELECT device_id, count(*) AS n_events, arg_max(next_state, step) AS state, arg_max(next_igniter, step) AS igniter, arg_max(next_circuit, step) AS circuit FROM path GROUP BY device_id")
def seven_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seven.final_state(d.inputs(spark, sf_dir))


@query(f"WITH RECURSIVE {_SEVEN} SELECT * REPLACE (arg::VARCHAR AS arg) FROM path")
def seven_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seven(spark, sf_dir).withColumn("arg", F.col("arg").cast("string"))


_SEVEN_LOG = "CASE " + " ".join(
    f"WHEN input = '{name}' AND ({condition}) THEN [" + ", ".join(f"{{'level': '{a}', 'msg': '{b}'}}" for a, b in texts) + "]" for name, condition, texts in seven.LOG_RULES
) + " END"
_LEVELS = "CASE level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in seven.LEVEL_COLOR.items()) + f" ELSE '{seven.LEVEL_COLOR['INFO']}' END"


@query(f"""WITH RECURSIVE {_SEVEN}, rows AS (SELECT *, {_SEVEN_LOG} AS msgs FROM path),
log AS (SELECT device_id, ts, seq, i::INTEGER - 1 AS log_seq, msgs[i].level AS level, msgs[i].msg AS msg FROM rows, unnest(range(1, len(msgs) + 1)) AS u(i))
SELECT *, {_LEVELS} AS color, '[' || strftime(ts, '%H:%M:%S') || ']  ' || msg AS line FROM log""")
def seven_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seven.event_log(_seven(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SEVEN} SELECT device_id, step, next_state = 'IDLE' AS can_igniter, next_state = 'IDLE' AND next_igniter AS can_test, next_state = 'TEST_PASS' AS can_enable,
  next_state = 'ENABLED' AS can_ready, next_state = 'READY' AS can_launch, next_state IN ('TESTING', 'TEST_PASS', 'ENABLED', 'READY') AS can_lp_cancel,
  next_state IN ('TESTING', 'TEST_PASS', 'ENABLED', 'READY') AS can_cu_cancel FROM path""")
def seven_buttons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seven(spark, sf_dir).select("device_id", "step", *seven.buttons(F.col("next_state"), F.col("next_igniter")))


_BANNERS = ", ".join(f"('{s}', '{seven.DISPLAY[s]}', '{b[0]}', '{b[1]}', '{b[2]}')" for s, b in seven.BANNER.items())


@query(f"""WITH RECURSIVE {_SEVEN}, dim(state, shown, bg, fg, hint) AS (VALUES {_BANNERS})
SELECT device_id, step, coalesce(bg, '{seven.DEFAULT_BANNER[0]}') AS bg, coalesce(fg, '{seven.DEFAULT_BANNER[1]}') AS fg, coalesce('STATE: ' || upper(shown) || '   —   ' || hint, next_state) AS text
FROM path LEFT JOIN dim ON dim.state = next_state""")
def seven_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seven(spark, sf_dir).select("device_id", "step", *seven.banner(F.col("next_state")))


@query(f"""WITH RECURSIVE {_SEVEN}, rows AS (SELECT unnest({_SEVEN_LOG}) AS r FROM path), log AS (SELECT r.level AS level FROM rows)
SELECT level, {_LEVELS} AS color, count(*) AS n FROM log GROUP BY ALL""")
def seven_log_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seven.event_log(_seven(spark, sf_dir)).groupBy("level", "color").agg(F.count(F.lit(1)).alias("n"))


_SEVEN_INPUTS = _SEVEN[: _SEVEN.index(",\npath(")]
_CANCELS = "(input IN ('lp_cancel', 'cu_cancel') AND next_state IN ('TESTING', 'TEST_PASS', 'ENABLED', 'READY') OR input = 'full_reset')"
_SEVEN_TIMED = _queue(
    _SEVEN_INPUTS, "state, was_igniter, was_circuit, next_state, igniter, circuit",
    f"""next_state, igniter, circuit,
    CASE WHEN ack THEN CASE WHEN pending[1].name = 'test' AND next_state = 'TESTING' THEN CASE WHEN circuit THEN 'TEST_PASS' ELSE 'IDLE' END
           WHEN pending[1].name = 'launch' AND next_state = 'LAUNCHING' THEN 'LAUNCHED' ELSE next_state END
         WHEN input = 'test' AND next_state = 'IDLE' AND igniter THEN 'TESTING' WHEN input = 'enable' AND next_state = 'TEST_PASS' THEN 'ENABLED'
         WHEN input = 'ready' AND next_state = 'ENABLED' THEN 'READY' WHEN input = 'launch' AND next_state = 'READY' THEN 'LAUNCHING' WHEN {_CANCELS} THEN 'IDLE' ELSE next_state END,
    CASE WHEN ack THEN igniter WHEN input = 'igniter' AND next_state = 'IDLE' THEN NOT igniter WHEN {_CANCELS} THEN false ELSE igniter END,
    CASE WHEN ack THEN circuit WHEN input = 'circuit' THEN coalesce(arg, false) WHEN {_CANCELS} THEN true ELSE circuit END""",
    "'IDLE', false, true, 'IDLE', false, true", "(input = 'test' AND next_state = 'IDLE' AND igniter OR input = 'launch' AND next_state = 'READY')",
    "CASE input WHEN 'test' THEN 1400 ELSE 2200 END", "result",
)
_SEVEN_TIMED_LOG = "CASE " + " ".join(
    f"WHEN kind = '{kind}' AND name = '{name}' AND ({condition}) THEN [" + ", ".join(f"{{'level': '{a}', 'msg': '{b}'}}" for a, b in texts) + "]" for kind, name, condition, texts in seven.TIMED_LOG_RULES
) + " END"


@query(f"""WITH RECURSIVE {_SEVEN_TIMED} SELECT device_id, step, "at", kind, name, state, next_state, igniter, circuit FROM steps WHERE step > 0""")
def seven_timed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seven.timed(d.inputs(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SEVEN_TIMED}, befores AS (SELECT t.* REPLACE (t.was_igniter AS igniter, t.was_circuit AS circuit), n.arg FROM steps t LEFT JOIN numbered n ON n.device_id = t.device_id AND n.step = t.k WHERE t.step > 0),
rows AS (SELECT *, {_SEVEN_TIMED_LOG} AS msgs FROM befores),
log AS (SELECT device_id, step, "at", i::INTEGER - 1 AS log_seq, msgs[i].level AS level, msgs[i].msg AS msg FROM rows, unnest(range(1, len(msgs) + 1)) AS u(i))
SELECT *, {_LEVELS} AS color, '[' || strftime("at", '%H:%M:%S') || ']  ' || msg AS line FROM log""")
def seven_timed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with delays: results log when they come due."""
    return seven.timed_log(d.inputs(spark, sf_dir))


@query(f"""WITH first AS (SELECT user_id AS device_id, min(ts) AS ts FROM events GROUP BY user_id)
SELECT device_id, ts, '{seven.START_LOG[0]}' AS level, '{seven.START_LOG[1]}' AS msg, '{seven.LEVEL_COLOR[seven.START_LOG[0]]}' AS color, '[' || strftime(ts, '%H:%M:%S') || ']  {seven.START_LOG[1]}' AS line FROM first""")
def seven_start_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seven.start_log(d.inputs(spark, sf_dir))


# Fixed values, written out once more: colours of wire, lamps and their outlines.
_K = "CASE next_state WHEN 'IDLE' THEN 0 WHEN 'TESTING' THEN 1 WHEN 'TEST_PASS' THEN 2 WHEN 'ENABLED' THEN 3 WHEN 'READY' THEN 4 WHEN 'LAUNCHING' THEN 5 ELSE 6 END"


@query(f"""WITH RECURSIVE {_SEVEN_TIMED}, k AS (SELECT *, {_K} AS k2 FROM steps WHERE step > 0)
SELECT device_id, step, next_state, igniter, CASE WHEN NOT igniter OR k2 = 6 THEN NULL WHEN k2 BETWEEN 2 AND 5 THEN '#00ff44' ELSE '#ffdd00' END AS wire,
  k2 = 5 AS flame, k2 >= 2 AS lpu_green, k2 >= 3 AS lpu_red, k2 >= 4 AS cu_red, k2 >= 6 AS cu_green FROM k""")
def seven_wire_flame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire, flame and lights after each row of the timed machine."""
    state, igniter = F.col("next_state"), F.col("igniter")
    return seven.timed(d.inputs(spark, sf_dir)).select("device_id", "step", state, igniter, seven.wire(state, igniter).alias("wire"), seven.flame(state).alias("flame"), *seven.lights(state))


@query(f"""WITH RECURSIVE {_SEVEN_TIMED}, k AS (SELECT *, {_K} AS k2 FROM steps WHERE step > 0),
lit AS (SELECT device_id, step, unnest(['lpu_green', 'lpu_red', 'cu_red', 'cu_green']) AS light, unnest([k2 >= 2, k2 >= 3, k2 >= 4, k2 >= 6]) AS lit FROM k)
SELECT device_id, step, light, CASE WHEN NOT lit THEN '#1a1a1a' WHEN light LIKE '%green' THEN '#00ff55' ELSE '#ff3333' END AS fill,
  CASE WHEN NOT lit THEN '#444444' WHEN light LIKE '%green' THEN '#004422' ELSE '#550000' END AS outline FROM lit""")
def seven_lamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of the four lamps after each row of the timed machine."""
    return seven.lamps(seven.timed(d.inputs(spark, sf_dir)))


# ---- motion ----

_FRAMES = """
frames(frame, vel, y) AS (SELECT 1, 0.0::DOUBLE + 0.4::DOUBLE, 220.0::DOUBLE - (0.0::DOUBLE + 0.4::DOUBLE)
  UNION ALL SELECT frame + 1, vel + 0.4::DOUBLE, y - (vel + 0.4::DOUBLE) FROM frames WHERE y >= -150)"""


@query(f"""WITH RECURSIVE {_FIVE}, {_FRAMES},
edges AS (SELECT *, lead(ts) OVER (PARTITION BY device_id ORDER BY step) AS end_ts FROM path WHERE (state = 'LAUNCHED') <> (next_state = 'LAUNCHED')),
starts AS (SELECT device_id, (row_number() OVER (PARTITION BY device_id ORDER BY step))::INTEGER AS launch_id, ts, end_ts FROM edges WHERE next_state = 'LAUNCHED')
SELECT device_id, launch_id, frame, frame * 40 AS t_ms, vel, y, y >= -150 AS flame_on, true AS launched
FROM starts, frames WHERE end_ts IS NULL OR frame * 40 <= epoch_ms(end_ts) - epoch_ms(ts)""")
def kin_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kin.motion(kin.launches(_five(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_FIVE}, {_FRAMES},
edges AS (SELECT *, lead(ts) OVER (PARTITION BY device_id ORDER BY step) AS end_ts FROM path WHERE (state = 'LAUNCHED') <> (next_state = 'LAUNCHED')),
starts AS (SELECT device_id, (row_number() OVER (PARTITION BY device_id ORDER BY step))::INTEGER AS launch_id, ts, end_ts FROM edges WHERE next_state = 'LAUNCHED')
SELECT device_id, launch_id, max(frame) AS frame, max(frame) * 40 AS t_ms, max(vel) AS vel, min(y) AS y, min(y) < -150 AS stopped
FROM starts, frames WHERE end_ts IS NULL OR frame * 40 <= epoch_ms(end_ts) - epoch_ms(ts) GROUP BY device_id, launch_id""")
def kin_stop_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last frame of each launch, and whether it is the one at which motion stops by itself."""
    return kin.last_frames(kin.motion(kin.launches(_five(spark, sf_dir))))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
def log_time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("clock"))
