"""Equations in text: tokens, triples, evaluation with errors as data, result lines.

Every step is a DataFrame -> DataFrame function of narrow expressions; only the order of lines at the
sink shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.numbers import floor_divide, number_text, parse_number
from tesserine.schema import OPERATORS

#: Commas count as white space, in the Unicode sense.
SEPARATOR = r"[,\p{IsWhite_Space}]+"


def tokenize(docs: DataFrame) -> DataFrame:
    """docs(doc_id, raw) + tokens; null text has none."""
    return docs.withColumn("tokens", F.filter(F.split(F.coalesce("raw", F.lit("")), SEPARATOR), lambda t: t != ""))


def chunk(docs: DataFrame, outer: bool = False) -> DataFrame:
    """docs(doc_id, tokens) -> doc_id, eq_idx, chunk: three tokens each, the last may be shorter. With
    `outer`, documents without tokens give one row with nulls."""
    n = F.ceil(F.size("tokens") / 3).cast("int")
    triples = F.when(F.size("tokens") > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("tokens", i * 3 + 1, F.lit(3))))
    explode = F.posexplode_outer if outer else F.posexplode
    return docs.select("doc_id", explode(triples).alias("eq_idx", "chunk"))


def parse(chunks: DataFrame) -> DataFrame:
    """Adds lhs, op, rhs, err_kind, err_msg. The first fault counts: arity, left operand, operator, right."""
    size, at = F.size("chunk"), lambda i: F.get("chunk", F.lit(i))
    bad_number = lambda t: F.concat(F.lit("'"), t, F.lit("' is not a valid number"))
    # operands in one array, which the optimizer builds once a row
    chunks = chunks.withColumn("_n", F.transform(F.array(at(0), at(2)), parse_number))
    lhs, rhs = F.get("_n", F.lit(0)), F.get("_n", F.lit(1))
    kinds = [
        (size != 3, "MalformedEquation", F.concat(F.lit("expected 3 tokens but got "), size, F.lit(": '"), F.array_join("chunk", " "), F.lit("'"))),
        (lhs.isNull(), "InvalidOperand", bad_number(at(0))),
        (~at(1).isin(*OPERATORS), "InvalidOperator", F.concat(F.lit("'"), at(1), F.lit("' is not a recognized operator"))),
        (rhs.isNull(), "InvalidOperand", bad_number(at(2))),
    ]
    kind = msg = F.when(F.col("chunk").isNull(), F.lit(None).cast("string"))
    for fails, name, text in kinds:
        kind, msg = kind.when(fails, F.lit(name)), msg.when(fails, text)
    out = chunks.withColumn("err_kind", kind).withColumn("err_msg", msg)
    ok = F.col("err_kind").isNull() & F.col("chunk").isNotNull()
    return out.withColumn("lhs", F.when(ok, lhs)).withColumn("op", F.when(ok, at(1))).withColumn("rhs", F.when(ok, rhs)).drop("_n")


def evaluate(parsed: DataFrame) -> DataFrame:
    """Adds result, err_stage; division, remainder and floor division by zero are errors of the row."""
    lhs, op, rhs = F.col("lhs"), F.col("op"), F.col("rhs")
    by_zero = F.coalesce(op.isin("/", "%", "//") & (rhs == 0), F.lit(False))
    value = F.when(by_zero, F.lit(None).cast("double"))
    for name, x in (("+", lhs + rhs), ("-", lhs - rhs), ("*", lhs * rhs), ("/", F.try_divide(lhs, rhs)), ("%", F.try_mod(lhs, rhs)), ("//", floor_divide(lhs, rhs))):
        value = value.when(op == name, x)
    return (
        parsed.withColumn("result", value)
        .withColumn("err_stage", F.when(F.col("err_kind").isNotNull(), "parse").when(by_zero, "eval"))
        .withColumn("err_msg", F.when(by_zero, "division by zero").otherwise(F.col("err_msg")))
        .withColumn("err_kind", F.when(by_zero, "DivisionByZero").otherwise(F.col("err_kind")))
    )


def equation_text(text=number_text) -> Column:
    return F.concat_ws(" ", text(F.col("lhs")), F.col("op"), text(F.col("rhs")))


def render(evaluated: DataFrame, text=number_text) -> DataFrame:
    """Adds line. A parse error stands on both sides of the sign; a zero divisor on the right."""
    error = F.concat(F.lit("error: "), F.col("err_msg"))
    left = F.when(F.col("err_stage") == "parse", error).otherwise(equation_text(text))
    right = F.when(F.col("err_stage").isNotNull(), error).otherwise(text(F.col("result")))
    return evaluated.withColumn("line", F.concat(left, F.lit(" = "), right))


def run(docs: DataFrame, text=number_text) -> DataFrame:
    """docs(doc_id, raw) -> one row an equation, with its line."""
    return docs.transform(tokenize).transform(chunk).transform(parse).transform(evaluate).transform(lambda d: render(d, text))


def run_pieces(pieces: DataFrame, text=number_text) -> DataFrame:
    """Pieces of one text (`long_text.read_long_text`) -> the rows that `run` gives for the whole text, in order, without
    doc_id; eq_idx is long."""
    numbered = chunk(tokenize(pieces)).select((F.col("doc_id") + F.col("eq_idx")).alias("eq_idx"), "chunk")
    return render(evaluate(parse(numbered)), text)


def gate(docs: DataFrame) -> DataFrame:
    """doc_id, n_equations, any_valid: a document without one equation that parses fails."""
    parsed = docs.transform(tokenize).transform(lambda d: chunk(d, outer=True)).transform(parse)
    return parsed.groupBy("doc_id").agg(F.count("chunk").alias("n_equations"), F.coalesce(F.bool_or(F.col("chunk").isNotNull() & F.col("err_kind").isNull()), F.lit(False)).alias("any_valid"))


def evaluate_columns(rows: DataFrame, lhs: Column, op: Column, rhs: Column) -> DataFrame:
    """The same semantics for operands that are columns already; an operator that isn't known is an error of the row."""
    typed = rows.withColumn("lhs", lhs.cast("double")).withColumn("op", op).withColumn("rhs", rhs.cast("double"))
    unknown = ~F.col("op").isin(*OPERATORS)
    message = F.concat(F.lit("'"), F.col("op"), F.lit("' is not a recognized operator"))
    return evaluate(typed.withColumn("err_kind", F.when(unknown, "InvalidOperator")).withColumn("err_msg", F.when(unknown, message)))
