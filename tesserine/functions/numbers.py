"""Number text: the accepted grammar, and text without exponents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the grammar of number literals (sign, infinities, nan in any case, digits, exponent).
NUMBER = r"^[+-]?(?:(?i:inf|infinity|nan)|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\z"


def parse_number(text: Column) -> Column:
    """DOUBLE, or null where the text isn't a number literal. Spark's own cast takes more (`1d`, blanks)
    and less (`+nan`) than the grammar, so the grammar decides first."""
    unsigned = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    infinite = F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    special = F.when(unsigned == "nan", F.lit(float("nan"))).when(unsigned.isin("inf", "infinity"), infinite)
    return F.when(text.rlike(NUMBER), F.coalesce(special, text.try_cast("double")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once and not wherever `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shortest(value: Column) -> Column:
    """`d.ddde+xx` with the fewest digits that read back as the value: 15 digits hold all shorter ones, but for the very
    small, whose doubles are so far apart that fewer may do."""
    exact = lambda text: text.cast("double") == value

    def last(text: Column) -> Column:
        # 17 digits that need not be the nearest ones: cutting the last can be right, up or down, where rounding isn't
        whole, power = F.regexp_replace(F.substring_index(text, "e", 1), r"[-.]", "").cast("long"), F.concat(F.lit("e"), F.substring_index(text, "e", -1))
        cut = [F.concat(F.when(value < 0, "-").otherwise(""), F.regexp_replace((F.call_function("div", whole, F.lit(10)) + k).cast("string"), r"^(.)", "$1."), power) for k in (0, 1)]
        return F.when(exact(cut[0]), cut[0]).when(exact(cut[1]), cut[1]).otherwise(text)

    longest = _once(F.format_string("%.16e", value), last)
    longer = _once(F.format_string("%.15e", value), lambda t: F.when(exact(t), t).otherwise(longest))
    few = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda n: F.call_function("format_string", F.concat(F.lit("%."), n.cast("string"), F.lit("e")), value))
    usual = _once(F.format_string("%.14e", value), lambda t: F.when(exact(t), t).otherwise(longer))
    return F.when(F.abs(value) < 1e-290, F.coalesce(F.get(F.filter(few, exact), F.lit(0)), longest)).otherwise(usual)


def _moved_point(text: Column) -> Column:
    """`d.ddde+xx` without an exponent, for values with a fraction."""
    exponent = F.substring_index(text, "e", -1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(text, "e", 1), r"[-.]", ""), r"0+$", "")
    plain = F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
    plain = plain.otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(20))))
    return F.concat(F.when(text.startswith("-"), "-").otherwise(""), plain)


def fraction_text(value: Column) -> Column:
    """Text of values that aren't whole: shortest digits without an exponent, `inf`, `-inf` or `NaN`."""

    def text(v: Column) -> Column:
        special = F.when(F.isnan(v), "NaN").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
        # the usual text always reads back; where it has 15 digits at most, there is no shorter one
        return special.otherwise(_once(v.cast("string"), lambda t: F.when((F.length(t) <= 16) & ~F.contains(t, F.lit("E")), t).otherwise(_once(_shortest(v), _moved_point))))

    return _once(value, text)


def is_whole(value: Column) -> Column:
    """Finite, and without a fraction. From 2**53 on every double is whole."""
    size = F.abs(value)
    return ~F.isnan(value) & (size < F.lit(float("inf"))) & ((size >= 9007199254740992.0) | (F.when(size < 9007199254740992.0, F.floor(value)).cast("double") == value))


def number_text(value: Column) -> Column:
    """Whole numbers as saturated 64-bit integers, others as the shortest digits without an exponent."""
    whole = (
        F.when(value >= 9223372036854775807.0, "9223372036854775807")
        .when(value <= -9223372036854775808.0, "-9223372036854775808")
        .otherwise(value.try_cast("long").cast("string"))
    )
    return F.when(value.isNull(), F.lit(None)).when(is_whole(value), whole).otherwise(fraction_text(value))


def whole_text(value: Column) -> Column:
    """number_text for values known to be whole: stays in the JVM."""
    return value.try_cast("long").cast("string")


def floor_divide(lhs: Column, rhs: Column) -> Column:
    """floor of the quotient as DOUBLE; the cast to LONG that Spark's floor makes is kept from huge values."""
    q = F.try_divide(lhs, rhs)
    return F.when(F.abs(q) < 9007199254740992.0, F.floor(q).cast("double")).otherwise(q)
