"""What the repr of a value tells: abstract value, type name, output category."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The abstract domain.
ZERO, POSITIVE, NEGATIVE, NULL, NON_NULL = "ZERO", "POSITIVE", "NEGATIVE", "NULL", "NON_NULL"
EMPTY, SINGLETON, MULTI = "EMPTY_COLLECTION", "SINGLETON", "MULTI_ELEMENT"
EXCEPTION, NORMAL, ABSENT, UNKNOWN = "EXCEPTION_STATE", "NORMAL", "ABSENT", "UNKNOWN"
#: Type names and the patterns that tell them, first match wins.
TYPES = (
    ("int", r"^-?\d+$"),
    ("float", r"^-?\d+\.\d"),
    ("bool", r"^(True|False)$"),
    ("NoneType", r"^None$"),
    ("str", r"""^'.*'$|^".*"$"""),
    ("list", r"^\["),
    ("dict", r"^\{"),
    ("set", r"^set\(\)"),
    ("tuple", r"^\("),
    ("bytes", r"^b'"),
)
#: Names of variables that hold resources.
RESOURCE = r"(?i)^(f$|file|fp$|fd|fh$|lock|mutex|conn|socket|handle|resource)"
OPENING, CLOSING = ("(", "[", "{"), (")", "]", "}")


def elements(r: Column) -> Column:
    """Elements of a bracketed repr: commas outside inner brackets of any depth, plus one; 0 for an empty one."""
    inner = F.trim(F.substring(r, 2, 1 << 30).substr(F.lit(1), F.greatest(F.lit(0), F.length(r) - 2)))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("commas"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c.isin(*OPENING), 1).when(c.isin(*CLOSING), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (acc["commas"] + ((c == ",") & (acc["depth"] == 0)).cast("int")).alias("commas"))

    commas = F.aggregate(F.split(inner, ""), start, step, lambda acc: acc["commas"])
    return F.when(inner == "", 0).otherwise(commas + 1)


def abstract_value(value: Column) -> Column:
    """One of the twelve labels of the abstract domain."""
    r = F.trim(value)
    number = r.try_cast("double")
    sign = F.when(number == 0, ZERO).when(number > 0, POSITIVE).otherwise(NEGATIVE)
    sized = F.when(elements(r) == 0, EMPTY).when(elements(r) == 1, SINGLETON).otherwise(MULTI)
    return (
        F.when(r == "None", NULL).when(r == "True", POSITIVE).when(r == "False", ZERO)
        .when(r.rlike(r"^-?\d+$"), sign)
        .when(r.rlike(r"^-?\d+\.\d") & number.isNotNull(), sign)
        .when(r.isin("''", '""'), EMPTY)
        .when(r.rlike(r"""^'.*'$|^".*"$"""), NON_NULL)
        .when(r.rlike("^b'"), F.when(F.length(r) > 3, NON_NULL).otherwise(EMPTY))
        .when(r.rlike(r"^[\[({]"), sized)
        .when(r.rlike(r"^<|^[A-Za-z_][A-Za-z0-9_.]*\("), NON_NULL)
        .otherwise(UNKNOWN)
    )


def type_name(value: Column) -> Column:
    """Type by the first pattern that matches, else the class named in front of a bracket, else unknown."""
    r = F.trim(value)
    chain = F.when(F.lit(False), "")
    for name, pattern in TYPES:
        chain = chain.when(r.rlike(pattern), name)
    called, angled = F.regexp_extract(r, r"^([A-Za-z_][A-Za-z0-9_.]*)\(", 1), F.regexp_extract(r, r"^<([A-Za-z_][A-Za-z0-9_.]+)", 1)
    return chain.when(called != "", called).when(angled != "", angled).otherwise("unknown")


def output_category(value: Column, exception: Column) -> Column:
    """Category of a call's output, from its repr; an exception comes first."""
    r, kind = F.trim(value), type_name(value)
    number = r.try_cast("double")
    signed = F.when(number == 0, "zero").when(number > 0, "positive_int").otherwise("negative_int")
    return (
        F.when(exception.isNotNull(), "exception").when(r.isin("None", "True", "False"), r)
        .when(kind.isin("int", "float"), signed)
        .when(kind == "str", F.when(F.length(r) == 2, "empty_str").otherwise("nonempty_str"))
        .otherwise(kind)
    )


def exception_class(message: Column) -> Column:
    """The class in front of an exception's message."""
    return F.trim(F.split_part(message, F.lit(":"), F.lit(1)))


def is_resource(name: Column) -> Column:
    return name.rlike(RESOURCE)
