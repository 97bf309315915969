"""Trial parameter text -> typed values.

Search backends store every parameter as text; the typed view is a struct
of (kind, bool, long, double, long list, double list) built from JVM
expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_RX = r"^-?[0-9]+$"
FLOAT_RX = r"^-?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][-+]?[0-9]+)?$"
INT_LIST_RX = r"^\[\s*(-?[0-9]+\s*(,\s*-?[0-9]+\s*)*)?\]$"


def typed_value(text: Column) -> Column:
    """``None`` -> null kind, ``True``/``False`` -> bool, integers, floats,
    ``[1, 2]`` -> long list, other bracketed lists -> double list, else text."""
    t = F.trim(text)
    inner = F.regexp_replace(t, r"^\[|\]$", "")
    items = F.filter(F.split(inner, r"\s*,\s*"), lambda s: F.length(F.trim(s)) > 0)
    kind = (F.when(t.isNull() | (t == "None"), "null")
            .when(t.isin("True", "False"), "bool")
            .when(t.rlike(INT_RX), "int")
            .when(t.rlike(FLOAT_RX), "float")
            .when(t.rlike(INT_LIST_RX), "int_list")
            .when(t.startswith("[") & t.endswith("]"), "float_list")
            .otherwise("text"))
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "bool", t == "True").alias("bool_value"),
        F.when(kind == "int", t.try_cast("bigint")).alias("int_value"),
        F.when(kind.isin("int", "float"), t.try_cast("double")).alias("float_value"),
        F.when(kind == "int_list", F.transform(items, lambda s: F.trim(s).try_cast("bigint"))).alias("int_list"),
        F.when(kind == "float_list", F.transform(items, lambda s: F.trim(s).try_cast("double"))).alias("float_list"),
    )
