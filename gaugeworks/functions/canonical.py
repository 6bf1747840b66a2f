"""Canonical JSON of any record as one column expression: the same text, and so the same identity, however the record's
fields are ordered. Keys ascend by their UTF-16 code units, numbers have the shortest form that reads back, and only what
must be escaped is, as RFC 8785 has it.

Of two numbers with the fewest digits that read back, older Java may give the farther one (about one in 500 large ones).
Null is null; NaN and infinities have no form, and a record that holds one has a null text. Decimals count as doubles;
dates, times and binary values as their strings (binary in base 64).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The short escapes; other control characters become \u00xx.
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}


def quoted(text: Column) -> Column:
    """A JSON string."""

    def escaped(c: Column) -> Column:
        out = F.when(c < " ", F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c)
        for sign, short in SHORT.items():
            out = F.when(c == sign, F.lit(short)).otherwise(out)
        return out

    by_sign = F.array_join(F.transform(F.split(text, ""), escaped), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), by_sign).otherwise(text), F.lit('"'))


def let(value: Column, then) -> Column:
    """then(value) with the value computed once, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def number(x: Column) -> Column:
    """The shortest digits of a double that read back, laid out as ECMAScript does: no exponent from 1e-6 up to 1e21."""

    def laid_out(d: Column) -> Column:
        digits, n = d["digits"], d["n"]  # n: places before the point
        k, rest = F.length(digits), F.substring(digits, 2, 400)
        exponent = F.concat(F.substring(digits, 1, 1), F.when(k > 1, F.concat(F.lit("."), rest)).otherwise(""), F.when(n > 0, "e+").otherwise("e-"), F.abs(n - 1).cast("string"))
        plain = F.when(k <= n, F.rpad(digits, n, "0")).when(n > 0, F.concat(F.substring(digits, F.lit(1), n), F.lit("."), F.substring(digits, n + 1, F.lit(400)))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), digits))
        return F.when((n > 21) | (n <= -6), exponent).otherwise(plain)

    def places(p: Column) -> Column:
        left, power = F.substring_index(p["whole"], ".", 1), F.coalesce(p["power"].cast("int"), F.lit(0))
        run = F.concat(left, F.when(F.contains(p["whole"], F.lit(".")), F.substring_index(p["whole"], ".", -1)).otherwise(""))
        digits = F.ltrim(F.rtrim(run, F.lit("0")), F.lit("0"))
        return F.struct(digits.alias("digits"), (F.length(left) + power - F.length(run) + F.length(F.ltrim(run, F.lit("0")))).alias("n"))

    size = F.abs(x)
    # Older Java may write a digit more than is needed: fewer are taken where they read back.
    text = size.cast("string")
    for digits, may in ((16, F.length(text) > 16), (15, F.length(text) > 16), (14, F.length(text) > 16), (0, size < 1e-300)):
        shorter = F.format_string(f"%.{digits}e", size)
        text = F.when(may & (shorter.cast("double") == size), shorter).otherwise(text)
    parts = let(F.split(text, "[eE]"), lambda p: F.struct(F.get(p, F.lit(0)).alias("whole"), F.get(p, F.lit(1)).alias("power")))
    form = let(let(parts, places), laid_out)
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(x == 0, F.lit("0")).when(finite, F.concat(F.when(x < 0, "-").otherwise(""), form))


def _listed(items: Column, open_: str, close: str) -> Column:
    """An item without a form leaves the whole without one."""
    return F.when(~F.exists(items, lambda i: i.isNull()), F.concat(F.lit(open_), F.array_join(items, ","), F.lit(close)))


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """The canonical text of a column of this type."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        items = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical_json(c.getField(f.name), f.dataType)) for f in fields]
        text = _listed(F.array(*items), "{", "}") if items else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        text = _listed(F.transform(c, lambda x: canonical_json(x, kind.elementType)), "[", "]")
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(F.encode(e["key"].cast("string"), "UTF-16BE").alias("at"), e["key"].cast("string").alias("key"), e["value"].alias("value")))
        text = _listed(F.transform(F.array_sort(pairs, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType))), "{", "}")
    elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        text = number(c.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = c.cast("string")
    elif isinstance(kind, T.BinaryType):
        text = quoted(F.base64(c))
    else:
        text = quoted(c.cast("string"))
    return F.when(c.isNull(), F.lit("null")).otherwise(text)


def identity(c: Column, kind: T.DataType) -> Column:
    """SHA-256 of the canonical text; null where there is none."""
    return F.sha2(canonical_json(c, kind), 256)
