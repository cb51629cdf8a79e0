"""Quantities in texts: numbers with a comparison, a range and a unit, and whether evidence covers what was asked for."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.terms import OPERATORS, TOLERANCES, UNITS
from corvane.functions.text import let

#: Comparison, first number, second number and unit: a fixed pattern, the same strings as elsewhere count as quantities.
QUANTITY = r"(<=|>=|≤|≥|<|>|до|не более|не менее|более|менее)?\s*([0-9]+(?:[,.][0-9]+)?)(?:\s*[-–—]\s*([0-9]+(?:[,.][0-9]+)?))?\s*(%|мг/л|mg/l|мг/дм3|мг/дм³|г/л|g/l|м/с|m/s|л/с|l/s|°c|кг/т|kg/t)"
#: The same matches, found in one quick pass: a place is tried only where a comparison or a number can begin (\u1C81 is another small д; most places are ruled
#: out by the first look alone), and white space before a number is no part of the match. Its parts are looked for again in the short match alone.
COMPARISON, MEASURED = QUANTITY.split(r"?\s*", 1)
SCANNED = rf"(?=[0-9<>[^\x00-\x7F]])(?=[0-9<>≤≥дДнНбБмМ\u1C81])(?iu)(?:{COMPARISON}\s*)?{MEASURED}"
#: A quantity whatever stands before its number: where one of these is found, there is one of those.
ANY_QUANTITY = rf"(?=[0-9])(?iu){MEASURED}"
#: The units of search payloads: fewer than those of quantities.
UNIT = r"(%|мг/л|mg/l|мг/дм3|мг/дм³|м/с|m/s|кг/т|kg/t)"
ANY_CASE = "(?iu)"


def chosen(value: Column, names: dict[str, str], default: Column) -> Column:
    """names[value], or the default, by one map that is folded into a constant."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), default)


def number(text: Column) -> Column:
    """A decimal comma counts as a point; null where it is no number."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def unit_name(unit: Column) -> Column:
    low = F.lower(unit)
    return chosen(low, UNITS, low)


def operator_code(word: Column) -> Column:
    return chosen(F.lower(word), OPERATORS, F.lit("eq"))


def units(text: Column) -> Column:
    """array<string>: the distinct names of units in the text, sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?=[%MmKk[^\\x00-\\x7F]])(?=[%мМmMкКkK\u212A]){ANY_CASE}{UNIT}"))  # \u212A: another k
    return F.sort_array(F.array_distinct(F.transform(found, unit_name)))


def quantities(text: Column) -> Column:
    """array<struct<value, unit, operator, range_min, range_max>> in order of appearance. A range has operator `range` and its lesser bound first.

    The text is read once; the parts of a quantity are taken from its own few characters."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SCANNED), F.lit(0))
    part = lambda m, i: F.regexp_extract(m, SCANNED, i)

    def one(word: Column, first: Column, second: Column, unit: Column) -> Column:
        return F.struct(
            first.alias("value"),
            unit_name(unit).alias("unit"),
            F.when(second.isNotNull(), "range").otherwise(operator_code(word)).alias("operator"),
            F.when(second.isNotNull(), F.least(first, second)).alias("range_min"),
            F.when(second.isNotNull(), F.greatest(first, second)).alias("range_max"),
        )

    return F.transform(found, lambda m: let(number(part(m, 2)), lambda first: let(number(part(m, 3)), lambda second: one(part(m, 1), first, second, part(m, 4)))))


def short(value: Column) -> Column:
    """A number of up to six significant digits without trailing zeros."""
    fixed = F.regexp_replace(F.format_string("%.6f", value), "0+$", "")
    return F.regexp_replace(fixed, r"\.$", "")


def formatted(q: Column) -> Column:
    """A quantity as text: `1-2 mg/l`, `5 %`, `le 3 g/l`."""
    bounds = F.concat(short(q["range_min"]), F.lit("-"), short(q["range_max"]))
    value = F.when(q["operator"] == "range", bounds).when(q["operator"] == "eq", short(q["value"])).otherwise(F.concat(q["operator"], F.lit(" "), short(q["value"])))
    return F.concat(value, F.lit(" "), q["unit"])


def first_number(text: Column) -> Column:
    """The first number of the text, unsigned; null where it has none."""
    return number(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"[0-9]+(?:[,.][0-9]+)?", 0), F.lit("")))


def measurement(text: Column) -> Column:
    """struct<value, unit> of a text like `5 mg/l`: its first number, and what is left without it, trimmed."""
    found = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"[-+]?[0-9]+(?:[,.][0-9]+)?", 0), F.lit(""))
    rest = F.when(found.isNull(), "").otherwise(F.trim(F.replace(text, found, F.lit(""))))
    return F.struct(number(found).alias("value"), rest.alias("unit"))


def resolved(quantity: Column, several: Column, value: Column) -> Column:
    """struct<unit, value> of an artifact: its own quantity, else the first of several, else what its text says; null without a number.

    quantity: struct<unit, value>, or null; several: an array of them."""
    unit = lambda q: F.when(F.coalesce(q["unit"], F.lit("")) == "", "").otherwise(unit_name(q["unit"]))
    own = lambda q: F.struct(unit(q).alias("unit"), q["value"].cast("double").alias("value"))
    written = reduce(lambda out, u: F.when(F.contains(F.lower(value), F.lit(u)), UNITS[u]).otherwise(out), reversed(UNITS), F.lit(""))
    text = let(first_number(value), lambda n: F.when(n.isNotNull(), F.struct(written.alias("unit"), n.alias("value"))))
    return let(F.get(several, F.lit(0)), lambda first: F.when(quantity.isNotNull(), own(quantity)).when(first.isNotNull(), own(first)).otherwise(text))


def tolerance(unit: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in TOLERANCES.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, unit), F.lit(0.000001))


def covers(q: Column, asked: Column) -> Column:
    """Whether a quantity of the evidence covers one that was asked for: equal units, a range within it, or a value within the unit's tolerance."""
    both = asked["range_min"].isNotNull() & asked["range_max"].isNotNull()
    in_range = F.when(q["operator"] == "range", (q["range_min"] <= asked["range_min"]) & (q["range_max"] >= asked["range_max"])).otherwise(q["value"].between(asked["range_min"], asked["range_max"]))
    close = F.when(asked["value"].isNull(), True).otherwise(F.abs(q["value"] - asked["value"]) <= tolerance(q["unit"]))
    unit = F.coalesce(asked["unit"], F.lit("")) == ""
    return (unit | (q["unit"] == unit_name(asked["unit"]))) & F.coalesce(F.when((asked["operator"] == "range") & both, in_range).otherwise(close), F.lit(False))


def covers_all(found: Column, asked: Column) -> Column:
    """Whether every quantity asked for is covered by some found one. Nothing asked for is covered; nothing found covers nothing."""
    return F.when(F.size(asked) == 0, True).when(F.size(found) == 0, False).otherwise(F.forall(asked, lambda a: F.exists(found, lambda q: covers(q, a))))


def interval(q: Column) -> Column:
    """struct<low, high> of the values that a quantity admits, by its operator; open sides are infinite."""
    value, inf = q["value"], F.lit(float("inf"))
    low = F.when(q["operator"] == "range", q["range_min"]).when(q["operator"].isin("le", "lt"), -inf).otherwise(value)
    high = F.when(q["operator"] == "range", q["range_max"]).when(q["operator"].isin("ge", "gt"), inf).otherwise(value)
    return F.struct(low.alias("low"), high.alias("high"))
