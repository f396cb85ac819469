"""Element counts of a molecule, from its atomic numbers or from a formula in any common spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element symbols, their atomic numbers, and the order of counts in a composition key.
ELEMENTS = (("C", 6), ("H", 1), ("N", 7), ("O", 8), ("F", 9))
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"
FULL_WIDTH = "０１２３４５６７８９"
DIGITS = "0123456789"

#: Bits of one element's count in a key.
COUNT_BITS = 12


def key_of_numbers(z: Column) -> Column:
    """Composition key of an array of atomic numbers; null for a null array, 0 for an empty one or unknown numbers only."""
    key = F.lit(0).cast("bigint")
    for place, (_, number) in enumerate(ELEMENTS):
        key = key + F.shiftleft(F.size(F.array_remove(F.transform(z, _is(number)), False)).cast("bigint"), COUNT_BITS * place)
    return F.when(z.isNotNull(), key)


def _is(number: int):
    return lambda x: F.coalesce(x == number, F.lit(False))


def plain_formula(formula: Column) -> Column:
    """The formula in capitals and plain digits, without separators; null if anything else is left in it."""
    text = F.translate(formula, SUBSCRIPTS + FULL_WIDTH, DIGITS + DIGITS)
    text = F.upper(F.regexp_replace(text, r"[^\p{L}\p{Nd}()\[\]+.*]", ""))
    return F.nullif(F.regexp_extract(text, r"^((?:[CHNOF]\d{0,3})+)$", 1), F.lit(""))


def key_of_formula(formula: Column) -> Column:
    """Composition key of a written formula: repeated symbols add up, order, case and separators do not matter.

    Null for null, empty and unreadable formulas; a count has at most three digits.
    """
    parts = F.regexp_extract_all(plain_formula(formula), F.lit(r"([CHNOF]\d*)"), F.lit(1))
    symbols = F.lit("".join(symbol for symbol, _ in ELEMENTS))

    def value(part: Column) -> Column:
        count = F.when(F.length(part) == 1, F.lit(1)).otherwise(F.substring(part, 2, 3).cast("int")).cast("bigint")
        return F.call_function("shiftleft", count, (F.instr(symbols, F.substring(part, 1, 1)) - 1) * COUNT_BITS)

    return F.aggregate(F.transform(parts, value), F.lit(0).cast("bigint"), lambda total, x: total + x)


def hill_formula(z: Column) -> Column:
    """Formula text in the order C, H, F, N, O, a count of 1 left out; null for null or unknown elements."""
    order = ("C", "H", "F", "N", "O")  # fixed values: the order of symbols in formula strings
    number = dict(ELEMENTS)
    known = F.forall(z, lambda x: x.isin(*[n for _, n in ELEMENTS]))

    def part(symbol: str) -> Column:
        n = F.size(F.array_remove(F.transform(z, _is(number[symbol])), False))
        return F.when(n > 1, F.concat(F.lit(symbol), n.cast("string"))).when(n == 1, F.lit(symbol)).otherwise("")

    return F.when(known, F.concat(*[part(s) for s in order]))
