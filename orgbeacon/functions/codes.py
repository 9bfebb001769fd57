"""Registry codes: checks of tax numbers, and finding codes in text. Column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the control digits of a 10-digit number, and of the 11th and 12th of a 12-digit one.
CONTROL_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
CONTROL_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
CONTROL_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)

#: Lengths of registry codes.
CODE_LENGTHS = (10, 12, 13, 15)

# What parked pages say.
PARKED = (
    "домен продается", "домен продаётся", "domain is for sale", "срок регистрации домена истек",
    "this domain is parked", "купить домен", "домен припаркован", "sedoparking",
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out, and written in the plan, once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def or_empty(value: Column | str) -> Column:
    return F.coalesce(_column(value), F.lit(""))


def not_empty(value: Column | str) -> Column:
    """The value, null if it is the empty string."""
    return F.nullif(_column(value), F.lit(""))


def one_space(text: Column | str) -> Column:
    """Runs of any white space as one space; null as an empty string."""
    return F.regexp_replace(or_empty(text), r"(?U)\s+", " ")


def normalize_inn(raw: Column | str) -> Column:
    return F.regexp_replace(or_empty(raw), "[^0-9]", "")


def _control(digits: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(digits, i + 1, 1).cast("int") * w
    return (total % 11) % 10 == F.substring(digits, len(weights) + 1, 1).cast("int")


def is_valid_inn(raw: Column | str) -> Column:
    def check(digits: Column) -> Column:
        short, long = F.length(digits) == 10, F.length(digits) == 12
        return F.when(short, _control(digits, CONTROL_10)).when(long, _control(digits, CONTROL_11) & _control(digits, CONTROL_12)).otherwise(False)

    return let(normalize_inn(raw), check)


def is_entrepreneur(raw: Column | str) -> Column:
    return F.length(normalize_inn(raw)) == 12


def kind(raw: Column | str) -> Column:
    return F.when(is_entrepreneur(raw), "entrepreneur").otherwise("legal")


def code_runs(text: Column | str, lengths: tuple[int, ...] = CODE_LENGTHS) -> Column:
    """The distinct maximal runs of digits that have the length of a code: a text holds a code if it is one of them."""
    runs = F.regexp_extract_all(one_space(text), F.lit("([0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(runs, lambda r: F.length(r).isin(*lengths)))


def contains_code(text: Column | str, code: Column | str) -> Column:
    """Does the text hold the code as a number of its own? False for a null or empty code."""
    runs = F.regexp_extract_all(one_space(text), F.lit("([0-9]+)"), F.lit(1))
    return F.coalesce(F.array_contains(runs, not_empty(code)), F.lit(False))


def _alone(code: Column) -> Column:
    return F.concat(F.lit("(?<![0-9])"), code, F.lit("(?![0-9])"))


def excerpt_around(text: Column | str, code: Column | str, width: int = 160) -> Column:
    """The text around the first place of the code; empty if it is not there."""
    whole, wanted = one_space(text), not_empty(code)
    at = F.regexp_instr(whole, _alone(wanted))
    begin = F.greatest(at - 1 - width // 2, F.lit(0))
    return F.when(at > 0, F.trim(F.substr(whole, begin + 1, at - 1 + F.length(wanted) + width // 2 - begin))).otherwise("")


def published_inns(text: Column | str) -> Column:
    """The distinct numbers right after the word for a tax number. Of twelve digits the first ten are read."""
    return F.array_distinct(F.regexp_extract_all(one_space(text), F.lit(r"(?iuU)ИНН[:\s]*([0-9]{10}|[0-9]{12})"), F.lit(1)))


def looks_parked(text: Column | str) -> Column:
    low = F.lower(or_empty(text))
    out = F.lit(False)
    for marker in PARKED:
        out = out | F.contains(low, F.lit(marker))
    return out


def windows_near(text: Column | str, inn: Column | str, radius: int = 220) -> Column:
    """The text around every place of the number, in order; windows may overlap.

    A window is built of the parts between places: the last ``radius`` characters before its place and the first ``radius`` after
    it. Only as many parts are looked at as a radius can hold, so the work is in proportion to the places.
    """
    whole, wanted = or_empty(text), not_empty(inn)

    def windows(parts: Column) -> Column:
        def window(i: Column) -> Column:
            few = F.least(F.lit(radius) / (F.length(wanted) + 1) + 2, F.lit(radius)).cast("int")  # a part has a character at least, beside the number
            low = F.greatest(i - few, F.lit(0))
            before = F.call_function("array_join", F.slice(parts, low + 1, i - low + 1), wanted)
            after = F.call_function("array_join", F.slice(parts, i + 2, few + 1), wanted)
            return F.concat(F.right(before, F.lit(radius)), wanted, F.left(after, F.lit(radius)))

        found = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.size(parts) - 2), window))
        return F.coalesce(found, F.array().cast("array<string>"))

    return let(F.split(whole, _alone(wanted)), windows)
