"""Names of organisations and the domains that look like them."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from orgbeacon.functions.codes import let, not_empty, or_empty

# Legal forms and filler words that carry no brand.
FILLER = (
    "ООО", "ОАО", "ЗАО", "ПАО", "АО", "НАО", "ИП", "НКО", "ФГУП", "ГУП", "МУП", "АНО", "НОУ", "ЧОУ", "ФГБУ", "ФГБОУ", "ГБУ",
    "МБУ", "ТСЖ", "НП", "СНТ", "ОБЩЕСТВО", "ОГРАНИЧЕННОЙ", "ОТВЕТСТВЕННОСТЬЮ", "АКЦИОНЕРНОЕ", "ПУБЛИЧНОЕ", "НЕПУБЛИЧНОЕ",
    "ЗАКРЫТОЕ", "ОТКРЫТОЕ", "КОМПАНИЯ", "ФИРМА", "ГРУППА", "ХОЛДИНГ", "ТОРГОВЫЙ", "ДОМ", "ЦЕНТР", "С", "LLC", "LTD", "INC",
    "JSC", "CO",
)

# The Latin spelling of Cyrillic letters, and what the second spelling has otherwise.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c",
    "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
OTHERWISE = {"х": "kh", "ц": "ts", "й": "i", "ю": "ju", "я": "ja"}


def transliterate(text: Column, alt: bool = False) -> Column:
    table = LATIN | (OTHERWISE if alt else {})
    out = F.lower(text)
    for letter, latin in table.items():  # letters of several Latin ones, or of none
        if len(latin) != 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    single = {letter: latin for letter, latin in table.items() if len(latin) == 1}
    return F.translate(out, "".join(single), "".join(single.values()))


def clean_name(name: Column | str) -> Column:
    words = F.regexp_replace(or_empty(name), r"(?iuU)\b(" + "|".join(FILLER) + r")\b", " ")
    return F.regexp_replace(F.regexp_replace(words, r"[\"«»'`()]+", " "), r"(?U)^\s+|\s+$", "")


def brand_tokens(name: Column | str) -> Column:
    return F.slice(F.filter(F.split(clean_name(name), r"(?U)[\s\-_,.]+"), lambda t: F.length(t) > 2), 1, 6)


def spelling_variants(value: Column) -> Column:
    def forms(v: Column) -> Column:
        x = F.when(F.contains(v, F.lit("ks")), F.replace(v, F.lit("ks"), F.lit("x")))
        y = F.when(F.contains(v, F.lit("iy")), F.replace(v, F.lit("iy"), F.lit("y")))
        return F.array_compact(F.array(v, x, y))

    return let(value, forms)


def _spellings(values: Column) -> Column:
    """All spellings of each of an array's words, in order."""
    forms = F.flatten(F.transform(values, lambda v: F.array(F.lower(v), transliterate(v), transliterate(v, alt=True))))
    return F.flatten(F.transform(forms, spelling_variants))


def brand_variants(*names: Column) -> Column:
    """The spellings of the names' tokens, and of each name's tokens in one; distinct, in order."""

    def of_name(tokens: Column) -> Column:
        own = F.filter(_spellings(tokens), lambda v: F.length(v) > 0)
        return F.concat(own, F.filter(_spellings(F.array(F.array_join(tokens, ""))), lambda v: F.length(v) > 3))

    return F.array_distinct(F.flatten(F.transform(F.array(*names), lambda n: of_name(brand_tokens(n)))))


def first_label(domain: Column) -> Column:
    return F.replace(F.substring_index(domain, ".", 1), F.lit("-"), F.lit(""))


def brand_in_domain(domain: Column, variants: Column) -> Column:
    label = first_label(domain)

    def like(variant: Column) -> Column:
        v = F.replace(variant, F.lit("-"), F.lit(""))
        return (F.length(v) >= 4) & (F.contains(label, v) | F.contains(v, label))

    return F.coalesce((F.length(label) >= 4) & F.exists(variants, like), F.lit(False))


def _ratio(a: str | None, b: str | None) -> float:
    """The ratio of difflib, without the list of blocks that it makes."""
    if not a or not b:
        return 0.0
    a, b = a.lower(), b.lower()
    if a == b and len(b) < 200:  # longer ones have letters that difflib leaves out
        return 1.0
    longest, matched, parts = difflib.SequenceMatcher(None, a, b).find_longest_match, 0, [(0, len(a), 0, len(b))]
    while parts:
        a_low, a_high, b_low, b_high = parts.pop()
        i, j, size = longest(a_low, a_high, b_low, b_high)
        if size:
            matched += size
            if a_low < i and b_low < j:
                parts.append((a_low, i, b_low, j))
            if i + size < a_high and j + size < b_high:
                parts.append((i + size, a_high, j + size, b_high))
    return 2.0 * matched / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """How much of two strings matches, block by block; not symmetric. Each distinct pair is compared once a batch."""
    known: dict[tuple, float] = {}
    return pd.Series([known[p] if p in known else known.setdefault(p, _ratio(*p)) for p in zip(a, b, strict=True)], dtype="float64")


def most_alike(label: str, forms: list[str], known: dict[tuple, float]) -> float:
    """The best ratio of a label with several forms; ``known`` gets the ratios that were worked out block by block.

    A ratio is at most that of the letters two strings have in common, and at most that of their lengths; forms are tried in the order
    of the first bound and left out once it is no better than the best ratio so far.
    """
    own, n = Counter(label.lower()), len(label)
    bounds = []
    for form in dict.fromkeys(f for f in forms if f):
        if n and (label, form) not in known:
            common = (own & Counter(form.lower())).total()
            bounds.append((2.0 * common / (len(label.lower()) + len(form.lower())), form))
    best = max((known[label, f] for f in forms if (label, f) in known), default=0.0)
    for bound, form in sorted(bounds, reverse=True):
        if bound <= best:
            break
        ratio = known[label, form] = _ratio(label, form)
        best = max(best, ratio)
    return best


#: Rows that a worker holds as Python objects at a time, with the ratios that are known of them.
ROWS_AT_ONCE = 1000


@F.arrow_udf(DoubleType())
def best_similarity(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for label, forms in batches:
        for at in range(0, len(label), ROWS_AT_ONCE):
            known: dict[tuple, float] = {}
            few = zip(label.slice(at, ROWS_AT_ONCE).to_pylist(), forms.slice(at, ROWS_AT_ONCE).to_pylist(), strict=True)
            yield pa.array([most_alike(one, row, known) if one and row is not None else 0.0 for one, row in few], pa.float64())


def name_similarity(domain: Column, names: Column) -> Column:
    """The best similarity of a domain's first label with the spellings of any of the names (an array)."""
    whole = F.transform(F.filter(names, lambda n: not_empty(n).isNotNull()), lambda n: F.array_join(brand_tokens(n), ""))
    return best_similarity(first_label(domain), F.array_distinct(_spellings(whole)))
