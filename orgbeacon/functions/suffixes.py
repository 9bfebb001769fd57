"""Registrable domains by the ICANN section of the public suffix list, which lies beside this module as a data file.

The rules are a hash set in the plan, so a host's suffixes are looked up where its row is: no Python worker, no shuffle.
"""

from __future__ import annotations

from functools import lru_cache
from importlib.resources import files
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The full stops of other scripts, which end a label as ``.`` does.
OTHER_DOTS = "\u3002\uff0e\uff61"


def _forms(label: str) -> set[str]:
    """A label as it is written, and in ASCII."""
    try:
        return {label, label.encode("idna").decode()} if not label.isascii() else {label}
    except UnicodeError:
        return {label}


@lru_cache(maxsize=4)
def public_suffixes(path: str | None = None) -> frozenset[str]:
    """The rules, their labels both as they are written and in ASCII; about 8000, whatever the data. ``path``: another list in the same format."""
    if path is None:
        text = files(__package__).joinpath("public_suffixes.txt").read_text("utf-8")
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    rules = (line.strip() for line in text.split("===END ICANN DOMAINS===")[0].splitlines())
    return frozenset(".".join(labels) for r in rules if r and not r.startswith("//") for labels in product(*map(_forms, r.split("."))))


def host_of(url: Column) -> Column:
    """The host of a url or a bare domain, lower-cased, without user and port."""
    value = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?U)^\s+|\s+$", "")
    rest = F.regexp_replace(value, r"^[^/?#]*?://", "")
    return F.lower(F.translate(F.regexp_extract(rest, r"^(?:[^/?#]*@)?([^/?#:]*)", 1), OTHER_DOTS, "..."))


@lru_cache(maxsize=4)
def _of_host(rules: frozenset[str]) -> str:
    """SQL of a function of one host: its public suffix with one label more, in the letters of the host; null if there is no such.

    The longest suffix that a rule names counts: an exception ends a label later, a wildcard stands for one label. As text, as the
    set is then one step for the parser.
    """
    known = lambda names: "('" + "', '".join(sorted(n.replace("\\", "\\\\").replace("'", "\\'") for n in names) or [""]) + "')"
    plain, wild, never = ({r.removeprefix(p) for r in rules if r.startswith(p)} for p in ("", "*.", "!"))
    plain = {r for r in plain if r[0] not in "*!"}
    depth = max((r.count(".") + 1 for r in rules), default=1)
    rest = lambda n: f"substring_index(host, '.', -({n}))"
    size = f"CASE WHEN {rest('n')} IN {known(never)} THEN n - 1 WHEN {rest('n')} IN {known(plain)} OR n > 1 AND {rest('n - 1')} IN {known(wild)} THEN n END"
    sizes = f"filter(transform(sequence(least(labels, {depth}), 1, -1), n -> {size}), n -> n IS NOT NULL)"
    labels = "size(split(host, '[.]'))"
    domain = f"get(transform({sizes}, n -> CASE WHEN n < labels THEN {rest('n + 1')} END), 0)"
    whole = "host LIKE '%.%' AND host NOT LIKE '.%' AND NOT contains(host, '..')"
    return f"given -> get(transform(array(rtrim('.', given)), host -> CASE WHEN {whole} THEN get(transform(array({labels}), labels -> {domain}), 0) END), 0)"


def registrable_each(values: Column, rules: frozenset[str] | None = None) -> Column:
    """The registrable domain of every url or bare domain of an array, lower-cased; null for one that has none. ``rules``: others than the public suffixes."""
    return F.call_function("transform", F.transform(values, host_of), F.expr(_of_host(rules or public_suffixes())))


def registrable(url: Column | str, rules: frozenset[str] | None = None) -> Column:
    """The same of one value."""
    return F.get(registrable_each(F.array(F.col(url) if isinstance(url, str) else url), rules), F.lit(0))
