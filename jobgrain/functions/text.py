"""Text expressions: stripping, substring tests, ordered keyword rules, tags."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes only blanks)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _lowered(c: Column) -> Column:
    """Lower-cased text in a list of one, so that a lambda over it binds it once.

    Written out, `lower` would be repeated for every keyword tested.
    """
    return F.array(F.lower(F.coalesce(c, F.lit(""))))


def _any_of(text: Column, phrases: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases], F.lit(False))


def contains_any(c: Column, phrases: list[str]) -> Column:
    """True when lower-cased `c` holds one of `phrases` as a literal substring."""
    return F.exists(_lowered(c), lambda t: _any_of(t, phrases))


def contains_all(c: Column, phrases: list[str]) -> Column:
    """True when lower-cased `c` holds every one of `phrases`."""
    return F.exists(_lowered(c), lambda t: reduce(and_, [F.contains(t, F.lit(p)) for p in phrases], F.lit(True)))


def first_rule(c: Column, rules, default: str) -> Column:
    """Family of the first matching rule; rules are (family, keyword, unless)."""
    def chain(t):
        out = None
        for family, keyword, unless in rules:
            hit = F.contains(t, F.lit(keyword))
            if unless:
                hit = hit & ~_any_of(t, unless)
            out = F.when(hit, family) if out is None else out.when(hit, family)
        return F.lit(default) if out is None else out.otherwise(F.lit(default))

    return F.get(F.transform(_lowered(c), chain), F.lit(0))


def _keyword_hit(text: Column, keyword: str, mode: str) -> Column:
    if mode == "substring":
        return F.contains(text, F.lit(keyword))
    if mode == "word":
        quoted = "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch
                         for ch in keyword.strip())
        return F.rlike(text, F.lit(rf"(?U)(?<!\w){quoted}(?!\w)"))
    raise ValueError(f"unknown mode {mode!r}")


def lexicon_tags(c: Column, lexicon: dict[str, list[str]], mode: str = "substring") -> Column:
    """Sorted skills of `lexicon` found in `c`; an absent text has no skills.

    One generated expression, so it stays in the scan stage. Keywords are
    compared with the lower-cased text exactly as given.
    """
    def tags(t):
        hits = [F.when(reduce(or_, [_keyword_hit(t, k, mode) for k in keywords]), F.lit(skill))
                for skill, given in lexicon.items() if (keywords := [k for k in given if k])]
        if not hits:
            return F.array().cast("array<string>")
        return F.array_sort(F.array_compact(F.array(*hits)))

    return F.get(F.transform(_lowered(c), tags), F.lit(0))


def union_lists(a: Column, b: Column) -> Column:
    """Distinct elements of two lists, sorted; an absent list counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))
