"""String functions of the rules, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents_to_str(cents: Column) -> Column:
    a = F.abs(cents)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(a / 100).cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends; Spark's trim knows spaces only."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def reference_tokens(description: Column, account_ids: Column) -> Column:
    """Sorted runs of three digits and more that are not the entry's own account numbers;
    repeats stay."""
    found = F.regexp_extract_all(description, F.lit(r"(?U)\d{3,}"), F.lit(0))
    return F.array_sort(F.filter(found, lambda t: ~F.array_contains(account_ids, t)))


def is_transposition(a: Column, b: Column) -> Column:
    """Equal length, two places differ, and there the two digits of a stand swapped in b."""
    size = F.length(a)
    where = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    i, j = F.get(where, F.lit(0)), F.get(where, F.lit(1))
    at = lambda s, p: F.substr(s, p, F.lit(1))
    swapped = (at(a, i) == at(b, j)) & (at(a, j) == at(b, i)) & at(a, i).rlike(r"^\d$") & at(a, j).rlike(r"^\d$")
    return F.coalesce((size == F.length(b)) & (F.size(where) == 2) & swapped, F.lit(False))


def reference_match(a: Column, b: Column, transposed: bool = True) -> Column:
    """'exact', 'transposed' or '' : the one test of references that both payables rules use."""
    out = F.when(a == b, "exact")
    if transposed:
        out = out.when(is_transposition(a, b), "transposed")
    return out.otherwise("")


def transposition_candidates(ref: Column) -> Column:
    """All references made by swapping two neighbouring unequal digits."""
    size = F.length(ref)
    at = lambda p: F.substr(ref, p, F.lit(1))
    places = F.filter(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: (i < size) & at(i).rlike(r"^\d$") & at(i + 1).rlike(r"^\d$") & (at(i) != at(i + 1)))
    return F.transform(places, lambda i: F.concat(F.substr(ref, F.lit(1), i - 1), at(i + 1), at(i), F.substr(ref, i + 2, size)))
