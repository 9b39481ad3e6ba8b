"""Column expressions over AS paths. A path is ARRAY<STRING>, first hop nearest the peer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR = "array<struct<as1:string,as2:string>>"


def parse_path(path: Column) -> Column:
    """Hops of a path written with blanks or with ``|``."""
    bars = F.split(path, r"\|")
    blanks = F.split(path, r"\s+")
    hops = F.transform(F.when(path.contains("|"), bars).otherwise(blanks), lambda h: F.trim(h))
    return F.coalesce(F.filter(hops, lambda h: h != ""), F.array().cast("array<string>"))


def collapse_prepends(hops: Column) -> Column:
    """Drop a hop equal to the one before it."""
    return F.filter(hops, lambda h, i: (i == 0) | (h != F.get(hops, i - 1)))


def numeric_hops(path: Column) -> Column:
    """Distinct numeric hops in path order; AS_SETs in braces are dropped."""
    plain = F.regexp_replace(path, r"\{[^}]+\}", "")
    tokens = F.split(F.trim(plain), r"\s+")
    return F.coalesce(
        F.array_distinct(F.filter(tokens, lambda t: t.rlike(r"^\d+$"))),
        F.array().cast("array<string>"),
    )


def adjacent_pairs(hops: Column) -> Column:
    """``[a,b,c] -> [(a,b),(b,c)]``; empty for fewer than two hops."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(hops) - 2),
        lambda i: F.struct(F.get(hops, i).alias("as1"), F.get(hops, i + 1).alias("as2")),
    )
    return F.when(F.size(hops) >= 2, pairs).otherwise(F.array().cast(PAIR))


def origin(hops: Column) -> Column:
    return F.try_element_at(hops, F.lit(-1))


def path_has_any(hops: Column, asns: Sequence[str]) -> Column:
    """Token membership, so 12 does not match 312."""
    return F.arrays_overlap(hops, F.array(*[F.lit(str(a)) for a in asns]))


def relevant(peer_as: Column, hops: Column, asns: Sequence[str]) -> Column:
    """The peer is wanted, or the path crosses a wanted AS."""
    peer = F.coalesce(peer_as.cast("string").isin([str(a) for a in asns]), F.lit(False))
    return peer | F.coalesce(path_has_any(hops, asns), F.lit(False))


def touched_asns(peer_as: Column, hops: Column) -> Column:
    """Every AS an update concerns, each once: join key for many target sets."""
    peer = F.array_compact(F.array(peer_as.cast("string")))
    return F.array_union(peer, F.coalesce(hops, F.array().cast("array<string>")))


def returns_to_hop(hops: Column) -> Column:
    """Number of places where a path reads A, B, A."""
    n = F.size(hops)
    spots = F.filter(
        F.sequence(F.lit(0), n - 3),
        lambda i: (F.get(hops, i) == F.get(hops, i + 2)) & (F.get(hops, i) != F.get(hops, i + 1)),
    )
    return F.when(n >= 3, F.size(spots)).otherwise(F.lit(0))


def occurrences(hops: Column, asn: Column) -> Column:
    return F.size(F.filter(hops, lambda h: h == asn))


# Letters available to edit_distance's one-character alphabet.
_ALPHABET = 150


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance over hop tokens.

    The hops of the two paths become letters of a private alphabet, so that the
    built-in ``levenshtein`` (codegen, JVM) does the work; a pair of paths with more
    distinct hops than letters falls back to the row-by-row recurrence.
    """
    names = F.array_distinct(F.concat(a, b))

    def word(hops: Column) -> Column:
        return F.array_join(
            F.transform(hops, lambda h: F.char(F.array_position(names, h) + 47)), ""
        )

    return F.when(
        F.size(names) <= _ALPHABET, F.levenshtein(word(a), word(b))
    ).otherwise(edit_distance_rows(a, b))


def edit_distance_rows(a: Column, b: Column) -> Column:
    """Same measure, one table row per hop of ``a``, each folded over ``b``."""
    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: j.cast("int"))

    def next_row(prev: Column, hop: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            cost = F.when(F.get(b, j) == hop, 0).otherwise(1)
            return F.array_append(
                row,
                F.least(
                    F.element_at(row, -1) + 1,
                    F.get(prev, j + 1) + 1,
                    F.get(prev, j) + cost,
                ).cast("int"),
            )

        start = F.array((F.get(prev, F.lit(0)) + 1).cast("int"))
        columns = F.filter(F.sequence(F.lit(0), F.size(b)), lambda j: j < F.size(b))
        return F.aggregate(columns, start, cell)

    return F.element_at(F.aggregate(a, first, next_row), -1)


def leak_probability(links: Column) -> Column:
    """Fold ordered known links ``(p2c, c2p)``: each link weighs against the one before.

    1.0 means valley-free; unknown links are absent from ``links`` and leave the
    carried value untouched.
    """
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("up"))

    def step(acc: Column, link: Column) -> Column:
        up, down = acc["up"], link["p2c"]
        return F.struct(
            F.least(down + up - down * up, acc["p"]).alias("p"), link["c2p"].alias("up")
        )

    return F.aggregate(links, start, step, lambda acc: acc["p"])
