"""Text expressions: AS lists, ASN clean-up, free-text requests, event sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time-range layouts accepted in a request, by date separator.
RANGE_SEPARATORS = (":", "-", "/")
# Where a request names its region, first match wins.
REGION_PATTERNS = (
    r"(?i)in\s+([A-Za-z\s]+?)\s+(?:from|between|during)",
    r"(?i)([A-Za-z\s]+?)\s+network\s+outage",
    r"(?i)([A-Za-z\s]+?)\s+traffic\s+outage",
    r"(?i)([A-Za-z\s]+?)\s+internet\s+outage",
)


def parse_as_list(raw: Column) -> Column:
    """AS numbers of a hand-written list: ``AS1, 2、as3`` gives ``[1,2,3]``.

    A token that is no plain number yields every run of digits in it.
    """
    tokens = F.filter(F.split(raw, r"[,\s、;/]+"), lambda t: t != "")
    numbers = F.flatten(
        F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1)))
    )
    return F.coalesce(
        F.array_distinct(F.transform(numbers, lambda n: n.try_cast("bigint").cast("string"))),
        F.array().cast("array<string>"),
    )


def as_list_text(raw: Column) -> Column:
    """Canonical list text: ``AS1 / AS2``."""
    tokens = F.filter(
        F.transform(F.split(raw, r"[、,;/]+"), lambda t: F.upper(F.trim(t))), lambda t: t != ""
    )
    return F.array_join(
        F.transform(tokens, lambda t: F.when(t.startswith("AS"), t).otherwise(F.concat(F.lit("AS"), t))),
        " / ",
    )


def normalise_asn(raw: Column) -> Column:
    """``AS0123`` to ``123``; text that is no number is kept."""
    bare = F.regexp_replace(F.trim(raw), r"(?i)^AS", "")
    return F.coalesce(bare.try_cast("bigint").cast("string"), bare)


def mentioned_asns(text: Column) -> Column:
    """Distinct AS numbers written as ``AS123``, sorted as numbers."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)AS(\d+)"), F.lit(1))
    return F.transform(
        F.array_sort(F.array_distinct(F.transform(found, lambda n: n.try_cast("decimal(38,0)")))),
        lambda n: n.cast("string"),
    )


def _range_pattern(sep: str) -> str:
    day = rf"(\d{{4}}){sep}(\d{{1,2}}){sep}(\d{{1,2}})\s+(\d{{1,2}}):(\d{{2}})"
    return rf"{day}\s+to\s+{day}"


def time_range(text: Column) -> tuple[Column, Column]:
    """Start and end text (``yyyy-MM-dd HH:mm``) of the first range layout that fits."""

    def side(first: int) -> Column:
        tries = []
        for sep in RANGE_SEPARATORS:
            pattern = _range_pattern(sep)

            def group(i: int, pattern: str = pattern) -> Column:
                return F.regexp_extract(text, pattern, first + i)

            tries.append(
                F.when(
                    text.rlike(pattern),
                    F.concat(
                        group(0), F.lit("-"), F.lpad(group(1), 2, "0"), F.lit("-"), F.lpad(group(2), 2, "0"),
                        F.lit(" "), F.lpad(group(3), 2, "0"), F.lit(":"), group(4),
                    ),
                )
            )
        return F.coalesce(*tries)

    return side(1), side(6)


def region(text: Column) -> Column:
    """Country or region a request speaks of, null when none."""
    return F.coalesce(
        *[F.when(text.rlike(p), F.trim(F.regexp_extract(text, p, 1))) for p in REGION_PATTERNS]
    )


def event_sentence(name: Column, as_list: Column, start: Column, end: Column) -> Column:
    """``name: network outage in AS1 / AS2 from … to …``; null when any part is blank."""
    listed = as_list_text(as_list)
    layout = "yyyy-MM-dd HH:mm"
    whole = (F.trim(name) != "") & (listed != "") & start.isNotNull() & end.isNotNull()
    return F.when(
        whole,
        F.concat(
            F.trim(name), F.lit(": network outage in "), listed,
            F.lit(" from "), F.date_format(start, layout), F.lit(" to "), F.date_format(end, layout),
        ),
    )
