"""CIDR text as fixed-width binary digits, so containment is a string-prefix test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(prefix: Column) -> Column:
    return F.try_element_at(F.split(prefix, "/"), F.lit(2)).try_cast("int")


def version(prefix: Column) -> Column:
    return F.when(prefix.contains(":"), 6).when(prefix.contains("."), 4)


def _groups(text: Column, sep: str, base: int, width: int) -> Column:
    return F.array_join(
        F.transform(
            F.split(text, sep), lambda g: F.lpad(F.conv(g, base, 2), width, "0")
        ),
        "",
    )


def _v6_text(address: Column) -> Column:
    """Write out ``::`` as zero groups."""
    halves = F.split(address, "::")
    left = F.filter(F.split(F.get(halves, F.lit(0)), ":"), lambda g: g != "")
    right = F.filter(
        F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":"), lambda g: g != ""
    )
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    full = F.array_join(F.concat(left, gap, right), ":")
    return F.when(address.contains("::"), full).otherwise(address)


def bits(prefix: Column) -> Column:
    """The network bits only: a /24 gives 24 digits. Null for text that is no prefix."""
    address = F.get(F.split(prefix, "/"), F.lit(0))
    v4 = F.when(
        address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), _groups(address, r"\.", 10, 8)
    )
    v6 = F.when(
        address.rlike(r"^[0-9A-Fa-f:]+$"), _groups(_v6_text(address), ":", 16, 16)
    )
    digits = F.when(version(prefix) == 4, v4).otherwise(v6)
    width = F.when(version(prefix) == 4, 32).otherwise(128)
    ok = (F.length(digits) == width) & length(prefix).between(0, width)
    return F.when(ok, F.substring(digits, F.lit(1), length(prefix)))


def is_subprefix(child: Column, parent: Column) -> Column:
    """Strictly inside: same family, longer, and under the parent's bits."""
    return F.coalesce(
        (version(child) == version(parent))
        & (length(child) > length(parent))
        & F.startswith(bits(child), bits(parent)),
        F.lit(False),
    )


def overlaps(a: Column, b: Column) -> Column:
    """Either prefix contains the other."""
    return F.coalesce(
        (version(a) == version(b))
        & (F.startswith(bits(a), bits(b)) | F.startswith(bits(b), bits(a))),
        F.lit(False),
    )
