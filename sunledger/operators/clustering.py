"""An order of rows in which neighbours are close in several columns at once.

Each column is cut at its quantiles into cells of about equal numbers of rows, and the bits of the cells' numbers
take turns (Z-order). Files that are cut from rows in this order have narrow bounds in every column, so a
range of any of them opens few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A column has at most 2 ** BITS cells.
BITS = 4


def _place(column: str, kind: str) -> Column:
    """A number in the order of the column's values; of texts the first six bytes count."""
    c = F.col(column)
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return c.cast("double")


def column_cuts(rows: DataFrame, columns: tuple[str, ...], bits: int = BITS) -> tuple[dict[str, list[float]], int]:
    """Where each column's cells begin, at most 2 ** bits - 1 numbers a column, and the number of rows: one aggregate over all."""
    kinds, shares = dict(rows.dtypes), [i / 2**bits for i in range(1, 2**bits)]
    asked = [x for i, c in enumerate(columns) for x in (F.percentile_approx(_place(c, kinds[c]), shares).alias(f"q{i}"), F.min(_place(c, kinds[c])).alias(f"l{i}"))]
    found = rows.agg(*asked, F.count(F.lit(1)).alias("n")).first()
    return {c: sorted({v for v in found[f"q{i}"] or [] if not math.isnan(v) and v > found[f"l{i}"]}) for i, c in enumerate(columns)}, found["n"]


def z_order(cuts: dict[str, list[float]], kinds: dict[str, str], bits: int = BITS) -> Column:
    """The place of a row; null counts as the least value. Values that came after the cuts were made fall into
    the outermost cells."""
    if bits * len(cuts) > 62:
        raise ValueError("too many columns to order by")
    place = F.lit(0).cast("long")
    for i, (column, at) in enumerate(cuts.items()):
        value = _place(column, kinds[column])
        cell = F.lit(0)
        for cut in at:
            cell = cell + F.coalesce((value >= cut).cast("int"), F.lit(0))
        # few cells are spread over all bits, so that two of them differ in the highest
        spread = [sum(((n * 2**bits // (len(at) + 1)) >> b & 1) << (b * len(cuts) + len(cuts) - 1 - i) for b in range(bits)) for n in range(len(at) + 1)]
        place = place + F.array(*(F.lit(s).cast("long") for s in spread))[cell]
    return place
