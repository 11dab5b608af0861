"""Run-length masks as column expressions: counts of equal pixels in column order, background first, and their compact text.

Fixed values of the public format: each count, from the fourth on as the difference to the one before the last, is a signed
number in groups of five bits, the lowest first; 16 is the sign in a number's last group, 32 says that more groups follow,
and a group is the character with its value plus 48.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups of the longest number: runs of up to 2^34 pixels.
GROUPS = 7
#: Pairs of runs that ``shared_pixels`` measures at once.
RUN_PAIRS = 1 << 20


def _shift_left(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by)


def _shift_right(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names more than once, made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def from_pixels(mask: Column) -> Column:
    """Counts of a mask given as text of 0 and 1 in column order; an empty one has none."""
    runs = F.transform(F.regexp_extract_all(mask, F.lit("0+|1+"), F.lit(0)), lambda r: F.length(r).cast("long"))
    return F.when(mask.startswith("1"), F.concat(F.array(F.lit(0).cast("long")), runs)).otherwise(runs)


def to_pixels(counts: Column) -> Column:
    return F.array_join(F.transform(counts, lambda n, i: F.repeat(F.when(i % 2 == 1, F.lit("1")).otherwise(F.lit("0")), n.cast("int"))), "")


def encode(counts: Column) -> Column:
    """The compact text of counts."""

    def number(n: Column, before: Column) -> Column:
        x = n.cast("long") - before
        group = lambda k, more: F.char(_shift_right(x, F.lit(5 * k)).bitwiseAND(F.lit(31).cast("long")) + (80 if more else 48))
        text = F.when(x.between(-16, 15), group(0, False))
        for size in range(2, GROUPS + 1):
            text = text.when(x.between(-(1 << 5 * size - 1), (1 << 5 * size - 1) - 1), F.concat(*[group(k, k < size - 1) for k in range(size)]))
        return text

    # the counts stand beside those two before them, not within the function, where they would be made anew for each number
    zero = F.lit(0).cast("long")
    before = F.concat(F.array(zero, zero, zero), F.slice(counts, F.lit(2), F.greatest(F.size(counts) - 3, F.lit(0))))
    return F.array_join(F.zip_with(counts, before, number), "")


#: Characters after which a number goes on.
_MORE = r"\x10-\x2FP-o"


def decode(text: Column) -> Column:
    """Counts of a compact text. A text that ends within a number is an error."""

    def number(token: Column) -> Column:
        n = F.length(token)
        value = lambda k: (F.ascii(F.substring(token, k + 1, 1) if isinstance(k, int) else F.substring(token, k + F.lit(1), F.lit(1))) - 48).cast("long").bitwiseAND(F.lit(31).cast("long"))
        long = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(_shift_left(value(k), 5 * k)))
        x = F.when(n == 1, value(0)).when(n == 2, value(0).bitwiseOR(_shift_left(value(1), F.lit(5)))).otherwise(long)
        negative = (F.ascii(F.right(token, F.lit(1))) - 48).bitwiseAND(F.lit(16)) > 0
        return F.when(negative, x.bitwiseOR(_shift_left(F.lit(-1).cast("long"), 5 * n))).otherwise(x)

    step = lambda acc, x: F.concat(acc, F.array(x + F.when(F.size(acc) > 2, F.get(acc, F.size(acc) - 2)).otherwise(F.lit(0).cast("long"))))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(f"(?s)[{_MORE}]*[^{_MORE}]"), F.lit(0)), number)
    bad = F.raise_error(F.lit("a run-length text ends within a number")).cast("array<bigint>")
    return F.when(text.rlike(rf"[{_MORE}]\z"), bad).otherwise(F.aggregate(numbers, F.expr("cast(array() as array<bigint>)"), step))


def area(counts: Column) -> Column:
    """Foreground pixels."""
    return F.aggregate(F.filter(counts, lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda acc, n: acc + n)


def runs(counts: Column) -> Column:
    """start and stop of each foreground run that isn't empty."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("out"), F.lit(False).alias("fore"))

    def step(acc: Column, n: Column) -> Column:
        run = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + n).alias("stop")))
        return F.struct((acc["at"] + n).alias("at"), F.when(acc["fore"] & (n > 0), F.concat(acc["out"], run)).otherwise(acc["out"]).alias("out"), (~acc["fore"]).alias("fore"))

    return F.aggregate(counts, start, step, lambda acc: acc["out"])


def overlap(a: Column, b: Column) -> Column:
    """Pixels that two masks of one size share, from their runs: one pass over the sorted ends."""
    ends = lambda counts: F.flatten(F.transform(runs(counts), lambda r: F.array(F.struct(r["start"].alias("at"), F.lit(1).alias("by")), F.struct(r["stop"].alias("at"), F.lit(-1).alias("by")))))
    zero = F.lit(0).cast("long")
    step = lambda acc, e: F.struct((acc["sum"] + F.when(acc["open"] == 2, e["at"] - acc["at"]).otherwise(zero)).alias("sum"), e["at"].alias("at"), (acc["open"] + e["by"]).alias("open"))
    return F.aggregate(F.sort_array(F.concat(ends(a), ends(b))), F.struct(zero.alias("sum"), zero.alias("at"), F.lit(0).alias("open")), step, lambda acc: acc["sum"])


def edges(counts: Column) -> Column:
    """start and stop of each foreground run that isn't empty, flat and in order: what ``shared_pixels`` looks at, made once a mask."""
    return F.flatten(F.transform(runs(counts), lambda r: F.array(r["start"], r["stop"])))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All edges of the lists, where each list begins, and its length."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(n) - n, n


def shared_pixels(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """``overlap`` of two columns of ``edges``, row by row: the overlaps of all pairs of runs, of which those within a mask are apart."""
    (x, at_x, n_x), (y, at_y, n_y) = _flat(a), _flat(b)
    pairs = (n_x // 2) * (n_y // 2)
    ends, out, begin = np.cumsum(pairs), np.zeros(len(pairs), np.int64), 0
    while begin < len(pairs):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + RUN_PAIRS, side="right")))
        own = np.arange(begin, end)
        for i in range(0, int(pairs[own].max()), RUN_PAIRS):  # more than one round only for one pair of masks with very many runs
            many = np.minimum(pairs[own] - i, RUN_PAIRS)
            row = np.repeat(own, many)
            k = i + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            p, q = at_x[row] + k // (n_y[row] // 2) * 2, at_y[row] + k % (n_y[row] // 2) * 2
            shared = np.maximum(np.minimum(x[p + 1], y[q + 1]) - np.maximum(x[p], y[q]), 0)
            np.add.at(out, row, shared)
        begin = end
    return out


def mask_iou(a: Column, b: Column, crowd: Column | None = None) -> Column:
    """Shared pixels over those of either mask, or of ``a`` alone where ``b`` is a crowd; 0.0 for empty ones."""
    shared = overlap(a, b)
    whole = area(a) + area(b) - shared
    if crowd is not None:
        whole = F.when(crowd, area(a)).otherwise(whole)
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def bounds(counts: Column, height: Column) -> Column:
    """x, y, w, h of the smallest box around a mask of the given height; null for an empty one."""
    each = F.transform(runs(counts), lambda r: F.struct(F.floor(r["start"] / height).alias("x0"), F.floor((r["stop"] - 1) / height).alias("x1"), (r["start"] % height).alias("y0"), ((r["stop"] - 1) % height).alias("y1")))
    across = lambda r: r["x0"] < r["x1"]

    def box(own: Column) -> Column:
        x, y = F.array_min(F.transform(own, lambda r: r["x0"])), F.array_min(F.transform(own, lambda r: F.when(across(r), F.lit(0).cast("long")).otherwise(r["y0"])))
        x1, y1 = F.array_max(F.transform(own, lambda r: r["x1"])), F.array_max(F.transform(own, lambda r: F.when(across(r), height.cast("long") - 1).otherwise(r["y1"])))
        return F.when(F.size(own) > 0, F.struct(x.alias("x"), y.alias("y"), (x1 - x + 1).alias("w"), (y1 - y + 1).alias("h")))

    return once(each, box)
