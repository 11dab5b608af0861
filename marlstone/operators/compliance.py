"""Verdicts on heads by pluggable modes, and their sweep over all thresholds in one pass.

A mode turns an image's detections (an array column, persons already out) into verdicts, each for the thresholds in
(low, high]; a null low has no end. So a mode is a column expression, whatever it looks at, and a verdict may depend on the
threshold: a helmet that is worn by a head vouches for it only while the helmet itself is over the threshold. The sweep
asks each image only at the ends of its verdicts' intervals, turns what it finds into differences, and sums those from the
highest threshold down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import geometry as g
from marlstone.functions.rle import once
from marlstone.operators.aggregates import rate, running_sums

COMPLIANT, NON_COMPLIANT = "compliant", "non_compliant"
#: Class of the detections and truths behind each status where the class says it all.
STATUS_OF = {"helmet": COMPLIANT, "head": NON_COMPLIANT}
#: Left out before any mode looks.
LEFT_OUT = ("person",)
_FIELDS = ("det_id", "cls", "score", "x", "y", "w", "h")

Mode = Callable[[Column], Column]
MODES: dict[str, Mode] = {}


def mode(name: str) -> Callable[[Mode], Mode]:
    """Registers a mode under a name."""

    def add(f: Mode) -> Mode:
        MODES[name] = f
        return f

    return add


def mode_of(name: str) -> Mode:
    if name not in MODES:
        raise ValueError(f"unknown mode {name!r}; there are {sorted(MODES)}")
    return MODES[name]


def _box(s: Column) -> g.Box:
    return g.Box(s["x"], s["y"], s["w"], s["h"])


def verdict(d: Column, status: Column | str, low: Column, high: Column) -> Column:
    """A detection's verdict for the thresholds in (low, high]."""
    return F.struct(*[d[f].alias(f) for f in _FIELDS], (F.lit(status) if isinstance(status, str) else status).alias("status"), low.cast("double").alias("low"), high.cast("double").alias("high"))


@mode("class_direct")
def class_direct(dets: Column) -> Column:
    """The class is the status."""
    known = F.filter(dets, lambda d: d["cls"].isin(*STATUS_OF))
    status = lambda d: F.coalesce(*[F.when(d["cls"] == c, F.lit(s)) for c, s in STATUS_OF.items()])
    return F.transform(known, lambda d: verdict(d, status(d), F.lit(None), d["score"]))


@mode("geometric_pairing")
def geometric_pairing(dets: Column) -> Column:
    """A head complies while some helmet that is worn on it is over the threshold; helmets have no verdicts."""

    def of(d: Column) -> Column:
        worn = F.filter(dets, lambda t: (t["cls"] == "helmet") & g.worn(g.pair_descriptor(_box(d), _box(t))))
        until = once(worn, lambda own: F.when(F.size(own) > 0, F.least(d["score"], F.array_max(F.transform(own, lambda t: t["score"])))))
        verdicts = lambda u: F.array(F.when(u.isNotNull(), verdict(d, COMPLIANT, F.lit(None), u)), F.when(u.isNull() | (u < d["score"]), verdict(d, NON_COMPLIANT, u, d["score"])))
        return F.array_compact(once(until, verdicts))

    return F.flatten(F.transform(F.filter(dets, lambda d: d["cls"] == "head"), of))


def judged(det: DataFrame, name: str, *on: str) -> DataFrame:
    """on (an image, with an arm perhaps), verdicts: an array over all thresholds. An image is one group, of a bounded size."""
    rows = det.where(~F.col("cls").isin(*LEFT_OUT)).groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("dets"))
    return rows.select(*on, mode_of(name)(F.col("dets")).alias("verdicts"))


def at_threshold(det: DataFrame, name: str, threshold: float, *on: str) -> DataFrame:
    """on, det_id, status: the verdicts at one threshold."""
    v = judged(det, name, *on).select(*on, F.explode("verdicts").alias("v"))
    inside = (F.col("v.high") >= threshold) & (F.col("v.low").isNull() | (F.col("v.low") < threshold))
    return v.where(inside).select(*on, "v.det_id", "v.status")


def derived(det: DataFrame, name: str, threshold: float, *on: str) -> DataFrame:
    """on, n_compliant, n_non_compliant, compliance_rate (null without a verdict), for images with a verdict."""
    c, n = F.count_if(F.col("status") == COMPLIANT), F.count_if(F.col("status") == NON_COMPLIANT)
    return at_threshold(det, name, threshold, *on).groupBy(*on).agg(c.alias("n_compliant"), n.alias("n_non_compliant"), rate(c, c + n).alias("compliance_rate"))


def _in_order(status: str, iou: float) -> Column:
    """The status's verdicts in the order that they are matched in, each with its truths from the best on."""
    own = F.filter("truths", lambda t: t["status"] == status)

    def options(v: Column) -> Column:
        told = F.transform(own, lambda t, i: F.struct((-g.iou(_box(v), _box(t))).alias("o"), (-i).alias("k")))
        return F.array_sort(F.filter(told, lambda o: -o["o"] >= iou))

    rows = F.transform(F.filter("verdicts", lambda v: v["status"] == status), lambda v: F.struct((-v["score"]).alias("o"), *[v[f].alias(f) for f in ("cls", "x", "y", "w", "h", "det_id", "low", "high")], options(v).alias("options")))
    return F.array_sort(rows)


def _counts_at(rows: Column) -> Column:
    """At each end of an interval, from the highest down: threshold, verdicts and matched ones."""
    ends = F.reverse(F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform(rows, lambda v: v["high"]), F.transform(rows, lambda v: v["low"]))))))

    def at(t: Column) -> Column:
        active = F.filter(rows, lambda v: (v["high"] >= t) & (v["low"].isNull() | (v["low"] < t)))

        def take(taken: Column, v: Column) -> Column:
            free = F.get(F.filter(v["options"], lambda o: ~F.array_contains(taken, o["k"])), F.lit(0))
            return F.when(free.isNotNull(), F.concat(taken, F.array(free["k"]))).otherwise(taken)

        return F.struct(t.alias("t"), F.size(active).alias("n"), F.size(F.aggregate(active, F.array().cast("array<int>"), take)).alias("tp"))

    return F.transform(ends, at)


def _differences(states: str) -> Column:
    """What each state adds to the one above it."""
    before = lambda i, f: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(states), i - 1)[f])
    return F.transform(states, lambda s, i: F.struct(s["t"].alias("t"), (s["n"] - before(i, "n")).alias("n"), (s["tp"] - before(i, "tp")).alias("tp")))


def sweep(det: DataFrame, truth: DataFrame, name: str, *, split: str, arm: str = "arm", iou: float = 0.5, thresholds: list[float] | None = None) -> DataFrame:
    """arm, threshold, n_compliant, n_non_compliant, true_compliant, matched_bare_heads, n_bare_heads, bare_head_recall, compliance_precision.

    A row for each distinct score of an arm's detections (all classes), or for each of ``thresholds``. Verdicts over a threshold
    are matched one to one to truths of their status by (score desc, class, box), each to its best free truth from ``iou`` on,
    the last of equal ones. Recall and precision are null where there is nothing to divide by. Thresholds are chosen on
    validation data: a test split is refused, and so are detections of images without any truth.
    """
    if split.strip().lower() == "test":
        raise ValueError("thresholds are not chosen on the test split")
    if orphans := det.select("image_id").distinct().join(truth.select("image_id").distinct(), "image_id", "left_anti").take(1):
        raise ValueError(f"image {orphans[0][0]!r} has detections and no truth")
    status = F.coalesce(*[F.when(F.col("cls") == c, F.lit(s)) for c, s in STATUS_OF.items()])
    truths = truth.where(F.col("cls").isin(*STATUS_OF)).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ann_id", *"xywh", status.alias("status")))).alias("truths"))
    met = judged(det, name, arm, "image_id").join(truths, "image_id", "left")
    met = met.withColumn("truths", F.coalesce("truths", F.array().cast(truths.schema["truths"].dataType)))
    rows = met.select(arm, _in_order(COMPLIANT, iou).alias("c"), _in_order(NON_COMPLIANT, iou).alias("b"))
    states = rows.select(arm, _counts_at(F.col("c")).alias("c"), _counts_at(F.col("b")).alias("b"))
    diffs = states.select(arm, F.explode(F.concat(F.transform(_differences("c"), lambda s: F.struct(s["t"].alias("t"), s["n"].alias("nc"), s["tp"].alias("tc"), F.lit(0).alias("nb"), F.lit(0).alias("tb"))), F.transform(_differences("b"), lambda s: F.struct(s["t"].alias("t"), F.lit(0).alias("nc"), F.lit(0).alias("tc"), s["n"].alias("nb"), s["tp"].alias("tb"))))).alias("d")).select(arm, "d.*")
    asked = det.select(arm, F.col("score").cast("double").alias("t")).distinct() if thresholds is None else det.select(arm).distinct().select(arm, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("t"))
    zero = [F.lit(0).alias(c) for c in ("nc", "tc", "nb", "tb")]
    cells = diffs.withColumn("asked", F.lit(False)).unionByName(asked.select(arm, "t", *zero, F.lit(True).alias("asked")))
    cells = cells.groupBy(arm, "t").agg(*[F.sum(c).alias(c) for c in ("nc", "tc", "nb", "tb")], F.bool_or("asked").alias("asked")).withColumn("__o", -F.col("t"))
    summed = running_sums(cells, {c: f"__{c}" for c in ("nc", "tc", "nb", "tb")}, ["__o"], [arm]).where("asked")
    total = {c: F.col(c) + F.col(f"__{c}") for c in ("nc", "tc", "nb", "tb")}
    n = truth.agg(F.count_if(F.col("cls") == "head").alias("n_bare_heads"))
    out = summed.select(arm, F.col("t").alias("threshold"), total["nc"].alias("n_compliant"), total["nb"].alias("n_non_compliant"), total["tc"].alias("true_compliant"), total["tb"].alias("matched_bare_heads"))
    return out.crossJoin(F.broadcast(n)).select("*", rate(F.col("matched_bare_heads"), F.col("n_bare_heads")).alias("bare_head_recall"), rate(F.col("true_compliant"), F.col("n_compliant")).alias("compliance_precision"))
