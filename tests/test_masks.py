"""Run-length masks against plain loops, and strings that the format fixes."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import rle
from marlstone.operators import sampling


def plain_counts(pixels):
    out, at = [], "0"
    for p in pixels:
        if not out:
            out = [0]
        if p != at:
            out.append(0)
            at = p
        out[-1] += 1
    return out


def plain_text(counts):
    out = ""
    for i, n in enumerate(counts):
        x = n - counts[i - 2] if i > 2 else n
        more = True
        while more:
            c, x = x & 31, x >> 5
            more = x != (-1 if c & 16 else 0)
            out += chr((c | 32 if more else c) + 48)
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    out = ["", "0", "1", "0" * 500, "1" * 500, "01" * 40]
    for _ in range(120):
        out.append("".join(rng.choice("01") * rng.choice([1, 2, 7, 40, 1200]) for _ in range(rng.randrange(1, 30))))
    return out


def test_round_trip_and_format(spark, made):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(made)], "i int, m string").withColumn("counts", rle.from_pixels(F.col("m"))).withColumn("code", rle.encode(F.col("counts")))
    got = df.select("i", "counts", "code", rle.to_pixels(rle.decode(F.col("code"))).alias("back"), rle.area(F.col("counts")).alias("area")).collect()
    for r in got:
        m = made[r.i]
        assert r.counts == plain_counts(m) and r.code == plain_text(plain_counts(m)) and r.back == m and r.area == m.count("1")


def test_fixed_strings(spark):
    known = [([6, 1, 40, 4, 5, 4, 5, 4, 21], "61X13mN000`0"), ([0, 9], "09"), ([5], "5")]
    for counts, text in known:
        r = spark.range(1).select(rle.encode(F.array(*[F.lit(x).cast("long") for x in counts])).alias("t"), rle.decode(F.lit(text)).alias("c")).first()
        assert r.t == text and r.c == counts
    with pytest.raises(Exception, match="ends within a number"):
        spark.range(1).select(rle.decode(F.lit("61X"))).collect()


def test_overlap_iou_and_bounds(spark, made):
    rng = random.Random(5)
    h = 10
    pairs = [("".join(rng.choice("0001") * rng.randrange(1, 6) for _ in range(80))[:120].ljust(120, "0"), "".join(rng.choice("011") * rng.randrange(1, 9) for _ in range(80))[:120].ljust(120, "0")) for _ in range(60)] + [("0" * 120, "0" * 120), ("1" * 120, "0" * 120)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").withColumns({"a": rle.from_pixels(F.col("a")), "b": rle.from_pixels(F.col("b"))})
    for r in df.select("i", rle.overlap(F.col("a"), F.col("b")).alias("o"), rle.mask_iou(F.col("a"), F.col("b")).alias("iou"), rle.mask_iou(F.col("a"), F.col("b"), F.lit(True)).alias("crowd"), rle.bounds(F.col("a"), F.lit(h)).alias("box")).collect():
        a, b = pairs[r.i]
        shared, either = sum(x == y == "1" for x, y in zip(a, b)), sum("1" in (x, y) for x, y in zip(a, b))
        assert r.o == shared and r.iou == pytest.approx(shared / either if either else 0) and r.crowd == pytest.approx(shared / a.count("1") if "1" in a else 0)
        at = [(p // h, p % h) for p, v in enumerate(a) if v == "1"]
        want = None if not at else (min(x for x, _ in at), min(y for _, y in at), max(x for x, _ in at) - min(x for x, _ in at) + 1, max(y for _, y in at) - min(y for _, y in at) + 1)
        assert (None if r.box is None else tuple(r.box)) == want


def test_weighted_sequence(spark):
    assert sampling.largest_remainder({"a": 1, "b": 1, "c": 1}, 4) == {"a": 2, "b": 1, "c": 1}
    assert sampling.largest_remainder({"a": 0, "b": 0.7, "c": 0.3}, 10) == {"a": 0, "b": 7, "c": 3} and sampling.largest_remainder({"a": 0}, 0) == {"a": 0}
    weights = {"x": 5, "y": 3, "z": 0.5}
    runs = []
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        runs.append([r.name for r in sampling.weighted_sequence(spark, weights, 203, 11).orderBy("position").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    quota = {k: 1 + v for k, v in sampling.largest_remainder(weights, 200).items()}
    assert runs[0] == runs[1] and {k: runs[0].count(k) for k in weights} == quota and runs[0] != sorted(runs[0])
    two = [r.name for r in sampling.weighted_sequence(spark, weights, 2, 11).collect()]
    assert len(set(two)) == 2
    with pytest.raises(ValueError):
        sampling.largest_remainder({"a": 0}, 3)
