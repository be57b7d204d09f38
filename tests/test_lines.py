"""Line grouping whose marks depend on earlier words, against brute force on a table of jittered boxes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pageloom.operators import lines

SF = "/root/testdata/sf0.001"


def boxes(seed=0, pages=6, n=80):
    r = np.random.default_rng(seed)
    return [
        (p, i, f"w{i}", int(x), int(y), int(x) + 30, int(y) + int(h), 900 + 100 * p)
        for p in range(pages)
        for i, (x, y, h) in enumerate(zip(r.integers(0, 900, n), r.integers(0, 60 * (p + 1), n), r.integers(3, 25, n), strict=True))
    ]


def brute(rows, mode):
    rows = [dict(zip(("page_num", "word_idx", "word", "x0", "y0", "x1", "y1", "height"), r, strict=True)) for r in rows]
    out = {}
    for p in {r["page_num"] for r in rows}:
        page = [r | {"c": (r["y0"] + r["y1"]) / 2} for r in rows if r["page_num"] == p]
        if mode == "anchor_reading_order":
            order, t, at = sorted(page, key=lambda r: r["word_idx"]), 20, "y0"
        elif mode == "smoothed":
            order, at = sorted(page, key=lambda r: (r["c"], r["x0"], r["word_idx"])), "c"
            t = max(4, int(sorted(r["y1"] - r["y0"] for r in page)[len(page) // 2] * 0.8))
        else:
            order, at = sorted(page, key=lambda r: (r["y0"], r["x0"], r["word_idx"])), "c"
            t = 18 if mode == "anchor_center" else 0.015 * page[0]["height"]
        made, mark = [], order[0][at]
        for r in order:
            if made and abs(r[at] - mark) <= t:
                made[-1].append(r)
            else:
                made.append([r])
                mark = mark if mode == "smoothed" else r[at]
            mark = (mark + r[at]) / 2 if mode == "smoothed" else made[-1][0][at]
        out |= {(p, r["word_idx"]): k for k, line in enumerate(made) for r in line}
    return out


@pytest.mark.parametrize("mode", sorted(lines.ANCHORED))
def test_group_lines(spark, mode):
    rows = boxes()
    df = spark.createDataFrame(rows, "page_num long, word_idx int, word string, x0 int, y0 int, x1 int, y1 int, height int")
    got = {(x.page_num, x.word_idx): x.line_id for x in lines.group_lines(df, mode).collect()}
    assert got == brute(rows, mode)
    assert lines.group_lines(df.limit(0), mode).count() == 0


@pytest.mark.parametrize("mode", sorted(lines.ANCHORED))
def test_line_queries_hold_every_word(spark, mode):
    words = entry.queries()["scan_pages_parquet"](spark, SF).select("page_num", "word_idx")
    got = entry.queries()["lines_" + mode](spark, SF)
    assert got.count() == words.count() == got.join(words, ["page_num", "word_idx"]).where(F.col("line_id") >= 0).count()


@pytest.mark.parametrize("mode", ["anchor_center", "smoothed"])
def test_long_page_with_a_line_a_word(spark, mode):
    """More lines than a block of the fold holds, many times over; a page's words all keep their own line."""
    n = 20_020
    i = F.col("id").cast("int")
    words = spark.range(n).select(
        F.lit(1).alias("page_num"), i.alias("word_idx"), F.lit(0).alias("x0"), (i * 30).alias("y0"), F.lit(5).alias("x1"), (i * 30 + 10).alias("y1")
    )
    assert lines.group_lines(words, mode).where("line_id <> word_idx or line_id is null").count() == 0
    assert lines.group_lines(words, mode).count() == n


def test_group_lines_of_nothing(spark):
    none = spark.createDataFrame([], "page_num int, word_idx int, x0 int, y0 int, x1 int, y1 int, height int")
    for mode in ("gap", *lines.ANCHORED):
        got = lines.group_lines(none, mode)
        assert got.columns == ["page_num", "word_idx", "line_id"] and got.count() == 0
