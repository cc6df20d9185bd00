"""What findings F11 to F25 say of growth, each on a small input: results by the definition, in bounded time or memory."""

import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from docloom.operators import cells, segment, selection
from docloom.streaming import limits


class Held:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value or []

    def put(self, value):
        self.value = value

    update, exists = put, lambda self: self.value is not None


class Handle:
    def getListState(self, *a):
        return Held()

    getValueState = getListState

    def listTimers(self):
        return []

    def registerTimer(self, at):
        pass


def replay(times, parts, seconds):
    usage, out = limits.Usage(seconds), []
    usage.init(Handle())
    for own in np.array_split(np.arange(len(times)), parts):
        frame = pd.DataFrame({"us": times[own], "id": own, "amount": own % 7})
        out.append(pd.concat(usage.handleInputRows(("k",), iter([frame]), None)))
    return pd.concat(out).sort_values("id")


def test_dense_windows_of_a_stream():
    """a window's totals do not cost its events each time; equal times, days and restarts as before."""
    rng = np.random.default_rng(3)
    times = np.sort(rng.integers(0, 3 * limits.DAY // 100, 400) * 100)
    got = replay(times, 4, 7200)
    for i, (at, row) in enumerate(zip(times, got.itertuples())):
        last = np.searchsorted(times, at, "right") if i >= 300 or np.searchsorted(times, at, "right") <= (i // 100 + 1) * 100 else (i // 100 + 1) * 100
        window = [j for j in range(last) if times[j] > at - 7200_000_000]
        day = [j for j in range(last) if times[j] // limits.DAY == at // limits.DAY]
        assert (row.requests, row.tokens, row.day_requests, row.day_tokens) == (len(window), sum(j % 7 for j in window), len(day), sum(j % 7 for j in day))
    start = time.process_time()
    found = replay(np.arange(40_000) * 1000, 2, 3600)
    assert time.process_time() - start < 10 and found.requests.tolist() == list(range(1, 40_001))


def test_first_cuts_close_to_the_rank(spark):
    """quantiles of few and of very unequal values, with rounds that narrow."""
    rng = random.Random(2)
    rows = [("a", float(rng.randint(0, 10**6))) for _ in range(9000)] + [("b", 1.0)] * 5000 + [("b", 10.0**i) for i in range(200)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    for q in (0.0, 0.5, 0.9, 1.0):
        got = {r.k: r.median for r in selection.exact_quantile(df, ["k"], "v", q, few=16).collect()}
        assert got["c"] is None and all(np.isclose(got[k], np.quantile([v for n, v in rows if n == k], q), rtol=1e-12) for k in "ab")


def test_lines_joined_before_shuffles(spark):
    """rows that are shuffled are runs of lines up to the next heading, over ranges' ends too."""
    lines = [f"H{i}." if i % 1999 == 0 else f"line {i}" for i in range(6001)]
    pages = spark.createDataFrame([(1, 1, "\n".join(lines)), (2, 1, ""), (3, 1, None), (4, 1, "x\r\n\r\ny")], "d int, p int, t string")
    heading = lambda x: segment.F.when(x.endswith("."), segment._heading(segment.F.lit(4), x, segment.F.lit(None)))
    runs = segment._runs(pages.select("d", segment.F.col("p").alias("__page"), segment.lines_keeping_ends(segment.F.col("t")).alias("__lines")), "d", heading)
    assert runs.where("d = 1").count() == 7
    blocks = segment.heading_blocks(pages, "d", "p", "t", heading).orderBy("d", "block").collect()
    assert [(r.d, r.block, r.h4, len(r.t.splitlines())) for r in blocks] == [(1, 1, "H0.", 1999), (1, 2, "H1999.", 1999), (1, 3, "H3998.", 1999), (1, 4, "H5997.", 4), (4, 1, None, 3)]
    assert "".join(r.t for r in blocks if r.d == 1) == "\n".join(lines)


def test_rows_by_cells_in_slices():
    """a table of rows x cells is made of some rows at a time."""
    x = np.random.default_rng(1).normal(size=(20_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(list(x))], names=["v"])
    centres = x[:512]
    tracemalloc.start()
    found = np.concatenate([cells.nearest(cells.matrix(b.column(0)), centres, True)[0] for b in cells.slices([batch])])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and (found == cells.nearest(x, centres, True)[0]).all()
