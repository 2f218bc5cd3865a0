"""Ordered funnel counting: every first step starts an attempt, which follows the earliest later row of each next kind within a time limit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written

#: name, kinds of the steps in order, kind that ends an attempt.
FUNNELS = (
    ("A", ("view", "click", "view", "purchase"), "error"),
    ("B", ("signup", "view", "click", "purchase"), "error"),
    ("C", ("click", "click", "purchase", "view"), "signup"),
)
LIMIT = 15 * 60 * 1_000_000
STEPS = 4
#: Rows of one group, about. A client beyond LEAST_HOT rows and its share of all rows, 1 / HOT, is cut into stretches of time of about ROWS rows.
ROWS, LEAST_HOT, HOT = 4096, 8192, 10_000
#: A hot client's times are counted in cells of 1/32 to 1/64 of their value (some 900 up to the limit), then in parts of FINE microseconds of the
#: cell that holds the median (2048 at most), then one by one.
TOP_BITS, FINE = 6, 1 << 13
TIMES = [f"t{k}" for k in range(2, STEPS + 1)]
COUNTS = [f"n{k}" for k in range(1, STEPS + 1)]


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    since = ts.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    parts = F.extract(F.lit("DAY"), since) * 24 + F.extract(F.lit("HOUR"), since)
    return (parts.cast("long") * 60 + F.extract(F.lit("MINUTE"), since)) * 60_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")


def _kth(values: np.ndarray) -> int:
    """The ceil(n / 2)-th smallest."""
    k = (len(values) + 1) // 2 - 1
    return int(np.partition(values, k)[k])


def cells_of(times: np.ndarray) -> tuple[list[int], list[int]]:
    """The cells of times, and the number in each: how many low bits are cut off, and what is left."""
    cut = np.maximum(np.frexp(times.astype(float))[1] - TOP_BITS, 0)
    cell, n = np.unique((cut << TOP_BITS) + (times >> cut), return_counts=True)
    return cell.tolist(), n.tolist()


def chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """Attempts of the clients of one group. The last columns hold a hot client's times, whose order statistics other groups take part in."""
    clients, of = np.unique(pdf["client_id"].to_numpy(), return_inverse=True)
    stretch, at = pdf["stretch"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64)
    order = np.lexsort((at, stretch, of))
    of, stretch, at = of[order], stretch[order], at[order]
    kind, own = pdf["kind"].to_numpy()[order], pdf["own"].to_numpy()[order]
    fresh = np.r_[True, (np.diff(of) != 0) | (np.diff(stretch) != 0)]
    unit = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    # one axis for all clients: gaps up to the limit are exact, longer ones and those between clients are just over it
    axis = np.cumsum(np.where(fresh, LIMIT + 1, np.minimum(np.diff(at, prepend=at[:1]), LIMIT + 1)))
    rows = {k: np.unique(axis[kind == k]) for k in {x for _, steps, stop in FUNNELS for x in (*steps, stop)}}
    out = []
    for name, steps, stop in FUNNELS:
        mine = (kind == steps[0]) & own
        starts, index = np.unique(axis[mine], return_index=True)
        owner, now = unit[mine][index], starts
        n = [np.bincount(owner, minlength=len(first))]
        times: list[list[np.ndarray]] = []
        for step in steps[1:]:
            later, ends = rows[step], rows[stop]
            i = np.searchsorted(later, now, side="right")
            held = i < len(later)
            then = np.where(held, later[np.minimum(i, len(later) - 1)] if len(later) else 0, 0)
            j = np.searchsorted(ends, now, side="right")
            stopped = (j < len(ends)) & ((ends[np.minimum(j, len(ends) - 1)] if len(ends) else 0) <= then)
            held &= (then - now <= LIMIT) & ~stopped
            took, owner, now = (then - now)[held], owner[held], then[held]
            n.append(np.bincount(owner, minlength=len(first)))
            times.append(np.split(took, np.cumsum(n[-1])[:-1]))
        for u in np.flatnonzero(n[0]):
            hot = stretch[first[u]] >= 0
            found = [t[u] for t in times]
            out.append((name, clients[of[first[u]]], *(int(c[u]) for c in n), *(_kth(t) if len(t) and not hot else None for t in found), bool(hot), *(x for t in found for x in ((t.tolist(), *cells_of(t)) if hot else (None,) * 3))))
    columns = ["funnel", "client_id", *COUNTS, *TIMES, "hot", *(f"{x}{k}" for k in range(2, STEPS + 1) for x in ("d", "cell", "in_cell"))]
    return pd.DataFrame(out, columns=columns).astype({t: "Int64" for t in TIMES})


def grouped(clicks: DataFrame) -> DataFrame:
    """Distinct rows with their group: a cold client is whole in one group, a hot one is cut into stretches that also see the rows that attempts
    of theirs can reach. Stretches of one client are as wide as the reach of an attempt at least; a task holds one of them, twice at most."""
    kinds = sorted({x for _, steps, stop in FUNNELS for x in (*steps, stop)})
    rows = clicks.select("client_id", "kind", micros(F.col("ts")).alias("at")).where(F.col("client_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(kinds)).distinct()
    sizes = Written(rows.groupBy("client_id").agg(F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("span")), "funnel-sizes", slim=True).df
    total = sizes.agg(F.sum("n")).first()[0] or 0
    reach = (STEPS - 1) * LIMIT
    width = F.greatest(F.lit(reach), F.least(F.lit(86_400_000_000), (F.col("span") / F.ceil(F.col("n") / ROWS)).cast("long")))
    hot = sizes.where(F.col("n") > max(LEAST_HOT, total // HOT)).select("client_id", width.alias("width"))  # HOT clients at most
    rows = rows.join(F.broadcast(hot), "client_id", "left")
    here = F.floor(F.col("at") / F.col("width"))
    ahead = F.floor((F.col("at") - reach) / F.col("width"))
    one = F.struct(F.lit(-1).cast("long").alias("stretch"), F.lit(True).alias("own"))
    mine = F.struct(F.pmod(here, F.lit(1 << 40)).alias("stretch"), F.lit(True).alias("own"))
    seen = F.struct(F.pmod(ahead, F.lit(1 << 40)).alias("stretch"), F.lit(False).alias("own"))
    where = F.when(F.col("width").isNull(), F.array(one)).when(here == ahead, F.array(mine)).otherwise(F.array(mine, seen))
    rows = rows.select("client_id", "kind", "at", F.inline(where))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("client_id", "stretch"), F.lit(max(1, total // ROWS))))


def _holding(counts: DataFrame, ranks: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """For each key, the value at which its rank `k` is reached, and the rank among the rows of that value."""
    counts = counts.groupBy(*keys, value).agg(F.sum("n").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy(*keys).orderBy(value))
    return counts.join(ranks, keys).withColumn("up_to", up_to).where("up_to >= k and up_to - n < k").select(*keys, value, (F.col("k") - F.col("up_to") + F.col("n")).alias("k"))


def medians(found: DataFrame, totals: DataFrame) -> DataFrame:
    """t2 to t4 of hot clients. Groups have counted their times in cells; only times of the cell that holds the median are looked at one by one."""
    keys, steps = ["funnel", "client_id"], range(2, STEPS + 1)
    each = [*keys, "step"]
    named = lambda *x: F.inline(F.array(*(F.struct(F.lit(k).alias("step"), *(F.col(f"{c}{k}").alias(c) for c in x)) for k in steps)))
    ranks = totals.select(*keys, named("n")).where("n > 0").select(*each, F.ceil(F.col("n") / 2).alias("k"))
    counts = found.select(*keys, named("cell", "in_cell")).select(*each, F.inline(F.arrays_zip("cell", F.col("in_cell").alias("n"))))
    at = _holding(counts, ranks, "cell", each)  # a row for each hot client, funnel and step
    low = F.expr(f"shiftleft(cell & {(1 << TOP_BITS) - 1}L, cast(cell >> {TOP_BITS} as int))")
    at = at.select(*each, "k", low.alias("low"), (low + F.expr(f"shiftleft(1L, cast(cell >> {TOP_BITS} as int))")).alias("high"))
    times = found.select(*keys, named("d")).join(F.broadcast(at.drop("k")), each)
    times = times.select(*each, F.explode(F.filter("d", lambda x: (x >= F.col("low")) & (x < F.col("high")))).alias("d"), "low").groupBy(*each, "low", "d").agg(F.count("*").alias("n"))
    times = times.withColumn("part", F.floor((F.col("d") - F.col("low")) / FINE))
    parts = _holding(times, at.select(*each, "k"), "part", each)
    exact = _holding(times.join(F.broadcast(parts.drop("k")), [*each, "part"]), parts.select(*each, "k"), "d", each)
    return exact.groupBy(*keys).agg(*(F.max(F.when(F.col("step") == k, F.col("d"))).alias(f"t{k}") for k in steps))


def count_funnels(clicks: DataFrame) -> DataFrame:
    """One row for each funnel and client with attempts: attempts that reach each step, the deepest step, medians of the microseconds from step
    to step, and the number of clients of the same funnel and depth.

    Rows with a null client_id, kind or ts and kinds of no funnel are left out; repeated rows count once; later columns are ignored. Times of one
    instant do not follow one another. A client with a large part of all rows is spread over tasks; its medians are found by counting in cells of
    time, then within the cell that holds the median: the limit of a step bounds both counts. An empty table gives no row.
    """
    kind = dict(clicks.dtypes)["client_id"]
    n, t = (", ".join(f"{c} long" for c in x) for x in (COUNTS, TIMES))
    d = ", ".join(f"{x}{k} array<long>" for k in range(2, STEPS + 1) for x in ("d", "cell", "in_cell"))
    found = Written(grouped(clicks).groupBy("bucket").applyInPandas(chains, f"funnel string, client_id {kind}, {n}, {t}, hot boolean, {d}"), "funnel-chains").df
    keys = ["funnel", "client_id"]
    hot = found.where("hot").groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTS))
    columns = [*keys, *COUNTS, *TIMES]
    every = found.where("not hot").select(columns).unionByName(hot.join(medians(found.where("hot"), hot), keys, "left").select(columns))
    deepest = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in COUNTS), F.lit(0)).cast("int")
    every = Written(every.withColumn("deepest", deepest), "funnel-clients", slim=True).df
    depths = every.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))  # twelve rows at most
    return every.join(F.broadcast(depths), ["funnel", "deepest"]).select(*keys, *COUNTS, "deepest", *TIMES, "same_depth")
