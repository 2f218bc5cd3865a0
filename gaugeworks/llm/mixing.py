"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

Each document of a source wants rate = target / source size copies (3 at most). The whole part is copied outright; the fractional parts are
rounded by a weighted pivotal scheme: two fractional documents meet, words move from one to the other in a random direction until one of
them has a whole number of copies, and the other goes on to the next meeting. A meeting keeps the pair's expected words and each one's
expected copies. Documents meet in blocks of about BLOCK of one source; the one left over in each block goes to the next level of a
reduction tree, until a source has one left, which goes to the nearer whole number. So a source misses its target by half of one document at most.

Random numbers and blocks are hashes of ids, sizes, levels and a number within equal rows: reruns agree wherever the rows lie. Ids keep their
type. Sizes of null texts are 0, and such documents are never taken. A null source is a source of its own, last in order. Repeated rows are
separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Written

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
BLOCK = 64
#: Equal rows numbered at once.
CHUNK = 1000
#: The table of sources is broadcast up to this many rows (about 100 bytes each); beyond it, it is joined by a salted shuffle.
BROADCAST_SOURCES = 20_000
SALTS = 64


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: its size, and its target after the excess over MOST_COPIES times its size is reshared by weight (water filling)."""
    stats = sizes.groupBy("__source").agg(F.sum("__size").alias("__total"), F.count("*").alias("__docs"))
    # one row per source from here on, so the windows over all rows see the table of sources only
    order = Window.orderBy(F.col("__source").isNull(), "__source")
    weights = F.array(*map(F.lit, WEIGHTS))
    stats = stats.withColumn("__w", F.get(weights, (F.row_number().over(order) - 1) % len(WEIGHTS)))
    # the sources with the least cap per weight fill up first; a source is full if the level reached with those before it full passes its cap
    stats = stats.withColumn("__cap", F.lit(MOST_COPIES) * F.col("__total")).withColumn("__need", F.col("__cap") / F.col("__w"))
    by_need = Window.orderBy("__need", F.col("__source").isNull(), "__source")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("__total").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    weight_left = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0))
    stats = stats.withColumn("__level", left / weight_left).withColumn("__rank", F.row_number().over(by_need))
    # the first source that the level does not fill ends the filling; ranks before it are full
    stop = F.min(F.when(F.col("__level") <= F.col("__need"), F.struct("__rank", "__level"))).over(everything)
    target = F.when(stop.isNull() | (F.col("__rank") < stop["__rank"]), F.col("__cap").cast("double")).otherwise(F.col("__w") * stop["__level"])
    return stats.select("__source", F.col("__total"), "__docs", target.alias("__target"))


def _uniform(*cols):
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _meet(state, item, level: int):
    """One meeting of the carried document a with the item b. Fields: id, n (copies so far), p (fraction), s (size)."""
    a, b = state["held"], item
    low, high = (lambda x: x["p"] * x["s"]), (lambda x: (1 - x["p"]) * x["s"])
    up, down = F.least(high(a), low(b)), F.least(low(a), high(b))
    rise = _uniform(a["key"], b["key"], a["s"], b["s"], F.lit(level)) * (up + down) < down

    def moved(x, p, whole):
        return F.struct(x["key"].alias("key"), x["id"].alias("id"), x["source"].alias("source"), (x["n"] + whole).cast("long").alias("n"), p.alias("p"), x["s"].alias("s"))

    def settled(x, p):
        return F.when((p > 1e-12) & (p < 1 - 1e-12), moved(x, p, F.lit(0))).otherwise(moved(x, F.lit(0.0), F.when(p > 0.5, 1).otherwise(0)))

    pa = F.when(rise, F.when(high(a) <= low(b), 1.0).otherwise(a["p"] + up / a["s"])).otherwise(F.when(low(a) <= high(b), 0.0).otherwise(a["p"] - down / a["s"]))
    pb = F.when(rise, F.when(low(b) <= high(a), 0.0).otherwise(b["p"] - up / b["s"])).otherwise(F.when(high(b) <= low(a), 1.0).otherwise(b["p"] + down / b["s"]))
    return settled(a, pa), settled(b, pb)


def _reduce_blocks(rows: DataFrame, level: int) -> DataFrame:
    """Rows (key, id, source, n, p, s, block) to one row per block: the settled documents and the one carried on, if any."""
    item = F.struct("key", "id", "source", "n", "p", "s")
    id_kind, source_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "source"))
    kind = f"struct<key:bigint,id:{id_kind},source:{source_kind},n:bigint,p:double,s:bigint>"
    blocks = rows.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("o"), F.col("key").alias("k"), item.alias("x")))).alias("xs"))

    def step(state, entry):
        b = entry["x"]
        a_next, b_next = _meet(state, b, level)
        first = state["held"].isNull()
        pair = F.array(a_next, b_next)
        held = F.when(first, b).otherwise(F.get(F.filter(pair, lambda x: x["p"] > 0), F.lit(0)))
        done = F.when(first, state["done"]).otherwise(F.concat(state["done"], F.filter(pair, lambda x: x["p"] <= 0)))
        return F.struct(held.cast(kind).alias("held"), done.cast(f"array<{kind}>").alias("done"))

    start = F.struct(F.lit(None).cast(kind).alias("held"), F.array().cast(f"array<{kind}>").alias("done"))
    return blocks.select("source", "block", F.aggregate("xs", start, step).alias("r")).select("source", "block", "r.held", "r.done")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per document: id, its size in words, its source's size and target, copies and words taken."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), size.alias("__size"))
    # equal rows are counted and dealt out again with numbers, so that nothing depends on where a row lies; in two steps, as arrays of CHUNK at most
    counted = Written(slim.groupBy("__id", "__source", "__size").agg(F.count("*").alias("__n")), "mix-sizes")
    parts = counted.df.withColumn("__lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(CHUNK).cast("long"))))
    rows = parts.withColumn("__row", F.explode(F.sequence(F.col("__lo"), F.least(F.col("__lo") + CHUNK, F.col("__n")) - 1))).drop("__n", "__lo")
    sources = Written(source_targets(rows), "mix-sources").df
    if sources.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(sources), rows["__source"].eqNullSafe(sources["__source"])).drop(sources["__source"])
    else:
        salted = sources.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__id", "__size", "__row"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, rows["__source"].eqNullSafe(salted["__source"]) & (rows["__salt"] == salted["__salt"])).drop(salted["__source"]).drop(salted["__salt"]).drop("__salt")
    rate = F.when(F.col("__total") > 0, F.least(F.col("__target") / F.col("__total"), F.lit(float(MOST_COPIES)))).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    fraction = F.greatest(rate - whole, F.lit(0.0))
    fixed = joined.select(
        F.xxhash64("__id", "__size", "__row").alias("key"),
        F.col("__id").alias("id"),
        F.col("__source").alias("source"),
        F.when(F.col("__size") > 0, whole).otherwise(0).cast("long").alias("n"),
        F.when((F.col("__size") > 0) & (fraction > 1e-9), fraction).otherwise(0.0).alias("p"),
        F.col("__size").alias("s"),
        "__docs",
    )
    block = F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), F.ceil(F.col("__docs") / BLOCK))).cast("long")
    done = [fixed.where("p <= 0").select("id", "source", "n", "s")]
    pending, level = fixed.where("p > 0").withColumn("block", block).drop("__docs"), 0
    while True:
        result = Written(_reduce_blocks(pending, level), f"mix-level{level}").df
        done.append(result.select(F.explode("done").alias("x")).select("x.id", "x.source", "x.n", "x.s"))
        carried = result.where("held is not null").select("held.*", "block")
        most = carried.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            last = F.col("n") + F.when(F.col("p") >= 0.5, 1).otherwise(0)
            done.append(carried.select("id", "source", last.cast("long").alias("n"), "s"))
            break
        # block numbers of a source are dense from 0, so their quotients by BLOCK are the next level's blocks
        pending, level = carried.withColumn("block", F.floor(F.col("block") / BLOCK).cast("long")), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    source_row = sources.select("__source", F.col("__total").cast("long").alias("source_size"), F.col("__target").alias("target"))
    if sources.count() <= BROADCAST_SOURCES:
        out = out.join(F.broadcast(source_row), out["source"].eqNullSafe(source_row["__source"]))
    else:
        salted = source_row.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.withColumn("__salt", F.pmod(F.xxhash64("id", "s"), F.lit(SALTS)).cast("int"))
        out = out.join(salted, out["source"].eqNullSafe(salted["__source"]) & (out["__salt"] == salted["__salt"]))
    return out.select(F.col("id").alias(id_col), F.col("s").alias("size"), "source_size", "target", F.col("n").alias("copies"), (F.col("n") * F.col("s")).alias("taken"))
