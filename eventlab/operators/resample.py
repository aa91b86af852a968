"""Bootstrap and randomised benchmarks, seeded by md5 so that the result does not
depend on partitioning, retries or the number of executors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import number_rows, number_sorted, percentiles
from ..schemas import KPIS, RETURN
from ..storage import stored
from .portfolio import COST, RUN, backtest_kpis

#: Trades of a block, which draws its share by itself.
BLOCK = 64
#: Blocks in a row that one group draws from.
PART = 4
#: Pairs of a rep's draws that are counted at a time, and digests that are made at a time.
STRETCH = 1 << 19
DIGESTS = 1 << 14
#: Candidates of a day and seed that one task ranks.
DAY_PART = 4096
#: Standard deviations by which the limit of the draws is set beyond what a day needs.
SPARE = 2.5


def block_draws(sizes: DataFrame, reps: int, seed: int) -> DataFrame:
    """How often each rep draws each block: ``_run, rep, _block, _draws``, from ``_run`` and its number of trades ``_size``.

    A digest makes two picks, for the draws 2p and 2p + 1; an odd last draw stands alone. A task counts whole
    stretches of a rep's draws, `STRETCH` pairs of them, so a row stands for as many draws as meet in a block.
    """
    schema = T.StructType(
        [sizes.schema["_run"], T.StructField("rep", T.IntegerType()), T.StructField("_block", T.LongType()), T.StructField("_draws", T.LongType())]
    )

    def counted(rep: int, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros((size - 1) // BLOCK + 1, np.int64)
        last = min(first + STRETCH, (size + 1) // 2)
        for low in range(first, last, DIGESTS):
            high = min(low + DIGESTS, last)
            made = np.frombuffer(b"".join([md5(b"%d|%d|%d" % (seed, rep, p)).digest() for p in range(low, high)]), np.uint8).reshape(-1, 16)
            picks = [np.ascontiguousarray(made[:, i : i + 8]).view(">u8").ravel().astype(np.uint64) for i in (0, 7)]
            places = np.concatenate([picks[0] >> np.uint64(4), (picks[1] & np.uint64((1 << 60) - 1))[: size // 2 - low]]) % np.uint64(size)
            counts += np.bincount((places // np.uint64(BLOCK)).astype(np.int64), minlength=len(counts))
        blocks = np.flatnonzero(counts)
        return blocks, counts[blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (rep, first, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rep", "_first", "_size")), strict=True)):
                blocks, draws = counted(rep, first, size)
                same = batch.column("_run").take(pa.array(np.full(len(blocks), i)))
                yield pa.RecordBatch.from_arrays([same, pa.array(np.full(len(blocks), rep, np.int32)), pa.array(blocks), pa.array(draws)], names=schema.names)

    stretches = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_size") - 1) / 2), F.lit(STRETCH).cast("bigint"))
    work = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_first", F.explode(stretches))
    # A few small rows are much work: a number of tasks is named, as Spark would join them by their bytes.
    tasks = max(64, 4 * sizes.sparkSession.sparkContext.defaultParallelism)
    return work.select("_run", "rep", "_first", "_size").repartition(tasks, "_run", "rep", "_first").mapInArrow(run, schema)


def bootstrap_trades(
    trades: DataFrame,
    reps: int = 2000,
    seed: int = 42,
    keys: Sequence[str] = RUN,
    ret: str = RETURN,
) -> DataFrame:
    """``reps`` resamples with replacement, each as large as the run, with ``rep`` as a key.

    Trades are numbered by day and cut into blocks of `BLOCK`. First every draw picks a block, by a hash, in proportion
    to its trades; only the number of draws per (rep, block) is kept, summed up where it arises. Then every block draws
    that many of its own trades, by another hash. So no draw is shuffled, and as a task takes `PART` blocks in a row and
    blocks follow the days, a day's draws of a rep are summed up in the task that makes them.
    """
    keys = list(keys)
    slim = trades.select(*keys, "date", "symbol", ret)
    numbered = number_sorted(slim, keys, ["date", "symbol", ret], "_place")
    at = F.col("_place") - 1
    part = F.floor(at / (BLOCK * PART)).alias("_part")
    run = stored(numbered.select(F.struct(*keys).alias("_run"), part, at.alias("_at"), "date", "symbol", F.col(ret).alias("_ret")), "numbered")
    sizes = run.groupBy("_run").agg(F.count("*").alias("_size"))
    drawn = block_draws(sizes, reps, seed).withColumn("_part", F.floor(F.col("_block") / PART))
    schema = T.StructType([*(slim.schema[k] for k in keys), T.StructField("rep", T.IntegerType()), *(slim.schema[c] for c in ("date", "symbol", ret))])

    def draw(counts: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("_at")
        rep, block, draws = (counts.column(c).to_numpy() for c in ("rep", "_block", "_draws"))
        # A digest makes four picks inside a block.
        quads = (draws + 3) // 4
        made = b"".join(
            [md5(b"own|%d|%d|%d|%d" % (seed, r, b, q)).digest() for r, b, n in zip(rep.tolist(), block.tolist(), quads.tolist(), strict=True) for q in range(n)]
        )
        picks = np.frombuffer(made, ">u4").astype(np.int64)
        row = np.repeat(np.arange(len(rep)), 4 * quads)
        kept = np.arange(len(row)) - np.repeat(4 * (np.cumsum(quads) - quads), 4 * quads) < draws[row]
        row, picks = row[kept], picks[kept]
        place = own.column("_at").to_numpy() // BLOCK
        first = np.searchsorted(place, block, "left")
        size = np.searchsorted(place, block, "right") - first
        found = own.take(pa.array(first[row] + picks % size[row]))
        names = [found.column("_run").combine_chunks().field(i) for i in range(len(keys))] if keys else []
        return pa.table([*names, pa.array(rep[row]), *(found.column(c) for c in ("date", "symbol", "_ret"))], names=schema.names)

    group = ["_run", "_part"]
    return drawn.groupBy(*group).cogroup(run.groupBy(*group)).applyInArrow(draw, schema)


def bootstrap_kpis(
    trades: DataFrame,
    reps: int = 2000,
    seed: int = 42,
    keys: Sequence[str] = RUN,
    ret: str = RETURN,
    cost: float = COST,
    cap: float | None = None,
) -> DataFrame:
    """The KPIs of every resample."""
    return backtest_kpis(bootstrap_trades(trades, reps, seed, keys, ret), [*keys, "rep"], ret, cost, cap)


def confidence_interval(
    samples: DataFrame, metrics: Sequence[str] = KPIS, level: float = 0.95, keys: Sequence[str] = RUN
) -> DataFrame:
    """Percentile interval of each metric, one row per (keys, metric)."""
    tail = (1 - level) / 2
    named = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    )
    values = samples.select(*keys, named.alias("_m")).select(*keys, "_m.*")
    bounds = percentiles(values, [*keys, "metric"], "value", (tail, 1 - tail))
    return bounds.select(*keys, "metric", F.col("p")[0].alias("lower"), F.col("p")[1].alias("upper")).withColumn(
        "includes_zero", (F.col("lower") <= 0) & (F.col("upper") >= 0)
    )


def exposure_matched_trades(
    candidates: DataFrame, trades: DataFrame, seeds: int = 20, keys: Sequence[str] = RUN
) -> DataFrame:
    """Per seed and day as many random candidates as the run really traded, all of them if there are fewer.

    They are the candidates with the smallest hashes of (seed, date, symbol). A hash below a limit that the day's
    counts set is likely among them, so a candidate is multiplied only by the seeds for which its own is; days and
    seeds for which too few are (about one in a hundred) get the hashes above the limit as well.
    """
    keys = list(keys)
    day = F.struct(*keys, "date")
    wanted = trades.groupBy(day.alias("_day")).agg(F.count("*").alias("_wanted"))
    offered = candidates.groupBy(day.alias("_day")).agg(F.count("*").alias("_offered"))
    days = stored(wanted.join(offered, "_day"), "days")
    pool = candidates.withColumn("_day", day).join(days, "_day")
    limit = (F.col("_wanted") + SPARE * F.sqrt("_wanted") + 1) / F.col("_offered")

    def draw(seed: Column) -> Column:
        return F.md5(F.concat_ws("|", seed, "date", "symbol"))

    def share(hexed: Column) -> Column:
        return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint") / 2.0**32

    every = F.sequence(F.lit(0), F.lit(seeds - 1))
    low = F.filter(every, lambda seed: share(draw(seed)) < limit)
    columns = [*candidates.columns, "_day", "_wanted", "_offered", "seed"]
    near = stored(pool.withColumn("seed", F.explode(low)).select(*columns), "draws")
    found = near.groupBy("_day", "seed").agg(F.count("*").alias("_found"))
    short = (
        days.withColumn("seed", F.explode(every))
        .join(found, ["_day", "seed"], "left")
        .where(F.coalesce("_found", F.lit(0)) < F.least("_wanted", "_offered"))
        .select("_day", "seed")
    )
    far = pool.join(short, "_day").where(share(draw(F.col("seed"))) >= limit).select(*columns)
    # A day is cut into equal ranges of the hash, one for every `DAY_PART` candidates.
    drawn = near.unionByName(far).withColumn("_draw", draw(F.col("seed")))
    bucket = F.floor(share(F.col("_draw")) * F.ceil(F.col("_offered") / DAY_PART))
    ranked = number_rows(drawn, [*keys, "seed", "date"], bucket, ["_draw", "symbol"], "_place")
    return ranked.where(F.col("_place") <= F.col("_wanted")).select(*candidates.columns, "seed")


def exposure_matched_random(
    candidates: DataFrame,
    trades: DataFrame,
    seeds: int = 20,
    keys: Sequence[str] = RUN,
    ret: str = RETURN,
    cost: float = COST,
    cap: float | None = 0.2,
) -> DataFrame:
    """KPIs of the random portfolios, averaged over the seeds."""
    drawn = exposure_matched_trades(candidates, trades, seeds, keys)
    per_seed = backtest_kpis(drawn, [*keys, "seed"], ret, cost, cap)
    return per_seed.groupBy(*keys).agg(*[F.avg(k).alias(k) for k in KPIS], F.count("*").alias("seeds"))


def seeded_ticker_sample(df: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """n symbols in hash order, all of them if there are fewer."""
    draw: Column = F.md5(F.concat_ws("|", F.lit(seed), F.col("symbol").cast("string")))
    return df.select("symbol").distinct().orderBy(draw, "symbol").limit(n)
