"""Mixtures of source groups whose weights change in a straight line over training steps."""

from __future__ import annotations

import math
import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.ordered import prefix_sum, range_join

VERSION = "granary-mixture-1"


def _weight(value, name: str) -> float:
    value = float(value)
    if not math.isfinite(value) or value < 0:
        raise ValueError(f"{name} must be a finite number of 0 or more")
    return value


def validated(config: dict) -> dict:
    """The configuration in full: version, curriculum_steps and groups of (sources, default, initial_weight, final_weight)."""
    if config.get("version", VERSION) != VERSION:
        raise ValueError(f"unknown mixture version: {config['version']}")
    groups = config.get("groups")
    if not groups or not isinstance(groups, dict):
        raise ValueError("a mixture needs at least one group")
    out, owner = {}, {}
    for name, g in groups.items():
        if not re.fullmatch(r"[\w-]+", name, re.ASCII):
            raise ValueError(f"bad group name: {name!r}")
        if not isinstance(g, dict):
            raise ValueError(f"group {name} is no object")
        sources = list(map(str, g.get("sources", ())))
        if twice := sorted({s for s in sources if s in owner}):
            raise ValueError(f"sources in more than one group: {twice}")
        owner |= dict.fromkeys(sources, name)
        ends = {k: _weight(g.get(k, 1.0), f"{name}.{k}") for k in ("initial_weight", "final_weight")}
        if not any(ends.values()):
            raise ValueError(f"group {name} has no weight at any step")
        out[name] = {"sources": sources, "default": bool(g.get("default", False)), **ends}
    if sum(g["default"] for g in out.values()) != 1:
        raise ValueError("exactly one group must be the default")
    for k in ("initial_weight", "final_weight"):
        if sum(g[k] for g in out.values()) <= 0:
            raise ValueError(f"the sum of {k} must be above 0")
    steps = int(config.get("curriculum_steps", 0))
    if steps < 0:
        raise ValueError("curriculum_steps can't be negative")
    return {"version": VERSION, "curriculum_steps": steps, "groups": out}


def two_groups(high_quality: list[str], steps: int, first: float = 0.8, last: float = 0.4) -> dict:
    """A mixture of high_quality sources and the rest (general), by the share of the former."""
    for x in (first, last):
        if _weight(x, "share") > 1:
            raise ValueError("a share can't be above 1")
    rich = {"sources": list(high_quality), "initial_weight": first, "final_weight": last}
    return validated({"curriculum_steps": steps, "groups": {"high_quality": rich, "general": {"default": True, "initial_weight": 1 - first, "final_weight": 1 - last}}})


def groups_table(spark: SparkSession, config: dict) -> DataFrame:
    """(grp, source, is_default, initial_weight, final_weight), a row a source; groups without one have a null source."""
    rows = [(name, s, g["default"], g["initial_weight"], g["final_weight"]) for name, g in validated(config)["groups"].items() for s in (g["sources"] or [None])]
    return spark.createDataFrame(rows, "grp string, source string, is_default boolean, initial_weight double, final_weight double")


def with_group(docs: DataFrame, config: dict, source: str = "source", into: str = "grp") -> DataFrame:
    """docs with the group of their source; other sources, null too, belong to the default group."""
    groups = validated(config)["groups"]
    default = next(n for n, g in groups.items() if g["default"])
    pairs = [(s, n) for n, g in groups.items() for s in g["sources"]]
    if not pairs:
        return docs.withColumn(into, F.lit(default))
    lookup = docs.sparkSession.createDataFrame(pairs, "__s string, __g string")  # as long as the configuration
    met = docs.join(F.broadcast(lookup), docs[source] == F.col("__s"), "left")
    return met.withColumn(into, F.coalesce("__g", F.lit(default))).drop("__s", "__g")


def progress(step: Column, steps: int) -> Column:
    """Share of the curriculum behind: 0 to 1, and 1 if it has no steps."""
    return F.lit(1.0) if steps == 0 else F.least(F.greatest(step / F.lit(float(steps)), F.lit(0.0)), F.lit(1.0))


def raw_weights(config: dict, step: Column) -> list[tuple[str, Column]]:
    c = validated(config)
    done = progress(step, c["curriculum_steps"])
    return [(n, F.lit(g["initial_weight"]) + F.lit(g["final_weight"] - g["initial_weight"]) * done) for n, g in c["groups"].items()]


def weights(steps: DataFrame, config: dict, step: str = "step") -> DataFrame:
    """(step, grp, weight): weights of a step add up to 1."""
    raw = raw_weights(config, F.col(step))
    total = sum((w for _, w in raw[1:]), raw[0][1])
    rows = F.array(*(F.struct(F.lit(n).alias("grp"), (w / total).alias("weight")) for n, w in raw))
    return steps.select(step, F.inline(rows))


def uniform(*parts: Column) -> Column:
    """A number from 0 to below 1 that depends on the parts only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def draw_groups(spark: SparkSession, config: dict, n: int, seed: int = 42, epoch: int = 0, start_step: int = 0, samples_per_step: int = 1, chunk: int = 1024, start: int = 0) -> DataFrame:
    """(sample, step, grp) of samples start..n-1: with replacement, by the weights at the middle of the sample's chunk.

    Numbers come from hashes of (seed + epoch, sample), so any range of samples can be made
    anew on its own: resuming at a sample is starting there.
    """
    if n < 1 or chunk < 1 or samples_per_step < 1:
        raise ValueError("n, chunk and samples_per_step must be 1 or more")
    i = F.col("sample")
    lo = F.expr(f"(sample div {chunk}) * {chunk}")
    middle = lo + (F.least(F.lit(chunk), F.lit(n) - lo) - 1) / 2
    base = spark.range(start, n).select(F.col("id").alias("sample")).withColumn("step", F.lit(start_step) + middle / samples_per_step)
    raw = raw_weights(config, F.col("step"))
    sums = list(accumulate((w for _, w in raw), lambda a, b: a + b))
    u = uniform(F.lit(seed + epoch), i, F.lit(0)) * sums[-1]
    pick = F.lit(raw[-1][0])
    for (name, _), upto in reversed(list(zip(raw[:-1], sums[:-1], strict=True))):
        pick = F.when(u < upto, F.lit(name)).otherwise(pick)
    return base.withColumn("grp", pick)


def sample_blocks(spark: SparkSession, config: dict, ranges: DataFrame, n: int, seed: int = 42, epoch: int = 0, **how) -> DataFrame:
    """(sample, grp, block_index): a group by weight, then one of its blocks, each with the same chance.

    ranges: (grp, start, end), the block numbers of each group; raises if a group has none.
    """
    sized = ranges.withColumn("__n", F.col("end") - F.col("start"))
    sizes = {r[0]: r[1] for r in sized.groupBy("grp").agg(F.sum("__n")).collect()}  # a row a group of the configuration
    if missing := [g for g in validated(config)["groups"] if not sizes.get(g)]:
        raise ValueError(f"groups without a block: {missing}")
    drawn = draw_groups(spark, config, n, seed, epoch, **how)
    size = F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv))
    at = drawn.withColumn("__at", F.floor(uniform(F.lit(seed + epoch), F.col("sample"), F.lit(1)) * size[F.col("grp")]).cast("long"))
    lined = prefix_sum(sized, "__n", ["start"], ["grp"], "__lo").withColumn("__hi", F.col("__lo") + F.col("__n"))
    met = range_join(at, lined, "__at", "__lo", "__hi", ["grp"])
    return met.select("sample", "grp", (F.col("start") + F.col("__at") - F.col("__lo")).alias("block_index"))


# Schedules


def warmed_up(step: Column, weight: float, warmup: int, start: int = 0) -> Column:
    """0 up to the start, then a straight line to `weight`, which it keeps."""
    active = step - start
    return F.when(active <= 0, 0.0).otherwise(F.lit(weight) * F.least(F.lit(1.0), active / float(max(warmup, 1))))


def suffix_weight(step: Column, weight: float, warmup: int, start: int = 0) -> Column:
    """1 up to the start, then a straight line to `weight`."""
    return F.lit(1.0) + warmed_up(step, weight - 1.0, warmup, start)


def learning_rate(step: Column, peak: float, floor: float, warmup: int, steps: int) -> Column:
    """Linear warm-up, cosine to the floor, and the floor from the last step on."""
    cosine = floor + 0.5 * (peak - floor) * (1 + F.cos(F.lit(math.pi) * (step - warmup) / max(steps - warmup, 1)))
    return F.when(step < warmup, peak * (step + 1) / max(warmup, 1)).when(step >= steps, F.lit(floor)).otherwise(cosine)


def round_up(x: Column, multiple: int) -> Column:
    return (F.ceil(x / multiple) * multiple).cast("long")
