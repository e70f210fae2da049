"""Evaluation results: rollups, comparison of reports, paired differences, bootstrap intervals.

Results are rows (id, benchmark, category, score, correct). Metrics over model outputs
take tables of losses, log-probabilities or scores, whoever made them.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rollups


def rollup(results: DataFrame) -> DataFrame:
    """(scope, name, count, mean_score, correct) by category and by benchmark, in one pass."""
    sets = results.groupingSets([["category"], ["benchmark"]], "category", "benchmark")
    out = sets.agg(F.grouping("category").alias("__no_category"), F.count("*").alias("count"), F.avg("score").alias("mean_score"), F.count_if(F.coalesce("correct", F.lit(False))).alias("correct"))
    by_category = F.col("__no_category") == 0
    return out.select(F.when(by_category, "category").otherwise("benchmark").alias("scope"), F.when(by_category, F.col("category")).otherwise(F.col("benchmark")).alias("name"), "count", "mean_score", "correct")


def summary(results: DataFrame) -> DataFrame:
    """One row: samples, micro_score (mean of scores), macro_score (mean of the categories' means), correct."""
    by = results.groupBy("category").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.count_if(F.coalesce("correct", F.lit(False))).alias("c"))
    return by.agg(F.sum("n").alias("samples"), F.try_divide(F.sum("s"), F.sum("n")).alias("micro_score"), F.avg(F.col("s") / F.col("n")).alias("macro_score"), F.sum("c").alias("correct"))


def compare_categories(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(category, current, baseline, delta) over the categories of either; delta is null where one lacks it."""
    mean = lambda df, name: df.groupBy("category").agg(F.avg("score").alias(name))
    both = mean(current, "current").join(mean(baseline, "baseline"), "category", "full_outer")
    return both.withColumn("delta", F.col("current") - F.col("baseline"))


def compare_summaries(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: macro_delta, micro_delta."""
    a, b = summary(current).first(), summary(baseline).first()  # one row each
    gap = lambda k: None if a[k] is None or b[k] is None else a[k] - b[k]
    return current.sparkSession.createDataFrame([(gap("macro_score"), gap("micro_score"))], "macro_delta double, micro_delta double")


def below(results: DataFrame, least: float) -> bool:
    """Whether the macro score misses a floor."""
    score = summary(results).first()["macro_score"]
    return score is None or score < least


def regressed(current: DataFrame, baseline: DataFrame, most: float) -> bool:
    """Whether the macro score fell by more than `most`."""
    gap = compare_summaries(current, baseline).first()["macro_delta"]
    return gap is None or gap < -most


# Comparability of reports

_SUITE = ("suite_version", "tokenizer_sha256", "benchmark_sha256")
_RUN = ("model_config", "global_step")


def differing(current: dict, baseline: dict, names=_SUITE) -> list[str]:
    """Fields in which two reports (or their metadata) differ; null equals null only."""
    value = lambda r, k: r.get(k, r.get("metadata", {}).get(k))
    return [k for k in names if value(current, k) != value(baseline, k)]


def check_comparable(current: dict, baseline: dict) -> None:
    if bad := differing(current, baseline):
        raise ValueError(f"the reports can't be compared; they differ in {', '.join(bad)}")


def check_ablation(candidate: dict, baseline: dict) -> None:
    """Everything but the auxiliary losses must be the same, the data fingerprint included."""
    check_comparable(candidate, baseline)
    if bad := differing(candidate, baseline, _RUN):
        raise ValueError(f"the ablation differs in {', '.join(bad)}")
    prints = [r.get("metadata", {}).get("data_fingerprint_sha256") for r in (candidate, baseline)]
    if not all(prints) or prints[0] != prints[1]:
        raise ValueError("an ablation needs the same data fingerprint on both sides")
    recipes = [r.get("metadata", {}).get("training_recipe") for r in (candidate, baseline)]
    if not all(isinstance(r, dict) for r in recipes):
        raise ValueError("an ablation needs metadata.training_recipe on both sides")
    fixed = [{k: v for k, v in r.items() if k not in ("experiment_name", "auxiliary_losses")} for r in recipes]
    if fixed[0] != fixed[1]:
        raise ValueError("the training recipes differ in more than their auxiliary losses")


# Paired differences


def id_differences(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id, side): ids that only one of the two has; missing: the candidate lacks it."""
    a, b = candidate.select("id").distinct(), baseline.select("id").distinct()
    return b.join(a, "id", "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(b, "id", "left_anti").withColumn("side", F.lit("extra")))


def pair_problems(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id, problem) of all that stands against pairing two results."""
    keep = lambda df, p: df.select("id", F.col("category").alias(f"{p}_category"), F.col("score").cast("double").alias(f"{p}_score"), F.lit(True).alias(f"{p}_has"))
    sides = []
    for df in (candidate, baseline):
        sides.append(df.groupBy("id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.coalesce(F.col("id").cast("string"), F.lit("")) == "")).select("id", F.lit("bad or repeated id").alias("problem")))
    both = keep(candidate, "c").join(keep(baseline, "b"), "id", "full_outer")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < math.inf), F.lit(False))
    kind = (
        F.when(F.col("c_has").isNull(), "missing").when(F.col("b_has").isNull(), "extra")
        .when(~F.col("c_category").eqNullSafe(F.col("b_category")), "category differs")
        .when(~finite(F.col("c_score")) | ~finite(F.col("b_score")), "score is not finite")
    )
    return sides[0].unionByName(sides[1]).unionByName(both.select("id", kind.alias("problem")).where("problem is not null"))


def paired_deltas(candidate: DataFrame, baseline: DataFrame, check: bool = True) -> DataFrame:
    """(id, category, baseline, candidate, delta); raises if the two don't pair up, unless told not to look."""
    if check:
        problems = pair_problems(candidate, baseline).orderBy("problem", "id").limit(20).collect()
        if problems:
            raise ValueError(f"results don't pair up: {[(r['id'], r['problem']) for r in problems]}")
    a = candidate.select("id", "category", F.col("score").cast("double").alias("candidate"))
    b = baseline.select("id", F.col("score").cast("double").alias("baseline"))
    return a.join(b, "id").select("id", "category", "baseline", "candidate", (F.col("candidate") - F.col("baseline")).alias("delta"))


def paired_summary(deltas: DataFrame) -> DataFrame:
    """(category, samples, mean_delta, wins, ties, losses): each category, and all as a null category."""
    d = F.col("delta")
    return deltas.groupingSets([["category"], []], "category").agg(
        F.count("*").alias("samples"), F.avg("delta").alias("mean_delta"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.grouping("category").alias("overall")
    )


def bootstrap_mean(values: list[float], samples: int = 10_000, seed: int = 42, confidence: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean of resamples, from the Mersenne Twister's stream."""
    if not values or samples < 1 or not 0 < confidence < 1:
        raise ValueError("a bootstrap needs values, a resample or more, and a confidence between 0 and 1")
    draw, n = random.Random(seed).randrange, len(values)
    means = sorted(math.fsum(values[draw(n)] for _ in range(n)) / n for _ in range(samples))
    tail = (1 - confidence) / 2
    at = lambda i: means[min(max(i, 0), samples - 1)]
    return at(int(tail * samples)), at(int((1 - tail) * samples) - 1)


def bootstrap(deltas: DataFrame, samples: int = 10_000, seed: int = 42, candidate: int = 0) -> DataFrame:
    """(category, ci95_low, ci95_high): each category, and all as a null category.

    A task resamples one category, from its deltas in the order of id, with a seed of its
    own, so the numbers don't depend on the cluster. The size is that of an evaluation
    suite, not of a corpus.
    """
    number = Window.orderBy("category")
    seeds = deltas.select("category").distinct().withColumn("__seed", F.row_number().over(number) + F.lit(seed + candidate * 1000))  # a row a category
    each = deltas.join(seeds, "category").select("category", "id", "delta", "__seed", F.lit(False).alias("overall"))
    whole = deltas.select(F.lit(None).cast("string").alias("category"), "id", "delta", F.lit(seed + candidate).alias("__seed"), F.lit(True).alias("overall"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        low, high = bootstrap_mean(part["delta"].tolist(), samples, int(part["__seed"].iloc[0]))
        return pd.DataFrame({"category": [part["category"].iloc[0]], "ci95_low": [low], "ci95_high": [high]})

    return each.unionByName(whole).groupBy("overall", "category").applyInPandas(run, "category string, ci95_low double, ci95_high double")


def markdown(rows: list[dict], columns: dict[str, str]) -> str:
    """A table of a few rows; columns: heading by name. Missing values read N/A."""
    cell = lambda v: "N/A" if v is None or (isinstance(v, float) and not math.isfinite(v)) else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns.values()) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


# Metrics over model outputs


def perplexity(batches: DataFrame, most: int | None = None) -> DataFrame:
    """One row of (batch, loss, tokens): exp of the token-weighted mean loss of the first batches; raises without a token."""
    used = batches if most is None else batches.orderBy("batch").limit(most)
    w = F.sum("tokens")
    return used.agg(F.when(w > 0, F.exp(F.sum(F.col("loss") * F.col("tokens")) / w)).otherwise(F.raise_error(F.lit("no token to measure")).cast("double")).alias("perplexity"), w.alias("tokens"))


def mean_eval_loss(batches: DataFrame, most: int = 50) -> DataFrame:
    """The plain mean over the first `most` batches."""
    return batches.orderBy("batch").limit(most).agg(F.avg("loss").alias("eval_loss"))


def continuation_scores(tokens: DataFrame, keys: list[str], context: int | None = None) -> DataFrame:
    """(keys, total_logprob, mean_logprob, tokens) over the continuation of each sequence.

    tokens: (keys, pos, is_prompt, logprob), pos from 0, logprob of the token given those
    before. With more than `context` tokens the first ones are cut off, and one token at
    least has to stay as a prompt. Without a continuation the scores are minus infinity.
    """
    size = F.count("*").over(Window.partitionBy(*keys))
    prompt = F.sum(F.col("is_prompt").cast("long")).over(Window.partitionBy(*keys))
    cut = F.greatest(size - context, F.lit(0)) if context else F.lit(0).cast("long")
    wide = tokens.withColumns({"__cut": cut, "__prompt": prompt})
    start = F.col("__cut") + F.greatest(F.col("__prompt") - F.col("__cut"), F.lit(1))
    mine = F.when(F.col("pos") >= start, F.col("logprob"))
    none = F.lit(-math.inf)
    return wide.groupBy(*keys).agg(F.coalesce(F.sum(mine), none).alias("total_logprob"), F.coalesce(F.avg(mine), none).alias("mean_logprob"), F.count(mine).alias("tokens"))


def choose(scores: DataFrame, sample: str = "id", choice: str = "choice", answer: str = "answer") -> DataFrame:
    """(sample, prediction, correct): the choice of the best mean log-probability (total, if length_normalize is false), the first of equals."""
    normal = F.col("length_normalize") if "length_normalize" in scores.columns else F.lit(True)
    metric = F.when(F.coalesce(normal, F.lit(True)), F.col("mean_logprob")).otherwise(F.col("total_logprob"))
    best = F.max_by(F.col(choice), F.struct(metric.alias("m"), (-F.col(choice)).alias("i")))
    return scores.groupBy(sample).agg(best.alias("prediction"), F.first(answer).alias("answer")).withColumn("correct", F.col("prediction") == F.col("answer"))


def prefer(pairs: DataFrame) -> DataFrame:
    """(id, margin, correct) of (id, chosen, rejected) scores; a margin of 0 is not correct."""
    return pairs.select("id", (F.col("chosen") - F.col("rejected")).alias("margin"), (F.col("chosen") > F.col("rejected")).alias("correct"))


def weighted_loss(tokens: DataFrame, weight: Column, pad: int = 0) -> DataFrame:
    """One row: weighted mean loss of (token_id, loss, role) without padding, and the plain means of roots and suffixes."""
    live = tokens.where(F.col("token_id") != pad)
    mean = lambda role: F.avg(F.when(F.col("role") == role, F.col("loss")))
    return live.agg((F.coalesce(F.sum(F.col("loss") * weight), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(weight), F.lit(0.0)), F.lit(1.0))).alias("loss"), mean("root").alias("root_loss"), mean("suffix").alias("suffix_loss"))


# Filters of generation


def top_k(scores: DataFrame, k: int, within: list[str], score: str = "score") -> DataFrame:
    """The k best rows of each group; all that tie with the last stay."""
    return scores.withColumn("__rank", F.rank().over(Window.partitionBy(*within).orderBy(F.desc(score)))).where(F.col("__rank") <= k).drop("__rank")


def nucleus(scores: DataFrame, p: float, within: list[str], keep_crossing: bool = True, prob: str = "prob", token: str = "token_id") -> DataFrame:
    """Rows of the most probable tokens that make up `p`; the token that crosses it stays or goes by `keep_crossing`."""
    w = Window.partitionBy(*within).orderBy(F.desc(prob), token)
    wide = scores.withColumn("__upto", F.sum(prob).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return wide.where((F.col("__upto") - F.col(prob) if keep_crossing else F.col("__upto")) <= p).drop("__upto")


def banned_next(ids: Column, n: int) -> Column:
    """Tokens that would repeat an n-gram: all that followed the last n-1 tokens earlier on."""
    size = F.size(ids)
    tail = F.slice(ids, F.greatest(size - n + 2, F.lit(1)), n - 1) if n > 1 else F.array().cast("array<int>")
    starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.slice(ids, i, n - 1) == tail) if n > 1 else starts
    return F.array_sort(F.array_distinct(F.transform(hits, lambda i: F.element_at(ids, i + n - 1))))
