"""Synthetic applicants, closed-form scorers and interventions. Draws are hashes, so SQL can replay them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paritas.functions.scalars import clip, hash_unit, k_of, normal, poisson, sigmoid, tie_key

FEATURES = ("score_a", "publications", "score_b", "score_c", "score_d", "narrative_sentiment")
#: Weights of the features, and their distributions (mean, deviation) and centres.
BETAS = {"score_a": 0.030, "publications": 0.080, "score_b": 0.180, "score_c": 0.120, "score_d": 0.080, "narrative_sentiment": 1.200}
NORMALS = {"score_a": (250.0, 10.0), "score_b": (3.6, 0.25), "score_c": (0.0, 1.0), "score_d": (0.0, 1.0)}
RATE = 3.0
CENTRES = {"score_a": 250.0, "publications": 3.0, "score_b": 3.6}
#: Label, mean sentiment of group 0, of group 1.
ANCHORINGS = (
    ("instrument_a_lexicon", 0.18, 0.78), ("instrument_b_transformer", 0.02, 0.23),
    ("instrument_c_llm_judge", -0.40, 0.55), ("instrument_d_llm_judge_alternative", -0.22, 0.55),
)
DISCLOSURE_RATES = (0.0, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 1.0)


@dataclass(frozen=True)
class Config:
    n: int = 6000
    invite_rate: float = 0.30
    sd: float = 0.30
    betas: dict = field(default_factory=lambda: dict(BETAS))


def parse_anchoring(text: str) -> tuple[str, float, float]:
    """``label:low:high``."""
    parts = text.split(":")
    if len(parts) != 3:
        raise ValueError(f"expected label:low:high, not {text!r}")
    return parts[0], float(parts[1]), float(parts[2])


def contributions(betas: dict = BETAS) -> list[Column]:
    return [F.lit(betas[f]) * (F.col(f) - F.lit(CENTRES[f]) if f in CENTRES else F.col(f)) for f in FEATURES]


def linear_score(betas: dict = BETAS) -> Column:
    return sigmoid(sum(contributions(betas)[1:], contributions(betas)[0]))


def power_score(power: int, betas: dict = BETAS) -> Column:
    """Signed powers of the contributions, summed."""
    parts = [F.signum(c) * F.pow(F.abs(c), F.lit(float(power))) for c in contributions(betas)]
    return sigmoid(sum(parts[1:], parts[0]))


def applicants(ids: DataFrame, seed: Column | int, low: Column | float, high: Column | float, sd: float = 0.30, rep: Column | None = None, cfg: Config = Config()) -> DataFrame:
    """``ids`` (a column ``id``) with group, features and label. Group 0 has mean sentiment ``low``, group 1 ``high``."""
    at = (seed if isinstance(seed, Column) else F.lit(seed), *(() if rep is None else (rep,)), F.col("id"))
    number = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    out = ids.withColumn("group", F.when(hash_unit(*at, F.lit("group")) < 0.5, 0).otherwise(1))
    out = out.withColumns({f: normal(m, s, *at, F.lit(f)) for f, (m, s) in NORMALS.items()} | {"publications": poisson(RATE, *at, F.lit("publications"))})
    out = out.withColumn("narrative_sentiment", clip(normal(F.when(F.col("group") == 0, number(low)).otherwise(number(high)), sd, *at, F.lit("sentiment"))))
    return out.withColumn("label", (hash_unit(*at, F.lit("label")) < linear_score(cfg.betas)).cast("int"))


def stratified_split(df: DataFrame, strata: Sequence[str], keys: Sequence[str], test: float = 0.3, seed: int = 0, cells: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``is_test``: rint(test * n) rows of each stratum, by hash order."""
    w = Window.partitionBy(*cells, *strata)
    rows = df.withColumn("rk_", F.row_number().over(w.orderBy(tie_key(seed, *map(F.col, keys))))).withColumn("n_", F.count(F.lit(1)).over(w))
    return rows.withColumn("is_test", F.col("rk_") <= k_of(test, F.col("n_"), 0)).drop("rk_", "n_")


def counterfactual(df: DataFrame, high: Column | float, sd: float, seed: int, keys: Sequence[str] = ("id",), apply: Column | None = None) -> DataFrame:
    """Group 0 (or the rows of ``apply``) draws its sentiment anew from the distribution of group 1."""
    new = clip(normal(high if isinstance(high, Column) else float(high), sd, F.lit(seed), F.lit("cf"), *map(F.col, keys)))
    return df.withColumn("narrative_sentiment", F.when((F.col("group") == 0) if apply is None else apply, new).otherwise(F.col("narrative_sentiment")))


def disclosure(df: DataFrame, rates: Sequence[float], high: float, sd: float, seed: int, cells: Sequence[str] = ()) -> DataFrame:
    """For each rate: exactly rint(rate * n0) rows of group 0, by hash order, draw their sentiment anew."""
    w = Window.partitionBy(*cells, "group")
    rows = df.withColumn("rk_", F.row_number().over(w.orderBy(tie_key(seed, F.lit("disclose"), F.col("id"))))).withColumn("n_", F.count(F.lit(1)).over(w))
    table = F.broadcast(df.sparkSession.createDataFrame([(float(r),) for r in rates], "rate double"))
    rows = rows.crossJoin(table)
    chosen = (F.col("group") == 0) & (F.col("rk_") <= k_of(F.col("rate"), F.col("n_"), 0))
    return counterfactual(rows, high, sd, seed, ("id",), chosen).withColumn("disclosed", chosen.cast("int")).drop("rk_", "n_")


def corpus_grid(spark: SparkSession, seeds: Sequence[str], races: Sequence[str], genders: Sequence[str], tiers: Sequence[str], instances: int) -> DataFrame:
    """All combinations with running ids PS0001, PS0002, ... in the order of the arguments."""
    sizes = [len(seeds), len(races), len(genders), len(tiers), instances]
    total = 1
    for s in sizes:
        total *= s
    at, out = F.col("id"), spark.range(total)
    columns, below = {}, total
    for name, values in (("seed_key", seeds), ("race", races), ("gender", genders), ("school_tier", tiers)):
        below //= len(values)
        columns[name] = F.get(F.array(*map(F.lit, values)), (F.floor(at / below) % len(values)).cast("int"))
    columns["instance"] = (at % instances + 1).cast("int")
    return out.withColumns(columns).select(F.format_string("PS%04d", at + 1).alias("applicant_id"), "seed_key", "race", "gender", "school_tier", "instance")
