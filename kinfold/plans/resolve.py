"""The resolution loop.

Token frequencies are fixed before the loop and a score depends on neither the
threshold nor the iteration, so candidates are scored once; an iteration only
filters that table by the references still open. References of good clusters
leave; the rest meet again at a stricter threshold, until the threshold passes
1, or no candidates or no links are left.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.config import Parameters, read_parameters, summary
from kinfold.operators import blocking, evaluate, frequency, report, scoring
from kinfold.runtime import checkpoint, stored
from kinfold.sources import delimited

ITERATION = "iteration int, mu double, epsilon double, candidate_pairs bigint, links bigint, clusters bigint, refs_in_clusters bigint, clusters_over_one bigint, good_clusters bigint, refs_in_good bigint"


@dataclass
class Resolution:
    """What a run gives: the index, good members, one dict an iteration, and iteration profiles if asked for."""

    index: DataFrame
    good: DataFrame
    iterations: list[dict] = field(default_factory=list)
    profiles: list[DataFrame] = field(default_factory=list)

    def run_stats(self, spark: SparkSession) -> DataFrame:
        """The iterations as rows, and their sums in a last row with a null iteration."""
        names = [x.split()[0] for x in ITERATION.split(", ")]
        rows = [tuple(i[n] for n in names) for i in self.iterations]
        each = spark.createDataFrame(rows, ITERATION)
        sums = ("candidate_pairs", "links", "refs_in_good")
        total = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
        return each.unionByName(total, allowMissingColumns=True)


def prepare(references: DataFrame, p: Parameters) -> DataFrame:
    """The references as (ref_id, toks with frequencies), tokenized once and materialised."""
    lists = stored(frequency.token_lists(references, p).select("ref_id", "toks"), "tokens")
    return checkpoint(frequency.reform(frequency.positions(lists)))


def scored_candidates(refs: DataFrame, p: Parameters) -> DataFrame:
    return scoring.score_pairs(blocking.candidate_pairs(refs, p), refs, p)


def resolve(references: DataFrame, p: Parameters) -> Resolution:
    """Run the loop over (ref_id, body)."""
    p.checked()
    refs = prepare(delimited.require_unique(references), p)
    scores = checkpoint(scored_candidates(refs, p))
    spark = references.sparkSession
    good = spark.createDataFrame([], "ref_id string, cluster_id string")
    out = Resolution(index=refs, good=good)
    mu, epsilon = Decimal(p.mu), Decimal(p.epsilon)
    while mu <= 1:
        done = good.select("ref_id")
        live = scores.join(done.withColumnRenamed("ref_id", "r1"), "r1", "left_anti").join(done.withColumnRenamed("ref_id", "r2"), "r2", "left_anti")
        linked = F.col("score") >= float(mu)
        n_pairs, n_links = live.agg(F.count("*"), F.count_if(linked)).first()
        if not n_pairs:
            break
        step = dict.fromkeys([x.split()[0] for x in ITERATION.split(", ")], 0)
        step |= {"iteration": len(out.iterations) + 1, "mu": float(mu), "epsilon": float(epsilon), "candidate_pairs": n_pairs, "links": n_links}
        out.iterations.append(step)
        if not n_links:
            break
        members = checkpoint(evaluate.clusters(live.where(linked)))
        quality = checkpoint(evaluate.cluster_quality(members, refs, float(epsilon)))
        seen = quality.agg(
            F.count("*").alias("clusters"), F.sum("n_refs").alias("refs_in_clusters"), F.count_if(F.col("n_refs") > 1).alias("clusters_over_one"),
            F.count_if("is_good").alias("good_clusters"), F.coalesce(F.sum(F.when(F.col("is_good"), F.col("n_refs"))), F.lit(0)).alias("refs_in_good"),
        ).first()
        step |= seen.asDict()
        good = checkpoint(good.unionByName(evaluate.split_members(members, quality, True)))
        if p.runIterationProfile:
            out.profiles.append(report.cluster_profile(report.linked_index(refs, good)))
        if not p.muIterate and not seen["good_clusters"]:
            break  # nothing would change any more
        mu, epsilon = mu + Decimal(p.muIterate), epsilon + Decimal(p.epsilonIterate)
    out.good, out.index = good, report.linked_index(refs, good)
    return out


def run(spark: SparkSession, parms_path: str, out: str | None = None) -> Resolution:
    """Resolve the files that a parameter file names; with ``out``, write index, profile, statistics and accuracy there."""
    p = read_parameters(parms_path)
    references = delimited.read_references(spark, p.inputFileName, p)
    result = resolve(references, p)
    if out:
        index = report.with_bodies(result.index, references) if p.addRefsToLinkIndex else result.index
        index.write.mode("overwrite").parquet(f"{out}/linked_index")
        report.write_index(result.index, f"{out}/linked_index_text")
        report.cluster_profile(result.index).write.mode("overwrite").parquet(f"{out}/cluster_profile")
        result.run_stats(spark).write.mode("overwrite").parquet(f"{out}/run_stats")
        frequency.tokenization_stats(references, p).write.mode("overwrite").parquet(f"{out}/tokenization_stats")
        freq = frequency.token_frequency(frequency.tokens(references, p))
        frequency.frequency_stats(freq).write.mode("overwrite").parquet(f"{out}/frequency_stats")
        spark.createDataFrame(summary(p), "name string, value string").write.mode("overwrite").parquet(f"{out}/parameters")
        log = [f"{k}: {v}" for i in result.iterations for k, v in i.items()]
        spark.createDataFrame([(line,) for line in [*(f"{n}={v}" for n, v in summary(p)), *log]], "line string").coalesce(1).write.mode("overwrite").text(f"{out}/log")
        residual = residual_refs(references, result)
        residual.write.mode("overwrite").parquet(f"{out}/residual")
        for i, profile in enumerate(result.profiles, 1):
            profile.write.mode("overwrite").parquet(f"{out}/profile_{i}")
        if p.truthFileName:
            report.er_matrix(result.index, delimited.read_truth(spark, p.truthFileName)).write.mode("overwrite").parquet(f"{out}/er_matrix")
    return result


def residual_refs(references: DataFrame, result: Resolution) -> DataFrame:
    """References of bad clusters and of none."""
    return references.join(result.good.select("ref_id"), "ref_id", "left_anti")
