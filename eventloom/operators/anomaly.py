"""Anomaly windows, signatures, style profiles, pattern catalogue and an isolation forest."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import checkpointed
from .ranks import exact_percentiles, null_safe_join, with_cohort_percentiles


def robust_z(rows: DataFrame, value: str, group: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Add robust_z = 0.6745 (x - median) / MAD: null below ``least`` values, 0 where MAD is 0.

    Medians by counting (:func:`.ranks.exact_percentiles`), so a group of any size, or the whole table, needs bounded memory;
    only one row per group is joined back.  A null value's z is null.
    """
    keys = list(group) or ["_all"]
    rows = rows if group else rows.withColumn("_all", F.lit(1))
    med = exact_percentiles(rows, keys, value, [0.5], ["_med"]).withColumnRenamed("n", "_n")
    near = null_safe_join(rows, med, keys, "left")
    mad = exact_percentiles(near, keys, F.abs(F.col(value) - F.col("_med")), [0.5], ["_mad"]).drop("n")
    z = F.when(F.col("_n") >= least, F.when(F.col("_mad") == 0, F.lit(0.0) * F.col(value)).otherwise(0.6745 * (F.col(value) - F.col("_med")) / F.col("_mad")))
    return null_safe_join(near, mad, keys, "left").withColumn("robust_z", z).drop("_med", "_mad", "_n", "_all")


def anomaly_windows(features: DataFrame, value: str = "max_speed", threshold: float = 4.0, least_coverage: float = 0.7, outlier: str | None = None) -> DataFrame:
    """Windows with enough coverage whose |robust z| reaches the threshold, or that are flagged outliers."""
    scored = robust_z(features.where(F.col("coverage") >= least_coverage), value)
    hit = F.abs("robust_z") >= threshold
    if outlier:
        hit = hit | F.coalesce(F.col(outlier), F.lit(False))
    return scored.where(F.coalesce(hit, F.lit(False)))


def window_signature(features: Sequence[str]) -> Column:
    """24 hex digits of the SHA-256 of the features in name order, two decimals each."""
    parts = [F.concat(F.lit(f"{n}="), F.format_string("%.2f", F.coalesce(F.col(n).cast("double"), F.lit(0.0)))) for n in sorted(features)]
    return F.substring(F.sha2(F.concat_ws(";", *parts), 256), 1, 24)


def cohort_percentile(value: str, over: Sequence[str] = ()) -> Column:
    """100 * share of the cohort with a value at most this one."""
    return F.cume_dist().over(Window.partitionBy(*over).orderBy(value)) * 100


# The components of a style profile, each a ratio of sums of a player's counters.
STYLE_RATES = {
    "offense": (["damage_dealt"], "seconds"),
    "survival": (["one"], "deaths"),
    "damage_efficiency": (["damage_dealt"], "damage_received"),
    "melee_precision": (["melee_hits", "kick_hits"], "swings"),
    "ranged_projectile_effectiveness": (["projectile_hits"], "shots_fired"),
    "defense": (["blocks"], "seconds"),
    "movement": (["active_distance"], "seconds"),
    "consistency": (["repeated"], "one"),
    "aggression": (["combat_events"], "seconds"),
    "staticness": (["static_seconds"], "seconds"),
    "block_roll_reliance": (["blocks", "rolls"], "seconds"),
}


def style_rates(players: DataFrame) -> DataFrame:
    """Add the eleven components of a player's style; a divisor below 1 counts as 1, missing counters as 0.

    ``players`` has sessions, playtime_s and the counters that :data:`STYLE_RATES` names (swings: melee_swings and kick_swings).
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    special = {"one": F.lit(1.0), "seconds": zero("playtime_s"), "swings": zero("melee_swings") + zero("kick_swings"), "repeated": (F.coalesce("sessions", F.lit(0)) >= 2).cast("double")}
    term = lambda c: special[c] if c in special else zero(c)
    rates = {}
    for name, (parts, by) in STYLE_RATES.items():
        top = term(parts[0])
        for part in parts[1:]:
            top = top + term(part)
        rates[name] = top / F.greatest(term(by), F.lit(1.0))
    return players.withColumns(rates)


def style_profiles(rates: DataFrame, player: str, sessions: str, components: Sequence[str], publish: int = 10) -> DataFrame:
    """Percentile of each component among the players, published from ``publish`` sessions on.

    Percentiles need two players; a player's confidence is min(1, sessions / ``publish``).  All components are
    ranked in one pass over ranges of values, so the number of players in a task is bounded.
    """
    n = rates.agg(F.count("*").alias("_n"))
    out = with_cohort_percentiles(rates, player, components).crossJoin(F.broadcast(n))
    out = out.withColumns({f"{c}_percentile": F.when(F.col("_n") >= 2, F.col(f"{c}_percentile")) for c in components})
    return out.withColumns({"confidence": F.least(F.lit(1.0), F.col(sessions) / publish), "published": F.col(sessions) >= publish}).drop("_n")


def candidate_state(occurrences: Column, players: Column, rounds: Column, agreement: Column, confidence: Column, artifacts: Column, confirm: int = 12) -> Column:
    """'active' for a pattern seen often, by several players in several rounds, and agreed upon; else 'candidate'."""
    active = (occurrences >= confirm) & (players >= 3) & (rounds >= 3) & (agreement >= 0.8) & (confidence >= 0.75) & (artifacts < 0.1)
    return F.when(active, "active").otherwise("candidate")


def signature_rollup(matches: DataFrame, confidence: float = 0.0, agreement: float = 0.0) -> DataFrame:
    """Per signature: occurrences, distinct players and rounds, state."""
    out = matches.groupBy("signature").agg(F.count("*").alias("occurrences"), F.count_distinct("player_id").alias("players"), F.count_distinct("round_id").alias("rounds"))
    return out.withColumn("state", candidate_state(F.col("occurrences"), F.col("players"), F.col("rounds"), F.lit(agreement), F.lit(confidence), F.lit(0.0)))


def accumulate_candidates(matches: DataFrame, confirm: int = 12) -> DataFrame:
    """Per signature: occurrences, largest confidence, first and last time, last evidence, confirmed."""
    order = F.struct("t_us", "event_id")
    return matches.groupBy("signature").agg(
        F.count("*").alias("occurrences"), F.max("confidence").alias("confidence"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.max_by("event_id", order).alias("last_evidence"), (F.count("*") >= confirm).alias("confirmed")
    )


def group_patterns(candidates: DataFrame) -> DataFrame:
    """Per family and state: largest confidence, occurrences and evidence rows."""
    return candidates.groupBy("family", "state").agg(F.max("confidence").alias("confidence"), F.sum("occurrences").alias("occurrences"), F.count("*").alias("evidence"))


def pattern_matches(windows: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Anomaly windows as matches with confidence min(1, |z| / threshold)."""
    return windows.withColumn("confidence", F.least(F.lit(1.0), F.abs("robust_z") / threshold))


def population_stability(expected: DataFrame, observed: DataFrame, bucket: str, floor: float = 1e-6) -> DataFrame:
    """One row: sum over buckets of (p - q) ln(p / q), shares floored so that empty buckets count."""
    share = lambda df, n: df.groupBy(bucket).count().crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select(bucket, (F.col("count") / F.col("_all")).alias(n))
    both = share(expected, "p").join(share(observed, "q"), bucket, "full").select(*(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(floor)).alias(c) for c in ("p", "q")))
    return both.agg(F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))).alias("psi"))


def should_drift(version_changed: Column, psi: Column, agreement: Column) -> Column:
    return version_changed | (psi > 0.25) | (agreement < 0.75)


def isolation_scores(rows: DataFrame, row_id: str, features: Sequence[str], trees: int = 50, sample: int = 256, contamination: float = 0.01, least: int = 20, seed: int = 17) -> DataFrame:
    """Isolation-forest scores and outlier flags.

    Each tree grows in a task of its own from ``sample`` rows drawn by hash; the forest (a bounded
    number of nodes) is sent to the tasks that score all rows.  The cut is the exact
    ``1 - contamination`` percentile, found by counting equal scores; with fewer than ``least`` rows nothing is an outlier.
    """
    names = list(features)
    total = rows.count()
    data = rows.select(row_id, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in names))
    share = min(1.0, 2.0 * sample / max(1, total))
    # a hash draws rows into ranges of trees: on a large table a row is drawn once or never, on one of a few rows once a tree
    rounds = min(trees, math.ceil(trees * share))
    each = math.ceil(trees / rounds)
    draws = data.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))) if rounds > 1 else data.withColumn("round", F.lit(0))
    draws = draws.withColumn("u", F.pmod(F.xxhash64(row_id, "round", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))
    draws = draws.withColumn("of", F.floor(F.col("u") / share)).withColumn("tree", (F.col("round") * each + F.col("of")).cast("int")).where((F.col("of") < each) & (F.col("tree") < trees))
    depth = int(np.ceil(np.log2(max(2, sample))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", row_id]).head(sample)
        rng = np.random.default_rng(seed + int(pdf["tree"].iloc[0]))
        nodes: list[list[float]] = []

        def split(x: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, level + _path(len(x))])
            spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
            if level < depth and len(x) > 1 and len(spread):
                k = int(rng.choice(spread))
                cut = float(rng.uniform(x[:, k].min(), x[:, k].max()))
                below = x[:, k] < cut
                left, right = split(x[below], level + 1), split(x[~below], level + 1)
                nodes[at][:4] = [k, cut, left, right]
            return at

        split(pdf[names].to_numpy(float), 0)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
        return out.assign(tree=pdf["tree"].iloc[0], node=np.arange(len(nodes)))

    forest = draws.groupBy("tree").applyInPandas(grow, "feature double, cut double, left double, right double, path double, tree int, node long").orderBy("tree", "node").toPandas()
    grown = [g[["feature", "cut", "left", "right", "path"]].to_numpy() for _, g in forest.groupby("tree")]
    norm = _path(min(sample, max(2, total)))

    def score(batches):
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            paths = np.zeros(len(x))
            for tree in grown:
                at = np.zeros(len(x), int)
                inner = tree[at, 0] >= 0
                while inner.any():
                    i = np.flatnonzero(inner)
                    node = tree[at[i]]
                    below = x[i, node[:, 0].astype(int)] < node[:, 1]
                    at[i] = np.where(below, node[:, 2], node[:, 3]).astype(int)
                    inner = tree[at, 0] >= 0
                paths += tree[at, 4]
            yield pd.DataFrame({row_id: pdf[row_id], "score": 2.0 ** (-paths / max(1, len(grown)) / norm)})

    scored = checkpointed(data.mapInPandas(score, f"{row_id} {rows.schema[row_id].dataType.simpleString()}, score double"))
    found = exact_percentiles(scored, [], "score", [1 - contamination], ["cut"]).first()
    cut = float("inf") if found is None else found["cut"]
    return scored.select(row_id, "score", (F.col("score") > cut) & F.lit(total >= least)).toDF(row_id, "score", "outlier")


def _path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n
