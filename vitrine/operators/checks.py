"""Checks of a catalogue: declared constraints in one report, stored features against fresh ones, a log of profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import vectors

# ------------------------------------------------------------ quality report


@dataclass(frozen=True)
class Constraint:
    """A rule that every row must keep: ``holds`` as a condition (null counts as broken), how bad a breach is, and whether it asks for a rebuild."""

    name: str
    severity: str
    holds: Column
    rebuild: bool = False


def missing_columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """issue, severity, n, sample, rebuild for wanted columns that aren't there or are of another type."""
    have = dict(rows.dtypes)
    found = [(f"missing_column:{c}" if c not in have else f"wrong_type:{c}", "error", 1, have.get(c, ""), True) for c, kind in wanted.items() if have.get(c) != kind]
    return rows.sparkSession.createDataFrame(found, "issue string, severity string, n long, sample string, rebuild boolean")


def quality_report(rows: DataFrame, key: str, constraints: list[Constraint], unique: tuple[str, ...] = (), sample: int = 5) -> DataFrame:
    """issue, severity, n, sample (the first keys, joined by commas), rebuild: a row for each constraint that is broken.

    Every row is looked at once and gives the names of what it breaks; counts and
    samples are cut before they meet.  ``unique`` columns must not repeat a value
    (nulls aside); all but the smallest key of a value are in breach.
    """
    names = F.array(*[F.when(~F.coalesce(c.holds, F.lit(False)), F.lit(i)) for i, c in enumerate(constraints)])
    broken = rows.select(F.col(key).alias("key"), F.explode(F.array_compact(names)).alias("nth"))
    for i, column in enumerate(unique, len(constraints)):
        first = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
        again = rows.join(first, F.col(column) == F.col("value")).where(F.col(key) != F.col("first")).select(F.col(key).alias("key"), F.lit(i).alias("nth"))
        broken = broken.unionByName(again)
    counts = broken.groupBy("nth").agg(F.count("*").alias("n"))
    some = broken.withColumn("place", F.row_number().over(Window.partitionBy("nth").orderBy("key"))).where(F.col("place") <= sample)
    some = some.groupBy("nth").agg(F.array_join(F.transform(F.array_sort(F.collect_list("key")), lambda k: k.cast("string")), ",").alias("sample"))
    told = [*constraints, *(Constraint(f"repeated:{c}", "error", F.lit(True)) for c in unique)]
    about = rows.sparkSession.createDataFrame([(i, c.name, c.severity, c.rebuild) for i, c in enumerate(told)], "nth int, issue string, severity string, rebuild boolean")
    return counts.join(some, "nth").join(F.broadcast(about), "nth").select("issue", "severity", "n", "sample", "rebuild")  # a row for each constraint


def needs_rebuild(report: DataFrame) -> DataFrame:
    """One row: errors, warnings, and whether any issue asks for a rebuild."""
    return report.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.coalesce(F.bool_or("rebuild"), F.lit(False)).alias("rebuild"))


# ------------------------------------------------------------- feature drift


def half(x: Column) -> Column:
    """x rounded to half precision: eleven significant bits, evenly spaced below 2**-14; ties to even."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
    return F.when(x == 0, 0.0).otherwise(F.rint(x / step) * step)


def feature_drift(stored: DataFrame, fresh: DataFrame, features: tuple[str, ...], tolerance: float = 1e-3) -> DataFrame:
    """path, cause, and for each feature its largest difference after half-precision rounding and its cosine.

    Both: path, sha and arrays.  cause: the first of not_stored, not_found,
    content_changed (another sha), size_changed, drifted (some element differs by
    more than tolerance), same.
    """
    a, b = (t.select("path", F.col("sha").alias(f"{s}_sha"), *[F.col(f).alias(f"{s}_{f}") for f in features]) for t, s in ((stored, "s"), (fresh, "f")))
    both = a.join(b, "path", "full")
    gap, size, near = {}, F.lit(False), F.lit(False)
    for f in features:
        x, y = F.col(f"s_{f}"), F.col(f"f_{f}")
        unlike = ~F.size(x).eqNullSafe(F.size(y))
        diff = F.array_max(F.zip_with(x, y, lambda p, q: F.abs(half(p.cast("double")) - half(q.cast("double")))))
        gap |= {f"{f}_gap": F.when(~unlike, diff), f"{f}_cosine": F.when(~unlike, vectors.cosine(x, y))}
        size, near = size | unlike, near | F.coalesce(diff > tolerance, F.lit(False))
    cause = (
        F.when(F.col("s_sha").isNull(), "not_stored").when(F.col("f_sha").isNull(), "not_found").when(F.col("s_sha") != F.col("f_sha"), "content_changed").when(size, "size_changed").when(near, "drifted").otherwise("same")
    )
    return both.select("path", cause.alias("cause"), *[c.alias(n) for n, c in gap.items()])


# ------------------------------------------------------------------ profiles


def apply_profiles(log: DataFrame) -> DataFrame:
    """owner, at, action, profile_id, name, outcome, selected: what became of each operation, and the owner's choice after it.

    log: owner, at, action (add, update, delete, select), profile_id, name; an
    owner's operations count in the order of at (ties: action, profile_id, name).
    An owner's names are unique, without regard to case and outer blanks.

    outcome: added, updated, deleted, selected; refused_exists (the id is there),
    refused_missing (it isn't), refused_name (empty, or another's), refused_action.
    Deleting the chosen profile clears the choice.  Each operation depends on all
    before it, so an owner is one task's work, in order; the task holds the owner's
    live profiles and no more.
    """
    rows = log.select("owner", "at", "action", "profile_id", "name")
    ordered = rows.repartition("owner").sortWithinPartitions("owner", "at", "action", "profile_id", "name")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, live, taken, chosen = object(), {}, {}, None
        for batch in batches:
            outcomes, choices = [], []
            for who, action, key, name in zip(*(batch[c].to_pylist() for c in ("owner", "action", "profile_id", "name")), strict=True):
                if who != owner:
                    owner, live, taken, chosen = who, {}, {}, None
                folded = (name or "").strip().lower()
                if action not in ("add", "update", "delete", "select"):
                    said = "refused_action"
                elif action == "add" and key in live:
                    said = "refused_exists"
                elif action != "add" and key not in live:
                    said = "refused_missing"
                elif action in ("add", "update") and (not folded or taken.get(folded, key) != key):
                    said = "refused_name"
                else:
                    said = {"add": "added", "update": "updated", "delete": "deleted", "select": "selected"}[action]
                    if action in ("update", "delete"):
                        del taken[live.pop(key)]
                    if action in ("add", "update"):
                        live[key], taken[folded] = folded, key
                    chosen = key if action == "select" else None if action == "delete" and chosen == key else chosen
                outcomes.append(said)
                choices.append(chosen)
            yield pa.record_batch([*batch.columns, pa.array(outcomes, pa.string()), pa.array(choices, pa.int64())], [*batch.schema.names, "outcome", "selected"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return ordered.mapInArrow(follow, f"{kinds}, outcome string, selected long")


def profiles_after(told: DataFrame) -> DataFrame:
    """owner, profile_id, name of the profiles that are left, from the outcomes of apply_profiles."""
    last = told.where(F.col("outcome").isin("added", "updated", "deleted")).groupBy("owner", "profile_id").agg(F.max_by(F.struct("outcome", "name"), F.struct("at", "action", "profile_id", "name")).alias("x"))
    return last.where(F.col("x.outcome") != "deleted").select("owner", "profile_id", F.trim("x.name").alias("name"))
