"""State transitions between consecutive snapshots, in the abstract value domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.reprs import ABSENT, EXCEPTION, NORMAL, NULL, abstract_value, is_resource, type_name
from traceloom.operators.sequences import PROGRAM, depths, in_traces


def event_kind(var: Column, pre: Column, post: Column, pre_exc: Column, post_exc: Column) -> Column:
    """Kind of a variable's transition. ABSENT marks a variable that isn't in a snapshot.

    The kind data_flow can't occur: it would need a variable in both snapshots that is absent from the first.
    """
    resource, none = is_resource(var), lambda c: c.isin(NULL, ABSENT)
    created = F.when(post.isin(EXCEPTION, NULL) | post_exc, "error_transition").when(resource, "resource_acquire").otherwise("state_creation")
    deleted = F.when(resource, "resource_release").when(pre_exc, "error_recovery").otherwise("state_deletion")
    changed = (
        F.when(pre_exc & ~post_exc, "error_recovery").when(post_exc | (post == EXCEPTION), "error_transition").when(pre == EXCEPTION, "error_recovery")
        .when(resource & none(pre) & ~none(post), "resource_acquire").when(resource & ~none(pre) & none(post), "resource_release").otherwise("state_mutation")
    )
    return F.when(pre == ABSENT, created).when(post == ABSENT, deleted).otherwise(changed)


def state_transitions(events: DataFrame) -> DataFrame:
    """program_id, func_idx, pre, kind, post, n.

    A variable whose abstract value stays emits nothing; crossing into or out of an
    exception emits one row more. A function that is never called has index 0.
    """
    known = in_traces(events).where("next_type IS NOT NULL").withColumn("func_idx", F.coalesce("idx", F.lit(0)))
    pre_exc, post_exc = F.col("event_type") == "exception", F.col("next_type") == "exception"
    names = F.array_union(F.map_keys("snapshot"), F.map_keys("after"))
    moves = known.select(PROGRAM, "func_idx", pre_exc.alias("pre_exc"), post_exc.alias("post_exc"), F.explode(names).alias("var"), "snapshot", "after")
    value = lambda c: F.when(F.col(c)[F.col("var")].isNull(), ABSENT).otherwise(abstract_value(F.col(c)[F.col("var")]))
    moves = moves.select(PROGRAM, "func_idx", "pre_exc", "post_exc", "var", value("snapshot").alias("pre"), value("after").alias("post")).where("pre != post")
    kinds = moves.select(PROGRAM, "func_idx", "pre", event_kind(F.col("var"), F.col("pre"), F.col("post"), F.col("pre_exc"), F.col("post_exc")).alias("kind"), "post")
    crossed = known.where(pre_exc != post_exc).select(
        PROGRAM, "func_idx", F.when(pre_exc, EXCEPTION).otherwise(NORMAL).alias("pre"), F.when(pre_exc, "error_recovery").otherwise("error_transition").alias("kind"), F.when(pre_exc, NORMAL).otherwise(EXCEPTION).alias("post")
    )
    return kinds.unionByName(crossed).groupBy(PROGRAM, "func_idx", "pre", "kind", "post").agg(F.count("*").alias("n"))


def snapshot_changes(events: DataFrame) -> DataFrame:
    """program_id, pairs, changed_pairs, changes: consecutive snapshots of a trace, those that differ, and variables that differ."""
    pairs = in_traces(events).where("snapshot IS NOT NULL AND next_type IS NOT NULL")
    changed = F.size(F.filter(F.map_values(F.map_zip_with("snapshot", "after", lambda k, a, b: ~a.eqNullSafe(b))), lambda x: x))
    return pairs.withColumn("changed", changed).groupBy(PROGRAM).agg(F.count("*").alias("pairs"), F.sum((F.col("changed") > 0).cast("long")).alias("changed_pairs"), F.sum("changed").alias("changes"))


def state_summary(events: DataFrame) -> DataFrame:
    """program_id, state_space_size, mutation_rate, state_transition_count; pairs are pooled over the program's traces."""
    shown = F.array_sort(F.transform(F.map_entries("snapshot"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    spaces = events.groupBy(PROGRAM).agg(F.count_distinct(F.array_join(shown, "\n")).alias("state_space_size"))
    joined = spaces.join(snapshot_changes(events), PROGRAM, "left")
    rate = F.coalesce(F.col("changed_pairs") / F.col("pairs"), F.lit(0.0))
    return joined.select(PROGRAM, "state_space_size", rate.alias("mutation_rate"), F.coalesce("changes", F.lit(0)).alias("state_transition_count"))


def heap_types(events: DataFrame) -> DataFrame:
    """program_id, type, n: type names of all variables in all snapshots."""
    values = events.select(PROGRAM, F.explode(F.map_values("snapshot")).alias("repr"))
    return values.groupBy(PROGRAM, type_name(F.col("repr")).alias("type")).agg(F.count("*").alias("n"))


def depth_profile(events: DataFrame) -> DataFrame:
    """program_id, depth, n: how many events end at each call depth."""
    return depths(events).groupBy(PROGRAM, "depth").agg(F.count("*").alias("n"))
