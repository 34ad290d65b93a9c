"""Trials, weights and contributions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranking import kept, numbered

#: Checks of a block.
BLOCK_CHECKS = 100_000
#: Trials that are folded in order: each depends on the one before.
MOST_TRIALS = 1_000_000


def _bounded(items: Column) -> Column:
    """items, or an error where they are more than can be folded in one task."""
    return F.when(F.size(items) <= MOST_TRIALS, items).otherwise(F.raise_error(F.lit("too many trials to fold in order")))


def best_trial(trials: DataFrame, err: float = 0.0) -> DataFrame:
    """The best of (trial, effect, seconds) in the order of trial: a better effect wins, and within err a faster trial.

    Without err the best is a maximum. With it the outcome depends on the order, and at most MOST_TRIALS are folded.
    """
    one = F.struct("trial", "effect", "seconds")
    if not err:
        best = F.max_by(one, F.struct("effect", -F.col("seconds"), -F.col("trial")))
        return trials.agg(best.alias("b")).where("b is not null").select("b.*")
    better = lambda a, t: (t["effect"] > a["effect"] + err) | ((F.abs(t["effect"] - a["effect"]) <= err) & (t["seconds"] < a["seconds"]))
    ordered = trials.agg(_bounded(F.array_sort(F.collect_list(one))).alias("x"))
    return ordered.select(F.aggregate(F.slice("x", 2, 2**30), F.element_at("x", 1), lambda a, t: F.when(better(a, t), t).otherwise(a)).alias("b")).select("b.*")


def sigmoid_weights(df: DataFrame, value: str) -> DataFrame:
    """Adds weight: the sigmoid of value over the sum of all sigmoids; a row for each model or feature."""
    s = 1 / (1 + F.exp(-F.col(value)))
    total = df.agg(F.sum(s).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn("weight", s / F.col("_total")).drop("_total")


def _largest(rows: DataFrame, value: str, name: str, last: int) -> DataFrame:
    """Adds the largest value of all rows up to `last` places from a row's own, in the order of _r, from the blocks' largest."""
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_b").agg(F.max(value).alias("_m")).select("_b", F.max("_m").over(before).alias("_o"))  # a row for each block
    own = Window.partitionBy("_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, last)
    return rows.join(blocks, "_b").withColumn(name, F.greatest("_o", F.max(value).over(own))).drop("_o")


def early_stop(checks: DataFrame, patience: int, compare: str = "best") -> DataFrame:
    """stop_at and best of (step, metric): the first step with `patience` checks in a row that don't improve, and the best metric
    up to it. Steps are unique.

    compare: with the `best` so far, or with the `previous` check. Checks are numbered over all tasks and dealt to blocks of
    BLOCK_CHECKS; what stands before a block comes from a row for each, so a run may have any number of checks.
    """
    rows = numbered(checks.select("step", "metric"), [F.col("step")], "_r").withColumn("_b", F.floor(F.col("_r") / BLOCK_CHECKS))
    if compare == "best":
        seen = _largest(rows, "metric", "_ref", -1)
    else:
        seen = rows.join(rows.select((F.col("_r") + 1).alias("_r"), F.col("metric").alias("_ref")), "_r", "left")
    improved = F.when(F.col("_ref").isNull() | (F.col("metric") > F.col("_ref")), F.col("_r"))
    last = kept(_largest(seen.withColumn("_at", improved), "_at", "_last", 0).select("step", "metric", "_r", "_last"))
    stop = last.agg(F.min(F.when(F.col("_r") - F.col("_last") >= patience, F.struct("_r", "step"))).alias("_s"))
    until = F.when(F.col("_s").isNull() | (F.col("_r") <= F.col("_s._r")), F.col("metric"))
    best = last.crossJoin(F.broadcast(stop)).agg(F.max(until).cast("double").alias("best"))
    return stop.crossJoin(F.broadcast(best)).select(F.col("_s.step").cast("long").alias("stop_at"), "best")


def top_contributions(phi: DataFrame, row: str, k: int, strategy: str = "max", score: str | None = None, threshold: float = 0.5) -> DataFrame:
    """The k features of each row of (row, feature, phi) with the highest, lowest or largest absolute contribution.

    `threshold` takes the highest where the row's score reaches the threshold and the lowest elsewhere. Ties by name.
    """
    order = {"max": -F.col("phi"), "min": F.col("phi"), "abs": -F.abs("phi")}
    by = F.when(F.col(score) >= threshold, order["max"]).otherwise(order["min"]) if strategy == "threshold" else order[strategy]
    w = Window.partitionBy(row).orderBy(by, "feature")
    return phi.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_of_row(parts: Column, k: int, strategy: str = "max", score: Column | None = None, threshold: float = 0.5) -> Column:
    """As top_contributions, of a row's array of structs with feature and phi: a sort of the array, without a shuffle."""
    order = {"max": lambda x: -x["phi"], "min": lambda x: x["phi"], "abs": lambda x: -F.abs(x["phi"])}
    if strategy == "threshold":
        by = lambda x: F.when(score >= threshold, order["max"](x)).otherwise(order["min"](x))
    else:
        by = order[strategy]
    keyed = F.sort_array(F.transform(parts, lambda x: F.struct(by(x).alias("k"), x["feature"].alias("f"), x.alias("x"))))
    return F.transform(F.slice(keyed, 1, k), lambda e: e["x"])


def _named(groups: dict[str, list[str]]) -> dict[str, str]:
    named = [(f, g) for g, fs in groups.items() for f in fs]
    if len({f for f, _ in named}) < len(named):
        raise ValueError("a feature is in more than one group")
    return dict(named)


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), which is made once: in place, it would be made anew wherever it stands."""
    return F.get(F.transform(F.array(value), of), 0)


def groups_of_row(parts: Column, groups: dict[str, list[str]], features: list[str]) -> Column:
    """The groups of a row's array of structs with feature and phi: structs of group, group_phi and its parts, by highest sum, then
    name; parts by highest contribution, then name. features are all that there are; one in no group is a group of its own.
    Sorts inside the row, without a shuffle."""
    of = _named(groups)
    names = list(dict.fromkeys([*groups, *(f for f in features if f not in of)]))
    inside = {g: [f for f in features if of.get(f, f) == g] for g in names}

    def one(g: str, own: Column) -> Column:
        if len(inside[g]) > 1:
            ordered = F.transform(F.sort_array(F.transform(own, lambda x: F.struct((-x["phi"]).alias("k"), x["feature"].alias("f"), x.alias("x")))), lambda e: e["x"])
        else:
            ordered = own
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x["phi"])
        return _bound(total, lambda t: F.struct((-t).alias("k"), F.lit(g).alias("group"), t.alias("group_phi"), ordered.alias("parts")))

    def of(x: Column) -> Column:
        each = [_bound(F.filter(x, lambda e: e["feature"].isin(inside[g])), lambda own: one(g, own)) for g in names if inside[g]]  # noqa: B023
        return F.filter(F.array(*each), lambda e: F.size(e["parts"]) > 0)

    return F.transform(F.sort_array(_bound(parts, of)), lambda e: F.struct(e["group"].alias("group"), e["group_phi"].alias("group_phi"), e["parts"].alias("parts")))


def quota_of_row(sorted_groups: Column, k: int) -> Column:
    """As top_by_group, of what groups_of_row gives: structs of group, rank of the group and part."""

    def took(n: Column, e: Column, i: Column) -> Column:
        share = F.when(n >= k, F.when(i < k, 1).otherwise(0)).otherwise(F.floor(F.lit(k) / n) + F.when(i < F.lit(k) % n, 1).otherwise(0)).cast("int")
        return F.transform(F.slice(e["parts"], 1, share), lambda x: F.struct(e["group"].alias("group"), (i + 1).alias("rank"), x.alias("part")))

    return F.flatten(_bound(sorted_groups, lambda groups: F.transform(groups, lambda e, i: took(F.size(groups), e, i))))


def grouped(phi: DataFrame, row: str, groups: dict[str, list[str]]) -> DataFrame:
    """Adds group and group_phi, the sum of the row's contributions of the feature's group.

    A feature in two groups is an error; one in none is a group of its own.
    """
    group = F.coalesce(*[F.when(F.col("feature") == f, g) for f, g in _named(groups).items()], F.col("feature"))
    return phi.withColumn("group", group).withColumn("group_phi", F.sum("phi").over(Window.partitionBy(row, "group")))


def top_by_group(phi: DataFrame, row: str, k: int, groups: dict[str, list[str]]) -> DataFrame:
    """k features of each row: one of each of the k best groups, or k dealt to fewer groups, the best taking the rest.

    Groups are ordered by their summed contribution, features inside by theirs; ties by name. A group with fewer
    features than its share leaves the rest open.
    """
    g = grouped(phi, row, groups)
    place = F.dense_rank().over(Window.partitionBy(row).orderBy(F.desc("group_phi"), "group"))
    ranked = g.withColumn("group_rank", place).withColumn("in_group", F.row_number().over(Window.partitionBy(row, "group").orderBy(F.desc("phi"), "feature")))
    n = F.max("group_rank").over(Window.partitionBy(row))
    quota = F.when(n >= k, F.when(F.col("group_rank") <= k, 1).otherwise(0)).otherwise(F.floor(F.lit(k) / n) + F.when(F.col("group_rank") <= F.lit(k) % n, 1).otherwise(0))
    return ranked.withColumn("_quota", quota).where(F.col("in_group") <= F.col("_quota")).drop("_quota")


def reason(top: DataFrame, row: str, value: str) -> DataFrame:
    """One phrase for each row: `feature value is v`, in the order of rank."""
    phrase = F.concat(F.col("feature"), F.lit(" value is "), F.col(value).cast("string"))
    return top.groupBy(row).agg(F.sort_array(F.collect_list(F.struct("rank", phrase.alias("p")))).alias("x")).select(row, F.array_join(F.transform("x", lambda e: e["p"]), ",").alias("reason"))
