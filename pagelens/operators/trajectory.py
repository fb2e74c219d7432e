"""Trajectories: visits, streaks, outcomes, failures, breadcrumbs and actions of a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions.columns import clamp, js_round
from pagelens.operators.hierarchy import hierarchy

#: The actions an agent may take.
ACTIONS = ("click", "type", "press", "scroll", "wait", "done")


def numbered(df: DataFrame, task: str, *order: Column) -> DataFrame:
    """df with `seq`, the place in its task."""
    return df.withColumn("seq", F.row_number().over(W.partitionBy(task).orderBy(*order)))


def visits(steps: DataFrame) -> DataFrame:
    """steps (task, seq, state) with the visits of the state so far and the loop flag (3 or more)."""
    w = W.partitionBy("task", "state").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("visit", F.count("*").over(w)).withColumn("loop", F.col("visit") >= 3)


def streaks(steps: DataFrame) -> DataFrame:
    """steps (task, seq, action, state) with the length so far of the run of equal action and state."""
    w = W.partitionBy("task").orderBy("seq")
    new = ~(F.lag("action").over(w).eqNullSafe(F.col("action")) & F.lag("state").over(w).eqNullSafe(F.col("state"))) | (F.row_number().over(w) == 1)
    runs = steps.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    count = F.row_number().over(W.partitionBy("task", "_run").orderBy("seq"))
    return runs.withColumn("streak", count).withColumn("stuck", F.col("streak") >= 2).drop("_run")


def outcome(error: Column, before: Column, after: Column, action: Column, url_before: Column, url_after: Column, gone: Column) -> Column:
    """FAILED, UNKNOWN, SUCCESS, NAVIGATION, TARGET_DISAPPEARED, STATE_CHANGED or NO_EFFECT: the first that holds."""
    return (
        F.when(F.coalesce(error, F.lit(False)), "FAILED")
        .when(before.isNull() | after.isNull(), "UNKNOWN")
        .when(action == "done", "SUCCESS")
        .when(~url_before.eqNullSafe(url_after), "NAVIGATION")
        .when(F.coalesce(gone, F.lit(False)), "TARGET_DISAPPEARED")
        .when(before != after, "STATE_CHANGED")
        .otherwise("NO_EFFECT")
    )


def failures(steps: DataFrame) -> DataFrame:
    """steps (task, seq, action, state, outcome): evidence of failing actions since the last navigation.

    (task, action, n, n_states, last_outcome, retry): retry from two failures or states on.
    """
    w = W.partitionBy("task").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    part = steps.withColumn("_part", F.sum((F.col("outcome") == "NAVIGATION").cast("int")).over(w))
    last = part.withColumn("_last", F.max("_part").over(W.partitionBy("task"))).where("_part = _last")
    bad = last.where(F.col("outcome").isin("FAILED", "NO_EFFECT", "TARGET_DISAPPEARED"))
    agg = bad.groupBy("task", "action").agg(F.count("*").alias("n"), F.size(F.collect_set("state")).alias("n_states"), F.max_by("outcome", "seq").alias("last_outcome"))
    return agg.withColumn("retry", (F.col("n") >= 2) | (F.col("n_states") >= 2))


def first_seen(steps: DataFrame) -> DataFrame:
    """(task, state, first_seq, last_seq, visits, parent, url, depth) of steps (task, seq, state, url).

    parent is the state before the first visit, url the one seen last. A state was found
    from one that was known before, so the parents form trees; depth counts their links.
    """
    before = F.lag("state").over(W.partitionBy("task").orderBy("seq"))
    s = steps.withColumn("_before", before)
    own = s.groupBy("task", "state").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("visits"), F.min_by("_before", "seq").alias("parent"), F.max_by("url", "seq").alias("url"))
    named = lambda c: F.concat(F.lit("s"), c)  # noqa: E731  (an empty state is a state too)
    depth = hierarchy(own.select("task", named("state").alias("n"), named("parent").alias("p")), "task", "n", "p", with_paths=False).select(F.col("grp").alias("_g"), F.substring("node", 2, 1_000_000).alias("_s"), "depth")
    return own.join(depth, own.task.cast("string").eqNullSafe(F.col("_g")) & (own.state == F.col("_s"))).drop("_g", "_s")


def attempt_signature(action: Column, target: Column, value: Column, direction: Column) -> Column:
    """action:target:value:direction, empty parts for nulls."""
    return F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in (action, target, value, direction)])


def dead_ends(steps: DataFrame) -> DataFrame:
    """(task, state, target, mark, signature): each action without effect in a state, once, as first met.

    steps has task, seq, state, outcome, target, mark and signature. Actions are the same
    if they share a signature, or a target, or a structural mark (neither null nor empty).
    An action whose target and mark tell the same things apart as its signature is told by
    the first of target, mark and signature that is there, so no pairs are built.
    """
    bad = steps.where("outcome = 'NO_EFFECT'")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    key = F.coalesce(F.concat(F.lit("t"), some("target")), F.concat(F.lit("m"), some("mark")), F.concat(F.lit("s"), F.col("signature")))
    return bad.groupBy("task", "state", key.alias("key")).agg(F.min_by(F.struct("target", "mark", "signature"), "seq").alias("a"), F.count("*").alias("n")).select("task", "state", "a.*", "n")


def capped(steps: DataFrame, most: int = 25) -> DataFrame:
    """(task, steps, status): the steps a task may take, and 'max_iterations' where it took them all without ending.

    steps has task, seq and action.
    """
    kept = steps.where(F.col("seq") <= most)
    agg = kept.groupBy("task").agg(F.count("*").alias("steps"), F.bool_or(F.coalesce(F.col("action") == "done", F.lit(False))).alias("d"))
    return agg.select("task", "steps", F.when(F.col("d"), "done").when(F.col("steps") >= most, "max_iterations").otherwise("open").alias("status"))


def versions(pages: DataFrame) -> DataFrame:
    """pages (grp, seq, url, mark) with the version of the observation: it rises with every change of the page."""
    w = W.partitionBy("grp").orderBy("seq")
    new = ~(F.lag("url").over(w).eqNullSafe(F.col("url")) & F.lag("mark").over(w).eqNullSafe(F.col("mark"))) | (F.row_number().over(w) == 1)
    return pages.withColumn("_new", new.cast("int")).withColumn("version", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def breadcrumbs(steps: DataFrame, most: int = 25) -> DataFrame:
    """(task, crumbs): '1. a > 2. b' of the trail, titles cut to `most` characters.

    A state stays on the trail if it is the first one, or follows the last visit of the one
    before it; so only each state's successor after its last visit is needed, and what is
    brought together for a task is its distinct states, not its steps.
    """
    s = steps.where("state is not null")
    s = s.withColumn("_next", F.lead("state").over(W.partitionBy("task").orderBy("seq")))
    per = s.groupBy("task", "state").agg(F.min("seq").alias("first"), F.max_by(F.struct("_next"), "seq").alias("n"))
    whole = per.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("state", "n._next"))).alias("m"), F.min_by("state", "first").alias("start"))
    way = F.expr("aggregate(sequence(1, size(m)), array(start), (a, i) -> if(element_at(m, element_at(a, -1)) is null, a, array_append(a, element_at(m, element_at(a, -1)))))")
    crumbs = F.transform(way, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.left(x, F.lit(most))))
    return whole.select("task", F.array_join(crumbs, " > ").alias("crumbs"))


def action_signature(action: Column, target: Column, text: Column) -> Column:
    """action:target:"text", the text cut to 30 characters; empty parts for nulls."""
    return F.concat_ws(":", F.coalesce(action, F.lit("")), F.coalesce(target, F.lit("")), F.left(F.coalesce(text, F.lit("")), F.lit(30)))


def json_part(raw: Column) -> Column:
    """The JSON in a model's answer: a fenced block's content, from the first { to the last }."""
    body = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), raw)
    return F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))


def action_of(raw: Column) -> Column:
    """struct(valid, reason, action, target_id, value, direction, wait_ms, remaining, memory) of JSON-like text."""
    j = json_part(raw)
    get = lambda k: F.get_json_object(j, f"$.{k}")
    action = F.lower(F.coalesce(get("action"), F.lit("")))
    target, value, direction = F.trim(get("target_id")), get("value"), F.lower(F.coalesce(get("direction"), F.lit("")))
    number = lambda k: F.when(~F.isnan(get(k).try_cast("double")) & (F.abs(get(k).try_cast("double")) < float("inf")), get(k).try_cast("double"))
    needs_target, needs_value = action.isin("click", "type", "press"), action.isin("type", "press")
    reason = (
        F.when(j.isNull(), "no_json")
        .when(~action.isin(*ACTIONS), "unsupported_action")
        .when(needs_target & (F.coalesce(target, F.lit("")) == ""), "target_id_required")
        .when(needs_value & value.isNull(), "value_required")
        .when((action == "scroll") & ~direction.isin("up", "down"), "direction_required")
    )
    ok = lambda c: F.when(reason.isNull(), c)
    return F.struct(
        reason.isNull().alias("valid"),
        reason.alias("reason"),
        ok(action).alias("action"),
        ok(F.when(needs_target, target)).alias("target_id"),
        ok(F.when(needs_value, value)).alias("value"),
        ok(F.when(action == "scroll", direction)).alias("direction"),
        ok(F.when(action == "wait", F.coalesce(clamp(js_round(number("wait_ms")), 0, 10000), F.lit(1000)))).cast("long").alias("wait_ms"),
        ok(F.coalesce(clamp(js_round(number("iterations_remaining")), 0, 50), F.lit(0))).cast("long").alias("remaining"),
        ok(F.left(F.coalesce(get("memory"), F.lit("")), F.lit(500))).alias("memory"),
    )


def context_check(target: Column, known: Column, tab: Column, now_tab: Column, url: Column, now_url: Column) -> Column:
    """OK, or the first reason a recorded action no longer fits the page."""
    return (
        F.when(target.isNotNull() & ~F.coalesce(F.array_contains(known, target), F.lit(False)), "TARGET_NOT_IN_OBSERVATION")
        .when(~tab.eqNullSafe(now_tab), "TAB_CHANGED")
        .when(~url.eqNullSafe(now_url), "URL_CHANGED")
        .otherwise("OK")
    )


def change_reason(tab: Column, new_tab: Column, url: Column, new_url: Column, mark: Column, new_mark: Column) -> Column:
    """NEW_TAB, NAVIGATION, RELOAD or SAME_PAGE."""
    return F.when(~tab.eqNullSafe(new_tab), "NEW_TAB").when(~url.eqNullSafe(new_url), "NAVIGATION").when(~mark.eqNullSafe(new_mark), "RELOAD").otherwise("SAME_PAGE")
