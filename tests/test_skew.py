"""Hot groups take another plan and must give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from sizewise import datasets as D
from sizewise.operators.dominance import mark_dominated
from sizewise.operators.skew import prefix_max, previous_value, split_hot
from sizewise.plans import decide as decisions
from sizewise.plans import jobs


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_split_keeps_every_row_once(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (None, 5)], "k long, v long")
    ordinary, large = split_hot(df, ["k"], spark.createDataFrame([(1,), (1,), (None,), (9,)], "k long"))
    assert {r.k for r in large.collect()} == {1, None}
    assert ordinary.count() + large.count() == df.count()
    assert split_hot(df, ["k"], None)[1] is None


@pytest.mark.parametrize("scale", [1, 5000, 3 * 10**8])
def test_prefix_max_against_a_loop(spark, scale):
    rng = random.Random(scale)
    rows = [(k, p * scale + rng.randrange(scale), float(rng.randrange(1000))) for k in (1, 2) for p in rng.sample(range(400), 200)]
    df = spark.createDataFrame(rows, "k long, p long, v double")
    got = {(r.k, r.p): r.prefix for r in prefix_max(df, ["k"], "p", "v").collect()}
    for k, p, _ in rows:
        before = [v for kk, pp, v in rows if kk == k and pp < p]
        assert got[(k, p)] == (max(before) if before else None)


def test_previous_value_in_hot_groups(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(9000), i, rng.choice("abc")) for k in (1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, p long, t long, v string")
    plain = rows_of(previous_value(df, ["k"], "p", "t", "v", "before"), "k", "p", "t", "before")
    assert plain == rows_of(previous_value(df, ["k"], "p", "t", "v", "before", df.select("k")), "k", "p", "t", "before")


def test_dominance_against_all_pairs(spark):
    rng = random.Random(7)
    rows = [(k, i, rng.randrange(40), rng.randrange(10) / 10) for k in (1, 2) for i in range(80)]
    df = spark.createDataFrame(rows, "g long, i long, size long, q double")
    expected = {
        (g, i)
        for g, i, s, q in rows
        if any(g == h and ((t < s and r >= q) or (t <= s and r > q)) for h, _, t, r in rows)
    }
    for hot in (None, df.select("g"), df.select("g").where("g = 2")):
        marked = mark_dominated(df, ["g"], "size", "q", hot=hot).where("dominated")
        assert {(r.g, r.i) for r in marked.collect()} == expected


def test_decisions_do_not_depend_on_the_plan(spark, sf_dir):
    m = D.measurements(spark, sf_dir)
    columns = ["image_id", "outcome", "final_size", "preference_fired", "n_survivors", "selected.candidate_id",
               "runner_up.candidate_id"]
    plain = decisions.decide(m, runner_up=True)
    assert rows_of(plain, *columns) == rows_of(decisions.decide(m, runner_up=True, hot=m.where("image_id % 2 = 0")), *columns)
    assert rows_of(plain, *columns) == rows_of(decisions.decide(m.repartition(7), runner_up=True), *columns)


def alerts_by_loop(events):
    out, last = [], {}
    for e in sorted(events.where("status IN ('Failed', 'Completed', 'Cancelled')").collect(), key=lambda e: (e.ts, e.event_id)):
        if e.status == "Failed" and last.get(e.job_id) != "Failed":
            out.append((e.job_id, e.event_id))
        last[e.job_id] = e.status
    return sorted(out)


def test_alerts_against_a_loop(spark, sf_dir):
    events = D.job_events(spark, sf_dir)
    for seconds in (1, 3600, 10**9):
        assert sorted((r.job_id, r.event_id) for r in jobs.job_alerts(events, seconds).collect()) == alerts_by_loop(events)


def test_a_job_with_a_third_of_all_events_is_looked_at_in_stretches(spark):
    rng = random.Random(5)
    kinds = ["Failed", "Failed", "Completed", "Cancelled", "Processing"]
    rows = [(0 if i % 3 == 0 else rng.randint(1, 50), i, rng.choice(kinds), i // 7) for i in range(6000)]
    events = spark.createDataFrame(rows, "job_id long, event_id long, status string, at long").withColumn("ts", F.timestamp_seconds("at"))
    assert sorted((r.job_id, r.event_id) for r in jobs.job_alerts(events, 60).collect()) == alerts_by_loop(events)
    # No window is over a whole job but the one along its stretches, which has a row for each.
    plan = jobs.job_alerts(events, 60)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("_bucket" in w.split("], [")[1] for w in windows) == 1


def test_building_a_query_runs_no_job(spark, sf_dir):
    m, events = D.measurements(spark, sf_dir), D.job_events(spark, sf_dir)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job may run here")
    decisions.decide(m, runner_up=True)
    decisions.rejections(decisions.annotate(m))
    jobs.job_alerts(events)
    jobs.job_outcome(events)
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_goals_of_one_image_are_decided_apart(spark, sf_dir):
    one = D.measurements(spark, sf_dir).where("image_id % 5 = 0")
    both = one.withColumn("goal", F.explode(F.array(F.lit("WEB"), F.lit("LOSSLESS"))))
    columns = ["image_id", "outcome", "final_size", "n_candidates", "n_survivors", "selected.candidate_id"]
    decided = decisions.decide(both)
    assert decided.count() == 2 * one.select("image_id").distinct().count()
    for goal in ("WEB", "LOSSLESS"):
        alone = decisions.decide(one.withColumn("goal", F.lit(goal)))
        assert rows_of(decided.where(F.col("goal") == goal), *columns) == rows_of(alone, *columns)


def test_one_image_with_a_third_of_all_rows(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else i, str(i), rng.randrange(10**6), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "image_id long, candidate_id string, size long, q double")
    plain = rows_of(mark_dominated(df, ["image_id"], "size", "q").where("dominated"), "candidate_id")
    named = mark_dominated(df, ["image_id"], "size", "q", hot=spark.createDataFrame([(0,)], "image_id long"))
    assert plain == rows_of(named.where("dominated"), "candidate_id")
