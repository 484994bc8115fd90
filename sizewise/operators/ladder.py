"""Search for the smallest acceptable rung of a quality ladder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sizewise.dims import AVIF_LADDER, BISECT_GAP, BISECT_STEPS, LADDER
from sizewise.session import cut_lineage


def _array(ladder: list[int] | Column | None) -> Column:
    return ladder if isinstance(ladder, Column) else F.array(*[F.lit(q) for q in ladder or LADDER])


def ladder_of_format(fmt: Column) -> Column:
    """The rungs tried for an output format, from the top."""
    return F.when(fmt == "AVIF", _array(AVIF_LADDER)).otherwise(_array(LADDER))


def ladder_scan(
    rungs: DataFrame, target: Column | float, ladder: list[int] | Column | None = None, keys: tuple[str, ...] = ("image_id",)
) -> DataFrame:
    """Boundary of the descending scan: the first missing rung, the lowest passing one above it, rungs reached.

    The scan stops at the first miss, so the rungs reached are those at or above the highest miss. Plain
    aggregates give the same as walking down, without ordering anything. ``keys`` name one search, such as image and
    format; target and ladder may differ between searches. The rungs are shuffled once, by those keys.
    """
    target = F.lit(target) if isinstance(target, (int, float)) else target
    rows = rungs.where(F.array_contains(_array(ladder), F.col("q"))).withColumn("_pass", F.col("damage") < target)
    marked = rows.repartition(*keys).groupBy(*keys, "q").agg(F.bool_or("_pass").alias("_pass"))
    per_image = marked.groupBy(*keys).agg(
        F.max(F.when(~F.col("_pass"), F.col("q"))).alias("first_miss"),
        F.sort_array(F.collect_list(F.when(F.col("_pass"), F.col("q")))).alias("_passing"),
        F.sort_array(F.collect_list("q")).alias("_all"),
    )
    above = F.filter("_passing", lambda q: q > F.coalesce(F.col("first_miss"), F.lit(-1)))
    reached = F.filter("_all", lambda q: q >= F.coalesce(F.col("first_miss"), F.lit(-1)))
    return per_image.select(
        *keys,
        "first_miss",
        F.array_min(above).alias("lowest_pass"),
        F.size(reached).alias("n_reached"),
    )


def ladder_search(
    rungs: DataFrame, target: Column | float, ladder: list[int] | Column | None = None, keys: tuple[str, ...] = ("image_id",)
) -> DataFrame:
    """Winning rung per search: scan, up to three bisection steps, then the smallest measured rung that passes.

    ``rungs`` (the keys, q, size, damage) holds every quality that may be asked for. The rungs of one search are a
    map of at most 101 entries, so after one aggregation the whole search is a projection. For ``keys`` see ``ladder_scan``.
    """
    target = F.lit(target) if isinstance(target, (int, float)) else target
    levels = F.col("_levels")
    per_image = _rung_maps(rungs, target, _array(ladder), keys)

    def damage(q: Column) -> Column:
        return F.try_element_at("_m", q)["damage"]

    known = F.filter(levels, lambda q: damage(q).isNotNull())
    first_miss = F.array_max(F.filter("_known", lambda q: damage(q) >= F.col("target")))
    state = (
        per_image.withColumn("_known", known)
        .withColumn("first_miss", first_miss)
        .withColumn("_reached", F.filter("_known", lambda q: q >= F.coalesce(F.col("first_miss"), F.lit(-1))))
        .withColumn("lowest_pass", F.array_min(F.filter("_reached", lambda q: damage(q) < F.col("target"))))
        .withColumn("_tried", F.col("_reached"))
        .withColumn("_lo", F.col("first_miss"))
        .withColumn("_hi", F.col("lowest_pass"))
        .withColumn("_go", F.coalesce(F.col("_hi") > F.col("_lo") + BISECT_GAP, F.lit(False)))
    )
    for _ in range(BISECT_STEPS):
        mid = F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("int")
        state = (
            state.withColumn("_mid", mid)
            .withColumn(
                "_go", F.col("_go") & (F.col("_mid") > F.col("_lo")) & damage(F.col("_mid")).isNotNull()
            )
            .withColumn("_ok", damage(F.col("_mid")) < F.col("target"))
            .withColumn("_tried", F.when(F.col("_go"), F.array_append("_tried", F.col("_mid"))).otherwise(F.col("_tried")))
            .withColumn("_hi", F.when(F.col("_go") & F.col("_ok"), F.col("_mid")).otherwise(F.col("_hi")))
            .withColumn("_lo", F.when(F.col("_go") & ~F.col("_ok"), F.col("_mid")).otherwise(F.col("_lo")))
        )
    return state.withColumn("_best", best_passing(F.col("_tried"), F.col("_m"), F.col("target"))).select(
        *keys,
        "target",
        F.coalesce(F.col("_best.q"), F.col("first_miss")).alias("q"),
        F.coalesce(F.col("_best.size"), F.try_element_at("_m", F.col("first_miss"))["size"]).alias("size"),
        F.coalesce(F.col("_best.damage"), damage(F.col("first_miss"))).alias("damage"),
        F.size("_tried").alias("n_tried"),
        F.col("lowest_pass").isNotNull().alias("converged"),
    )


def _rung_maps(rungs: DataFrame, target: Column, levels: Column, keys: tuple[str, ...]) -> DataFrame:
    """One row per search with its target, its ladder and a map from quality to size and damage."""
    constant = [F.min("target").alias("target"), F.min("_levels").alias("_levels")]
    unique = (
        rungs.withColumn("target", target).withColumn("_levels", levels).repartition(*keys)
        .groupBy(*keys, "q")
        .agg(F.min(F.struct("size", "damage")).alias("m"), *constant)
    )
    return unique.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("q", "m"))).alias("_m"), *constant)


def best_passing(tried: Column, rungs: Column, target: Column) -> Column:
    """Smallest tried rung under the target, the lower damage on a tie: a struct (size, damage, q)."""
    measured = F.transform(
        tried,
        lambda q: F.struct(
            F.try_element_at(rungs, q)["size"].alias("size"), F.try_element_at(rungs, q)["damage"].alias("damage"),
            q.alias("q"),
        ),
    )
    return F.array_min(F.filter(measured, lambda m: m["damage"] < target))


def search_with_codec(
    images: DataFrame,
    measure: Callable[[DataFrame], DataFrame],
    target: Column | float,
    ladder: list[int] | None = None,
) -> DataFrame:
    """The same search with a real encoder: only the rungs the search asks for are encoded.

    ``measure`` takes rows (image_id, q, ...) and returns (image_id, q, size, damage). One job measures the next
    rung of all images still going down, then at most three jobs measure the bisection points. The loop is over
    rungs, never over images; measured rows are checkpointed, since encoding them again would be the whole cost.
    """
    target = F.lit(target) if isinstance(target, (int, float)) else target
    measured = None
    going = images
    for q in ladder or LADDER:
        rows = cut_lineage(measure(going.withColumn("q", F.lit(q))).select("image_id", "q", "size", "damage"))
        measured = rows if measured is None else measured.unionByName(rows)
        passing = rows.where(F.col("damage") < target).select("image_id")
        going = going.join(passing, "image_id", "left_semi")
    found = ladder_scan(measured, target, ladder)
    bounds = found.where(F.col("lowest_pass") > F.col("first_miss") + BISECT_GAP).select(
        "image_id", F.col("first_miss").alias("_lo"), F.col("lowest_pass").alias("_hi")
    )
    for _ in range(BISECT_STEPS):
        mids = bounds.withColumn("q", F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("int")).where("q > _lo")
        rows = cut_lineage(
            measure(images.join(mids.select("image_id", "q"), "image_id")).select("image_id", "q", "size", "damage")
        )
        measured = measured.unionByName(rows)
        tried = mids.join(rows.select("image_id", (F.col("damage") < target).alias("_ok")), "image_id")
        bounds = tried.select(
            "image_id",
            F.when(F.col("_ok"), F.col("_lo")).otherwise(F.col("q")).alias("_lo"),
            F.when(F.col("_ok"), F.col("q")).otherwise(F.col("_hi")).alias("_hi"),
        )
    ok = F.col("damage") < target
    return measured.groupBy("image_id").agg(
        F.min(F.when(ok, F.struct("size", "damage", "q"))).alias("_best"),
        F.max(F.struct("q", "size", "damage")).alias("_top"),
        F.count(F.lit(1)).alias("n_tried"),
    ).select(
        "image_id",
        *[F.coalesce(F.col(f"_best.{c}"), F.col(f"_top.{c}")).alias(c) for c in ("q", "size", "damage")],
        "n_tried",
        F.col("_best").isNotNull().alias("converged"),
    )


def search_frontier(
    searches: DataFrame, measure: Callable[[DataFrame], DataFrame], keys: tuple[str, ...], by: tuple[str, ...], ahead: int = 1
) -> DataFrame:
    """Many searches at once, each with its own ladder and target, measuring only the rungs that are asked for.

    ``searches`` has the ``keys``, a ``target`` and a ``ladder`` (descending array). ``by`` names the keys that a measurement depends
    on; ``measure`` takes distinct rows (``by``, q) and returns (``by``, q, size, damage). The open searches are a table of brackets
    with the rung that each wants next; a round measures the rungs that nobody has asked for before, joins them once and moves every
    bracket as far as the known rungs take it. With ``ahead`` above 1 a search asks for so many rungs of its ladder at a time, and for the
    middles of both halves of a bracket: fewer rounds for more measurements, the same result. Rounds are checkpointed.

    Returns the keys, q, size, damage, ``n_tried`` and ``converged``. Without any rung under the target it is the first miss; a search
    whose rung is not measured ends with what it has, without anything it has a NULL q.
    """
    no_rung = F.lit(None).cast("struct<size: bigint, damage: double, q: int>")
    no_q = F.lit(None).cast("int")
    begin = F.struct(
        F.lit(0).alias("pos"), F.get("ladder", F.lit(0)).cast("int").alias("q"), no_q.alias("lo"), no_q.alias("hi"), no_rung.alias("best"),
        no_rung.alias("miss"), F.lit(0).alias("n_tried"), F.lit(0).alias("steps"),
    )
    active = cut_lineage(searches.select(*keys, "target", F.col("ladder").cast("array<int>").alias("ladder"), begin.alias("s")))
    known, done = None, []
    while not active.isEmpty():
        asked = active.select(*by, F.explode(_wanted(ahead)).alias("q")).where("q IS NOT NULL").distinct()
        new = asked if known is None else asked.join(known, [*by, "q"], "left_anti")
        new = cut_lineage(measure(new).select(*by, "q", F.col("size").cast("long").alias("size"), F.col("damage").cast("double").alias("damage")))
        known = new if known is None else known.unionByName(new)
        # The rungs of one picture and format: no more than a ladder and its middles.
        rungs = known.where("damage IS NOT NULL").groupBy(*by).agg(
            F.map_from_entries(F.collect_list(F.struct("q", F.struct("size", "damage")))).alias("_known"))
        moved = F.aggregate(F.sequence(F.lit(1), F.lit(ahead + 2 if ahead > 1 else 1)), F.col("s"), _moved)
        active = cut_lineage(active.join(rungs, [*by], "left").select(*keys, "target", "ladder", moved.alias("s")))
        done.append(active.where("s.q IS NULL"))
        active = active.where("s.q IS NOT NULL")
    if not done:
        done = [active]
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    found = F.coalesce("s.best", "s.miss")
    return every.select(
        *keys, found["q"].alias("q"), found["size"].alias("size"), found["damage"].alias("damage"), F.col("s.n_tried").alias("n_tried"),
        F.col("s.best").isNotNull().alias("converged"),
    )


def _middle(lo: Column, hi: Column) -> Column:
    return F.floor((lo + hi) / 2).cast("int")


def _wanted(ahead: int) -> Column:
    """The rungs that a search asks for in a round."""
    if ahead == 1:
        return F.array("s.q")
    q, lo, hi = F.col("s.q"), F.col("s.lo"), F.col("s.hi")
    return F.when(F.col("s.steps") == 0, F.slice("ladder", F.col("s.pos") + 1, F.lit(ahead))).otherwise(
        F.array(q, F.when(F.col("s.steps") < BISECT_STEPS, _middle(lo, q)), F.when(F.col("s.steps") < BISECT_STEPS, _middle(q, hi))))


def _moved(s: Column, turn: Column) -> Column:
    """A bracket after the measurement of the rung it wants: what it wants next, NULL if nothing. In later turns of a round a rung
    that is not known is waited for."""
    m = F.try_element_at(F.col("_known"), s["q"])
    target, scanning = F.col("target"), s["steps"] == 0
    there = F.coalesce(m["damage"].isNotNull(), F.lit(False))
    ok = F.coalesce(m["damage"] < target, F.lit(False))
    miss = there & ~ok
    rung = F.struct(m["size"].alias("size"), m["damage"].alias("damage"), s["q"].alias("q"))
    lo, hi = F.when(miss, s["q"]).otherwise(s["lo"]), F.when(ok, s["q"]).otherwise(s["hi"])
    pos = F.when(scanning & ok, s["pos"] + 1).otherwise(s["pos"])
    mid = _middle(lo, hi)
    room = F.when(scanning, hi > lo + BISECT_GAP).otherwise((mid > lo) & (s["steps"] < BISECT_STEPS))
    after = F.struct(
        pos.alias("pos"),
        F.when(scanning & ok, F.get("ladder", pos)).when(there & room, mid).alias("q"),
        lo.alias("lo"), hi.alias("hi"),
        F.when(ok, F.least(s["best"], rung)).otherwise(s["best"]).alias("best"),
        F.when(miss & scanning, rung).otherwise(s["miss"]).alias("miss"),
        (s["n_tried"] + there.cast("int")).alias("n_tried"),
        F.when(there & ~(scanning & ok), s["steps"] + 1).otherwise(s["steps"]).alias("steps"),
    )
    return F.when(s["q"].isNull() | ((turn > 1) & ~there), s).otherwise(after)
