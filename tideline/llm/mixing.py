"""Mixing sources to target weights by a time-varying curriculum.

Sources in code point order (null last) take the weights in turn and share all words in proportion to them. A target
stops at `most` times its source's size, the excess is shared by weight again. That fixed point is found at once: in
the order of ceiling / weight the sources that stop are a prefix, so one running total over the sources finds them.

Each weight class has a schedule: knots (time, intensity) over training time 0 .. 1, linear in between. Its integral,
scaled to the target, is the cumulative demand of a source in words. The documents of a source lie end to end in the
order of a hash of their id, round after round, until the target is met, the last document in part. The word in the
middle of each occurrence has a cumulative place, and the inverse of the demand at that place is its training
position. A range sort by position deals the documents out for training.

Hot sources: sums are combined before the shuffle, running totals are cut into slices of each source.

Defined cases: null or empty text has size 0, is not taken and has no position; a source without words has target 0;
null is a source of its own; repeated rows are documents of their own; a null id orders like the empty one. An empty
table gives an empty result. All given columns are kept in `curriculum`; those named as its new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.ordering import running_totals
from tideline.llm.common import written

WEIGHTS = (5, 2, 1)
MOST = 3
#: Knots (time, intensity) of each weight class: the heaviest grows, the middle one stays, the lightest falls.
SCHEDULES = (((0.0, 0.5), (0.6, 1.0), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.4, 1.0), (1.0, 0.5)))
Schedule = Sequence[tuple[float, float]]


def segments(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(area before, start, width, intensity at the start, slope) of each linear piece; the area of all is 1."""
    times = [t for t, _ in schedule]
    if times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(w for _, w in schedule) < 0:
        raise ValueError("a schedule runs from time 0 to 1 with growing times and intensities of 0 or more")
    pieces = [(t, u - t, v, w) for (t, v), (u, w) in zip(schedule, schedule[1:])]
    total = sum(d * (v + w) / 2 for _, d, v, w in pieces)
    if total <= 0:
        raise ValueError("a schedule must demand something")
    out, area = [], 0.0
    for t, d, v, w in pieces:
        out.append((area, t, d, v / total, (w - v) / total / d))
        area += d * (v + w) / 2 / total
    return out


def position_at(share: Column, schedule: Schedule) -> Column:
    """The time at which a source has met `share` of its demand."""
    found = F.lit(1.0)
    rows = segments(schedule)
    for (area, start, width, low, slope), after in zip(reversed(rows), reversed([r[0] for r in rows[1:]] + [2.0])):
        rest = share - F.lit(area)
        root = F.sqrt(F.greatest(F.lit(low * low) + F.lit(2 * slope) * rest, F.lit(0.0)))
        inside = F.least(F.lit(2.0) * rest / F.nullif(F.lit(low) + root, F.lit(0.0)), F.lit(width))
        found = F.when(share < after, F.lit(start) + F.coalesce(inside, F.lit(0.0))).otherwise(found)
    return found


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, kind, source_size, target) of each source, from rows (source, size); kind is the place of its weight."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    ranked = running_totals(sums, [], ["last", "source"], {"rank": F.lit(1)})
    kind = ((F.col("rank") - 1) % len(weights)).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), kind + 1).cast("long")
    ranked = ranked.select("source", "source_size", "rank", kind.alias("kind"), weight.alias("weight"), (F.col("source_size") * most).alias("ceiling"))
    ratio = F.col("ceiling") / F.col("weight")
    upto = written(running_totals(ranked.withColumn("ratio", ratio), [], ["ratio", "rank"], {"words_upto": F.col("ceiling"), "weight_upto": F.col("weight")}))
    all_words, all_weight = (int(x or 0) for x in upto.agg(F.sum("source_size"), F.sum("weight")).first())
    wide = lambda c: c.cast("decimal(38,0)")
    words_left = F.lit(all_words) - F.col("words_upto") + F.col("ceiling")
    weight_left = F.lit(all_weight) - F.col("weight_upto") + F.col("weight")
    full = wide(words_left).cast("decimal(20,0)") * F.col("weight").cast("decimal(10,0)") >= F.col("ceiling").cast("decimal(20,0)") * weight_left.cast("decimal(10,0)")
    marked = upto.withColumn("full", full)
    taken, used = (int(x or 0) for x in marked.where("full").agg(F.sum("ceiling"), F.sum("weight")).first())
    share = F.col("weight") * F.lit(float(all_words - taken)) / F.lit(float(max(all_weight - used, 1)))
    return marked.select("source", "kind", "source_size", F.when(F.col("full"), F.col("ceiling").cast("double")).otherwise(share).alias("target"))


def planned(
    docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source",
    weights: Sequence[int] = WEIGHTS, most: int = MOST, schedules: Sequence[Schedule] = SCHEDULES,
) -> DataFrame:
    """(row, id, size, source_size, target, taken, parts) of each row of `docs`, whose columns are in the struct `row`.

    `parts` lists the occurrences in training order: (epoch, words, position).
    """
    held = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    # running totals join by their group, so the null source gets a name and a flag
    held = held.withColumn("unsourced", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    held = written(held.withColumn("place", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))))
    goals = targets(held, weights, most).withColumnRenamed("source", "goal_source")
    placed = running_totals(held, ["unsourced", "name"], ["place", "id", "size"], {"upto": F.col("size")})
    joined = placed.join(goals, F.col("source").eqNullSafe(F.col("goal_source")))
    demand = F.floor(F.col("target") + 0.5).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.expr("demand div source_size")).otherwise(F.lit(0))
    before = F.col("upto") - F.col("size")
    rest = F.greatest(F.least(F.col("demand") - F.col("rounds") * F.col("source_size") - before, F.col("size")), F.lit(0))
    joined = joined.withColumn("demand", demand).withColumn("rounds", rounds).withColumn("rest", rest)

    def occurrence(epoch: Column) -> Column:
        words = F.when(epoch < F.col("rounds"), F.col("size")).otherwise(F.col("rest"))
        share = (epoch * F.col("source_size") + before + words / 2) / F.nullif(F.col("demand"), F.lit(0))
        position = F.element_at(F.array(*(position_at(share, s) for s in schedules)), F.col("kind") % len(schedules) + 1)
        return F.struct(epoch.cast("int").alias("epoch"), words.alias("words"), position.alias("position"))

    epochs = F.sequence(F.lit(0), F.col("rounds"))
    parts = F.filter(F.transform(epochs, occurrence), lambda x: x["words"] > 0)
    taken = F.col("rounds") * F.col("size") + F.col("rest")
    return joined.select("row", "id", "size", "source_size", "target", taken.alias("taken"), F.when(F.col("size") > 0, parts).otherwise(F.slice(parts, 1, 0)).alias("parts"))


def curriculum(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The rows of `docs` in training order, once for each occurrence, with mix_epoch, mix_words and mix_position.

    The order is by range: partition by partition, and sorted inside each. A row taken in part has mix_words below its
    size.
    """
    names = [c for c in docs.columns if c not in ("mix_epoch", "mix_words", "mix_position")]
    rows = planned(docs, size, **options).select("row", "id", F.explode("parts").alias("part"))
    out = rows.select(*(F.col(f"row.`{c}`") for c in names), *(F.col(f"part.{c}").alias(f"mix_{c}") for c in ("epoch", "words", "position")))
    return out.repartitionByRange("mix_position").sortWithinPartitions("mix_position")


def word_count(text: Column) -> Column:
    """Words between spaces and control characters 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
