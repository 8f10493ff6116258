"""Windows and episodes of timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.functions.scalars import digest, iso, ordinal
from tideline.operators.timeline import ordered


def window_index(us: Column, anchor: Column, width_us: int) -> Column:
    """Half-open windows from an anchor; earlier times have negative indices."""
    return F.floor((us - anchor) / F.lit(width_us)).cast("long")


def fixed_windows(events: DataFrame, width_us: int, anchor: Column | None = None) -> DataFrame:
    """Events with ``window_index``; the anchor is the subject's first event unless given."""
    first = F.min("us").over(Window.partitionBy("subject_id")) if anchor is None else anchor
    got = events.withColumn("__anchor", first)
    # Whole microseconds divide exactly: an event on a boundary belongs to the later window.
    off = F.col("us") - F.col("__anchor")
    return got.withColumn("window_index", ((off - F.pmod(off, F.lit(width_us))) / F.lit(width_us)).cast("long")).withColumn("anchor_us", F.col("__anchor")).drop("__anchor")


def window_scores(windowed: DataFrame, use_scores: bool = False) -> DataFrame:
    """Mean label ordinal (or mean score) per subject and window; windows without a value are left out."""
    value = F.col("score") if use_scores else ordinal(F.col("label"))
    return windowed.groupBy("subject_id", "window_index").agg(F.avg(value).alias("window_score"), F.count("*").alias("event_count")).filter(F.col("window_score").isNotNull())


def self_similarity(scores: DataFrame) -> DataFrame:
    """Least, greatest and population variance of a subject's window means, and how many there are."""
    return scores.groupBy("subject_id").agg(F.min("window_score").alias("min_score"), F.max("window_score").alias("max_score"), F.var_pop("window_score").alias("variance"), F.count("*").alias("window_count"), F.sum("event_count").alias("event_count"))


def dense_windows(events: DataFrame, width_us: int) -> DataFrame:
    """All windows from a subject's first to its last event, the empty ones too, with bounds and counts."""
    counts = fixed_windows(events, width_us).groupBy("subject_id", "anchor_us", "window_index").agg(F.count("*").alias("n"))
    last = counts.groupBy("subject_id", "anchor_us").agg(F.max("window_index").alias("last"))
    spine = last.select("subject_id", "anchor_us", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("window_index"))
    got = spine.join(counts.drop("anchor_us"), ["subject_id", "window_index"], "left")
    start = F.col("anchor_us") + F.col("window_index") * width_us
    return got.select("subject_id", "window_index", start.alias("start_us"), (start + width_us).alias("end_us"), F.coalesce("n", F.lit(0)).alias("event_count"))


def align_to_windows(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events of every subject in each given window (``window_index start_us end_us``), empty ones kept.

    Windows are a small list given by the caller; the events are joined to it by range."""
    subjects = events.select("subject_id").distinct()
    inside = events.join(F.broadcast(windows), (events["us"] >= windows["start_us"]) & (events["us"] < windows["end_us"]))
    counted = inside.groupBy("subject_id", "window_index").agg(F.count("*").alias("n"), F.min_by("label", F.struct("us", "seq")).alias("first_label"))
    grid = subjects.crossJoin(F.broadcast(windows))
    return grid.join(counted, ["subject_id", "window_index"], "left").select("subject_id", "window_index", F.coalesce("n", F.lit(0)).alias("event_count"), "first_label")


def align_first_event(events: DataFrame, width_us: int, anchor: str = "start", anchor_us: int | None = None) -> DataFrame:
    """A dense grid of subjects and windows over all timelines with the earliest event in each, or null.

    ``anchor`` is the first event of all ("start"), windows counted back from the last one ("end") or an
    explicit time, before which events are dropped."""
    ends = events.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    if anchor == "explicit":
        base = F.lit(anchor_us).cast("long")
    elif anchor == "end":
        base = F.col("hi") - F.ceil((F.col("hi") - F.col("lo")) / F.lit(width_us)) * F.lit(width_us)
    else:
        base = F.col("lo")
    ends = ends.select(base.cast("long").alias("base"), F.greatest(F.lit(1), F.floor((F.col("hi") - base) / F.lit(width_us)) + 1).cast("long").alias("n"))
    got = events.crossJoin(F.broadcast(ends)).filter("us >= base").withColumn("window_index", F.floor((F.col("us") - F.col("base")) / F.lit(width_us)).cast("long"))
    first = got.groupBy("subject_id", "window_index").agg(F.min_by(F.struct("seq", "label"), F.struct("us", "seq")).alias("e"))
    grid = events.select("subject_id").distinct().crossJoin(F.broadcast(ends)).select("subject_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("window_index"))
    return grid.join(first, ["subject_id", "window_index"], "left").select("subject_id", "window_index", F.col("e.seq").alias("seq"), F.col("e.label").alias("label"))


def gap_sessions(events: DataFrame, gap_us: int) -> DataFrame:
    """Events with ``episode_index``: a gap above ``gap_us`` starts a new one, an equal gap doesn't."""
    w = ordered()
    opens = F.when(F.col("us") - F.lag("us").over(w) > gap_us, 1).otherwise(0)
    return events.withColumn("__open", opens).withColumn("episode_index", F.sum("__open").over(w).cast("long")).drop("__open")


def gap_episodes(events: DataFrame, gap_us: int) -> DataFrame:
    """Episodes of every subject: ``[start_us, end_us)``, count, id, and dominant label (first seen on ties).

    An episode ends a second after its last event; the only event of a subject ends a microsecond after."""
    got = gap_sessions(events, gap_us)
    labels = got.groupBy("subject_id", "episode_index", "label").agg(F.count("*").alias("n"), F.min(F.struct("us", "seq")).alias("first"), F.max("us").alias("last"))
    per = labels.groupBy("subject_id", "episode_index").agg(
        F.min("first.us").alias("start_us"), F.max("last").alias("last_us"), F.sum("n").alias("event_count"),
        F.max_by("label", F.when(F.col("label").isNotNull(), F.struct(F.col("n"), -F.col("first.us"), -F.col("first.seq")))).alias("dominant_label"),
    )
    alone = F.sum("event_count").over(Window.partitionBy("subject_id")) == 1
    per = per.withColumn("end_us", F.col("last_us") + F.when(alone, 1).otherwise(1_000_000)).drop("last_us")
    name = F.concat_ws(":", F.col("subject_id").cast("string"), iso(F.col("start_us")), iso(F.col("end_us")))
    return per.withColumn("episode_id", digest(name))


def episode_violations(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """Broken invariants of episodes and their events (``subject_id episode_index us seq``): ``subject_id episode_index
    problem n``. An episode starts no later than it ends, and its events are inside of ``[start_us, end_us)`` and in order."""
    keys = ["subject_id", "episode_index"]
    before = F.lag("us").over(Window.partitionBy(*keys).orderBy("seq"))
    rows = events.select(*keys, "us", (F.col("us") < before).alias("late")).join(episodes.select(*keys, "start_us", "end_us"), keys)
    kinds = {"event before start": F.col("us") < F.col("start_us"), "event at or after end": F.col("us") >= F.col("end_us"), "events out of order": F.coalesce("late", F.lit(False))}
    counts = rows.groupBy(*keys).agg(*(F.count_if(v).alias(k) for k, v in kinds.items())).unpivot(keys, list(kinds), "problem", "n").filter("n > 0")
    return episodes.filter("start_us > end_us").select(*keys, F.lit("start after end").alias("problem"), F.lit(1).cast("long").alias("n")).unionByName(counts)


def episode_percentages(episodes: DataFrame, estimates: DataFrame) -> DataFrame:
    """Mean positive, neutral and negative of an episode's complete ``estimates`` (with ``subject_id episode_index``) in
    percent, rounded half up; an episode without any has zeros."""
    keys, classes = ["subject_id", "episode_index"], ("positive", "neutral", "negative")
    whole = estimates.dropna(subset=list(classes)).groupBy(*keys).agg(*(F.floor(F.avg(c) * 100 + 0.5).cast("long").alias(c) for c in classes))
    return episodes.select(*keys).join(whole, keys, "left").select(*keys, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in classes))
