"""Temporal graphs of episodes: edges, ids, metrics and patterns. Everything is keyed by ``subject_id``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.functions.scalars import digest, iso
from tideline.sources.tables import cut

SIDE = ("episode_index", "start_us", "end_us", "dominant_label", "episode_id")


def overlap_us(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_coefficient(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared time over the shorter duration; 0 without shared time."""
    shared = overlap_us(a0, a1, b0, b1)
    return F.when(shared > 0, shared / F.least(a1 - a0, b1 - b0)).otherwise(0.0)


def gap_us(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), b0 - a1, a0 - b1)


def episode_pairs(episodes: DataFrame, within_us: int | None) -> DataFrame:
    """Pairs i < j of a subject's episodes; with ``within_us`` only those at most so far apart.

    The range condition is symmetric, so it holds for episodes in any order of time."""
    kept = episodes.select("subject_id", *SIDE)
    a, b = (kept.select("subject_id", *(F.col(c).alias(f"{c}_{s}") for c in SIDE)) for s in "ab")
    near = F.lit(True) if within_us is None else (F.col("start_us_b") <= F.col("end_us_a") + within_us) & (F.col("start_us_a") <= F.col("end_us_b") + within_us)
    return a.join(b, "subject_id").filter((F.col("episode_index_a") < F.col("episode_index_b")) & near)


def classified(pairs: DataFrame, threshold_us: int) -> DataFrame:
    """Pairs with ``overlap_coefficient gap_us relation weight``."""
    ends = [F.col(c) for c in ("start_us_a", "end_us_a", "start_us_b", "end_us_b")]
    got = pairs.withColumns({"overlap_coefficient": overlap_coefficient(*ends), "gap_us": gap_us(*ends)})
    relation = F.when(F.col("overlap_coefficient") > 0, "overlapping").when(F.col("gap_us") <= threshold_us, "adjacent").otherwise("disjoint")
    close = F.greatest(F.lit(0.0), 1 - F.col("gap_us") / F.lit(float(threshold_us))) if threshold_us else F.lit(1.0)
    return got.withColumn("relation", relation).withColumn("weight", F.when(F.col("relation") == "overlapping", 1.0).when(F.col("relation") == "adjacent", close).otherwise(0.0))


def narrative_edges(episodes: DataFrame, threshold_us: int, include_disjoint: bool = False) -> DataFrame:
    """``subject_id source_index target_index relation weight`` and both labels and ids."""
    got = classified(episode_pairs(episodes, None if include_disjoint else threshold_us), threshold_us)
    got = got if include_disjoint else got.filter(F.col("relation") != "disjoint")
    return got.select(
        "subject_id", F.col("episode_index_a").alias("source_index"), F.col("episode_index_b").alias("target_index"), "relation", "weight",
        F.col("dominant_label_a").alias("source_label"), F.col("dominant_label_b").alias("target_label"), F.col("episode_id_a").alias("source_id"), F.col("episode_id_b").alias("target_id"),
    )


def edges_touching(edges: DataFrame, node: Column) -> DataFrame:
    return edges.filter((F.col("source_index") == node) | (F.col("target_index") == node))


def edges_by_relation(edges: DataFrame, relation: str) -> DataFrame:
    return edges.filter(F.col("relation") == relation)


def graph_ids(episodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A digest of the episode ids and of the edges in order; weights don't enter."""
    nodes = episodes.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("episode_index", "episode_id"))).alias("n"))
    lines = edges.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("source_index", "target_index", "relation"))).alias("e"))
    text = F.concat(
        F.array_join(F.transform("n", lambda x: F.concat(F.lit(":"), x["episode_id"])), ""),
        F.coalesce(F.array_join(F.transform("e", lambda x: F.concat_ws(":", F.lit(""), x["source_index"].cast("string"), x["target_index"].cast("string"), x["relation"])), ""), F.lit("")),
    )
    return nodes.join(lines, "subject_id", "left").select("subject_id", digest(text).alias("graph_id"))


def frontend_nodes(episodes: DataFrame) -> DataFrame:
    """Nodes re-numbered by start time as a client draws them: id, times, label, count and hours."""
    order = Window.partitionBy("subject_id").orderBy("start_us", "episode_index")
    hours = F.round((F.col("end_us") - F.col("start_us")) / 3_600_000_000, 4)
    return episodes.select("subject_id", (F.row_number().over(order) - 1).cast("long").alias("node"), "episode_id", iso(F.col("start_us")).alias("start_time"), iso(F.col("end_us")).alias("end_time"), F.coalesce("dominant_label", F.lit("unknown")).alias("label"), "event_count", hours.alias("hours"))


def frontend_edges(episodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges over nodes re-numbered by start time, ends in order, with an id of their episode ids."""
    order = Window.partitionBy("subject_id").orderBy("start_us", "episode_index")
    nodes = episodes.select("subject_id", "episode_index", "episode_id", (F.row_number().over(order) - 1).cast("long").alias("node"))
    s = nodes.select("subject_id", F.col("episode_index").alias("source_index"), F.col("node").alias("s"), F.col("episode_id").alias("sid"))
    t = nodes.select("subject_id", F.col("episode_index").alias("target_index"), F.col("node").alias("t"), F.col("episode_id").alias("tid"))
    got = edges.select("subject_id", "source_index", "target_index", "relation").join(s, ["subject_id", "source_index"]).join(t, ["subject_id", "target_index"])
    swap = F.col("s") > F.col("t")
    name = F.when(swap, F.concat_ws(":", "tid", "sid")).otherwise(F.concat_ws(":", "sid", "tid"))
    return got.select("subject_id", F.least("s", "t").alias("source"), F.greatest("s", "t").alias("target"), "relation", digest(name).alias("edge_id"))


def degree_centrality(episodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree, in- and out-degree over n - 1 for every node; 1 for a single node."""
    end = lambda e, o, i: F.struct(F.col(e).alias("episode_index"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = edges.select("subject_id", F.inline(F.array(end("source_index", 1, 0), end("target_index", 0, 1))))
    counts = ends.groupBy("subject_id", "episode_index").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    got = episodes.select("subject_id", "episode_index", F.count("*").over(Window.partitionBy("subject_id")).alias("n")).join(counts, ["subject_id", "episode_index"], "left")
    over = lambda c: F.when(F.col("n") == 1, 1.0).otherwise(F.coalesce(c, F.lit(0)) / (F.col("n") - 1))
    return got.select("subject_id", "episode_index", over(F.col("o") + F.col("i")).alias("degree"), over(F.col("i")).alias("in_degree"), over(F.col("o")).alias("out_degree"))


def graph_summary(episodes: DataFrame, edges: DataFrame, threshold_us: int) -> DataFrame:
    """Nodes, edges, density, weak components and acyclicity per subject.

    ``edges`` are those of ``narrative_edges`` with the same threshold. Episodes cut by gaps are in order of time, so a
    component of these edges is a stretch in which no neighbours are further apart: one running sum, no iteration."""
    w = Window.partitionBy("subject_id").orderBy("episode_index")
    breaks = episodes.withColumn("__b", F.when(F.col("start_us") - F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1)) > threshold_us, 1).otherwise(0))
    nodes = breaks.groupBy("subject_id").agg(F.count("*").alias("node_count"), (F.sum("__b") + 1).alias("component_count"))
    # Edges lead from lower to higher indices; without one that leads back there can be no cycle.
    lines = edges.groupBy("subject_id").agg(F.count("*").alias("m"), F.bool_and(F.col("source_index") < F.col("target_index")).alias("upward"))
    got = nodes.join(lines, "subject_id", "left").withColumn("edge_count", F.coalesce("m", F.lit(0)))
    n = F.col("node_count")
    return got.select("subject_id", "node_count", "edge_count", F.when(n <= 1, 0.0).otherwise(F.col("edge_count") / (n * (n - 1))).alias("density"), "component_count", F.coalesce("upward", F.lit(True)).alias("is_dag"))


def common_transitions(edges: DataFrame, k: int | None = 10) -> DataFrame:
    """Label transitions by count per subject, the first edge deciding ties; at most ``k`` each (a report)."""
    got = edges.filter("source_label IS NOT NULL AND target_label IS NOT NULL").groupBy("subject_id", "source_label", "target_label").agg(F.count("*").alias("n"), F.min(F.struct("source_index", "target_index")).alias("first"))
    ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("n"), "first")))
    return (ranked if k is None else ranked.filter(F.col("rank") <= k)).select("subject_id", "source_label", "target_label", "n", F.col("rank").cast("long").alias("rank"))


def label_distribution(episodes: DataFrame) -> DataFrame:
    return episodes.filter("dominant_label IS NOT NULL").groupBy("subject_id", "dominant_label").agg(F.count("*").alias("n"))


#: Cycles of a subject that are reported.
MOST_CYCLES = 20


def label_cycles(edges: DataFrame, most: int | None = MOST_CYCLES) -> DataFrame:
    """Simple cycles among a subject's label transitions, least label first: all lengths, the ``most`` shortest of each
    subject (a report; None for all).

    The label graph has a node per label, so no cycle is longer than the number of labels. Paths grow by a label at a
    time from their least label; once the shorter cycles of a subject are enough, its paths end."""
    steps = edges.filter("source_label IS NOT NULL AND target_label IS NOT NULL").select("subject_id", F.col("source_label").alias("a"), F.col("target_label").alias("b")).distinct()
    longest = steps.groupBy("subject_id").agg(F.count_distinct("a").alias("n")).agg(F.max("n")).first()[0] or 1
    paths = steps.select("subject_id", F.col("a").alias("start"), F.col("b").alias("last"), F.array("a").alias("path"))
    found = paths.filter("start = last").select("subject_id", "path")
    paths = paths.filter("start < last").withColumn("path", F.array_append("path", F.col("last")))
    for _ in range(longest - 1):
        grown = paths.join(steps, (paths["subject_id"] == steps["subject_id"]) & (paths["last"] == steps["a"])).select(paths["subject_id"], "start", "path", F.col("b"))
        found = found.union(grown.filter("b = start").select("subject_id", "path"))
        paths = grown.filter((F.col("b") > F.col("start")) & ~F.array_contains("path", F.col("b"))).select("subject_id", "start", F.col("b").alias("last"), F.array_append("path", F.col("b")).alias("path"))
        if most is not None and longest > 3:
            enough = found.groupBy("subject_id").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("subject_id")
            paths = cut(paths.join(enough, "subject_id", "left_anti"))
            found = cut(found)
            if paths.isEmpty():
                break
    got = found.select("subject_id", F.array_join("path", ">").alias("cycle"), F.size("path").cast("long").alias("length")).distinct()
    if most is None:
        return got
    rank = F.row_number().over(Window.partitionBy("subject_id").orderBy("length", "cycle"))
    return got.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank")


def path_shares(n: int, tails: np.ndarray, heads: np.ndarray, lengths: np.ndarray, sources: int) -> np.ndarray:
    """For each node the shares of shortest paths from the first ``sources`` nodes to other nodes that it lies on.

    Edges lead from lower to higher numbers, so the nodes are in topological order. Forward, for all sources at once:
    distances and numbers of shortest paths. Backward: over the paths that go on from a node, the sum of one by the number
    of paths to their end; times the number of paths to the node that is its share."""
    far, ways = np.full((sources, n), np.inf), np.zeros((sources, n))
    own = np.arange(sources)
    far[own, own], ways[own, own] = 0.0, 1.0
    by_head = np.lexsort((tails, heads))
    tails, heads, lengths = tails[by_head], heads[by_head], lengths[by_head]
    begins = np.searchsorted(heads, np.arange(n + 1))
    reached = np.flatnonzero(np.diff(begins))
    for node in reached:
        into = slice(begins[node], begins[node + 1])
        reach = far[:, tails[into]] + lengths[into]
        least = reach.min(axis=1)
        nearer = least < far[:, node]
        far[nearer, node] = least[nearer]
        ways[nearer, node] = np.where(reach == least[:, None], ways[:, tails[into]], 0.0).sum(axis=1)[nearer]
    onward = np.zeros_like(ways)
    for node in reached[::-1]:
        into = slice(begins[node], begins[node + 1])
        on = (far[:, tails[into]] + lengths[into] == far[:, [node]]) & np.isfinite(far[:, [node]])
        here = 1 / np.where(ways[:, node] > 0, ways[:, node], 1.0) + onward[:, node]
        np.add.at(onward.T, tails[into], np.where(on, here[:, None], 0.0).T)
    ways[own, own] = 0.0  # the ends of a path don't count
    return (ways * onward).sum(axis=0)


#: Sources that a task takes at a time, and cells (sources times nodes) of its matrices; of a long stretch it takes fewer.
SOURCES, CELLS = 256, 4_000_000


def stretches(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """``nodes`` (``subject_id node``) with ``low`` and ``n_stretch``: the first node and the number of nodes of their
    stretch. A stretch ends where no edge of ``lines`` (``source`` below ``target``) leads on, so paths stay inside."""
    order = Window.partitionBy("subject_id").orderBy("node")
    reach = lines.groupBy("subject_id", F.col("source").alias("node")).agg(F.max("target").alias("to"))
    before = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = nodes.join(reach, ["subject_id", "node"], "left").withColumn("begins", F.coalesce(before < F.col("node"), F.lit(True)))
    placed = begun.select("subject_id", "node", F.max(F.when(F.col("begins"), F.col("node"))).over(order).alias("low"))
    return placed.join(placed.groupBy("subject_id", "low").agg(F.count("*").alias("n_stretch")), ["subject_id", "low"])


def betweenness(episodes: DataFrame, edges: DataFrame, distance: str = "weight") -> DataFrame:
    """Betweenness of every node. ``distance`` is "weight" (an edge's weight is its length), "1-weight" or "hop".

    Edges lead from a lower to a higher index. A subject's graph falls into stretches that no edge joins, and these into
    blocks of sources; a block gets the edges of its stretch from its first source on, as rows in order, and its shares are
    added up. A task holds the edges of one stretch (24 bytes each) and matrices of ``CELLS`` cells, or of one source's
    row where a stretch is longer; the work grows with nodes times edges of a stretch."""
    length = {"weight": F.col("weight"), "1-weight": 1 - F.col("weight"), "hop": F.lit(1.0)}[distance]
    nodes = episodes.select("subject_id", "episode_index", (F.row_number().over(Window.partitionBy("subject_id").orderBy("episode_index")) - 1).cast("long").alias("node"))
    size = nodes.groupBy("subject_id").agg(F.count("*").alias("n"))
    ends = [nodes.select("subject_id", F.col("episode_index").alias(f"{e}_index"), F.col("node").alias(e)) for e in ("source", "target")]
    lines = edges.select("subject_id", "source_index", "target_index", length.cast("double").alias("w")).join(ends[0], ["subject_id", "source_index"]).join(ends[1], ["subject_id", "target_index"])
    upward = F.when(F.col("source") < F.col("target"), F.col("target")).otherwise(F.raise_error(F.lit("an edge leads to a lower index")).cast("long"))
    lines = lines.select("subject_id", "source", upward.alias("target"), "w")
    inside = stretches(nodes.select("subject_id", "node"), lines).withColumnRenamed("node", "source")
    step = F.greatest(F.lit(1), F.least(F.lit(SOURCES), F.floor(F.lit(CELLS) / F.col("n_stretch")))).cast("long")
    blocked = lines.join(inside, ["subject_id", "source"]).withColumn("step", step)
    first = F.explode(F.sequence(F.col("low"), F.col("source"), F.col("step")))
    blocked = blocked.select("subject_id", first.alias("first"), "step", "source", "target", "w")
    tasks = int(episodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as small blocks are long work
    blocked = blocked.repartition(tasks, "subject_id", "first").sortWithinPartitions("subject_id", "first", "source", "target")

    def run(batches):
        def shares_of(subject, first, step, held):
            tails, heads, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            n = int(heads.max()) - first + 1
            share = path_shares(n, tails - first, heads - first, lengths, min(step, n))
            on = np.flatnonzero(share)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(on), subject)), pa.array(first + on), pa.array(share[on])], ["subject_id", "node", "share"])

        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("subject_id", "first", "step")])
            values = [batch.column(c).to_numpy() for c in ("source", "target", "w")]
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                new = tuple(int(x) for x in keys[:, a])
                if new != key:
                    if held:
                        yield shares_of(*key, held)
                    key, held = new, []
                held.append([v[a:b].copy() for v in values])
        if held:
            yield shares_of(*key, held)

    shares = blocked.mapInArrow(run, "subject_id long, node long, share double").groupBy("subject_id", "node").agg(F.sum("share").alias("share"))
    got = nodes.join(size, "subject_id").join(shares, ["subject_id", "node"], "left")
    n, share = F.col("n"), F.coalesce("share", F.lit(0.0))
    return got.select("subject_id", "episode_index", F.when(n > 2, share / ((n - 1) * (n - 2))).otherwise(share).alias("betweenness"))


def node_metrics(episodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per node with its times, label, degrees and betweenness."""
    keys = ["subject_id", "episode_index"]
    edges = cut(edges.select("subject_id", "source_index", "target_index", "weight"))  # read three times
    rows = episodes.select(*keys, iso(F.col("start_us")).alias("start_time"), iso(F.col("end_us")).alias("end_time"), "dominant_label")
    return rows.join(degree_centrality(episodes, edges), keys).join(betweenness(episodes, edges), keys)


def graph_report(episodes: DataFrame, edges: DataFrame, threshold_us: int) -> DataFrame:
    """A row per subject: summary, and its transitions, cycles and label counts as arrays in order. A report: ten
    transitions and ``MOST_CYCLES`` cycles at most."""
    listed = lambda df, name, *columns: df.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    got = graph_summary(episodes, edges, threshold_us)
    got = got.join(listed(common_transitions(edges), "transitions", "rank", "source_label", "target_label", "n"), "subject_id", "left")
    got = got.join(listed(label_cycles(edges), "cycles", "length", "cycle"), "subject_id", "left")
    return got.join(listed(label_distribution(episodes), "labels", "dominant_label", "n"), "subject_id", "left")


def blended_edges(edges: DataFrame, signatures: DataFrame, dimensions: list[str], place_weight: float = 0.3) -> DataFrame:
    """Edges whose weight is blended with the cosine of both ends' signatures where both have one.

    ``signatures`` has ``subject_id episode_index`` and the dimensions."""
    if not 0 <= place_weight <= 1:
        raise ValueError("place_weight must be within [0, 1]")
    from tideline.functions.scalars import cosine

    s, t = (signatures.select("subject_id", F.col("episode_index").alias(f"{end}_index"), *(F.col(d).alias(f"{d}_{end}") for d in dimensions), F.lit(True).alias(f"has_{end}")) for end in ("source", "target"))
    got = edges.join(s, ["subject_id", "source_index"], "left").join(t, ["subject_id", "target_index"], "left")
    close = cosine([F.col(f"{d}_source") for d in dimensions], [F.col(f"{d}_target") for d in dimensions])
    mixed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - place_weight) * F.col("weight") + place_weight * close))
    return got.select("subject_id", "source_index", "target_index", "relation", F.when(F.col("has_source") & F.col("has_target"), mixed).otherwise(F.col("weight")).alias("weight"))
