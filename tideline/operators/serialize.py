"""Canonical JSON payloads of timelines, episodes and graphs (schema 1.0), and how to read them back.

A payload is a row ``fingerprint schema_version data_json``; keys stand in order, and null fields are left out. A timeline
or graph is one document by its format, so its events are gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.scalars import iso
from tideline.operators.timeline import structural_fingerprint

VERSION = "1.0"
EVENT = "struct<emotion_label:string,metadata:map<string,string>,score:double,source_id:string,timestamp:string>"
EPISODE = f"struct<end_time:string,events:array<{EVENT}>,source_subject_id:string,start_time:string>"
EDGE = "struct<relation:string,source_index:long,target_index:long>"


def _events(rows: DataFrame) -> Column:
    """Events in order of time, from ``us seq label score`` and, if they are there, ``source_id metadata``."""
    source = F.col("source_id") if "source_id" in rows.columns else F.col("seq").cast("string")
    metadata = [F.col("metadata")] if "metadata" in rows.columns else []
    item = F.struct(F.col("label").alias("emotion_label"), *metadata, "score", source.alias("source_id"), iso(F.col("us")).alias("timestamp"))
    return F.transform(F.array_sort(F.collect_list(F.struct("us", "seq", item.alias("e"))), lambda a, b: F.when(a["us"] < b["us"], -1).when(a["us"] > b["us"], 1).when(a["seq"] < b["seq"], -1).otherwise(1)), lambda x: x["e"])


def timeline_payloads(events: DataFrame) -> DataFrame:
    got = events.groupBy("subject_id").agg(_events(events).alias("events"))
    data = F.to_json(F.struct("events", F.col("subject_id").cast("string").alias("subject_id")))
    return got.join(structural_fingerprint(events), "subject_id").select("fingerprint", F.lit(VERSION).alias("schema_version"), data.alias("data_json"))


def _with_events(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """Episodes with their document; ``events`` carry ``subject_id episode_index``."""
    got = events.groupBy("subject_id", "episode_index").agg(_events(events).alias("events"))
    document = F.struct(iso(F.col("end_us")).alias("end_time"), F.coalesce("events", F.array()).alias("events"), F.col("subject_id").cast("string").alias("source_subject_id"), iso(F.col("start_us")).alias("start_time"))
    kept = episodes.select("subject_id", "episode_index", "episode_id", "start_us", "end_us")
    return kept.join(got, ["subject_id", "episode_index"], "left").select("subject_id", "episode_index", "episode_id", document.alias("document"))


def episode_payloads(episodes: DataFrame, events: DataFrame) -> DataFrame:
    return _with_events(episodes, events).select(F.col("episode_id").alias("fingerprint"), F.lit(VERSION).alias("schema_version"), F.to_json("document").alias("data_json"))


def graph_payloads(episodes: DataFrame, events: DataFrame, edges: DataFrame, graph_ids: DataFrame, threshold_us: int) -> DataFrame:
    """Graphs with the documents of their episodes; weights are no part of the schema, so an edge read back weighs 1."""
    nodes = _with_events(episodes, events).groupBy("subject_id").agg(F.collect_list(F.struct("episode_index", "document")).alias("n"))
    nodes = nodes.withColumn("nodes", F.transform(F.array_sort("n", lambda a, b: F.when(a["episode_index"] < b["episode_index"], -1).otherwise(1)), lambda x: x["document"]))
    lines = edges.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("source_index", "target_index", "relation"))).alias("e"))
    lines = lines.select("subject_id", F.transform("e", lambda x: F.struct(x["relation"].alias("relation"), x["source_index"].alias("source_index"), x["target_index"].alias("target_index"))).alias("edges"))
    got = nodes.join(lines, "subject_id", "left").join(graph_ids, "subject_id")
    data = F.struct(F.lit(threshold_us / 1e6).alias("adjacency_threshold_seconds"), F.coalesce("edges", F.array()).alias("edges"), "nodes")
    return got.select(F.col("graph_id").alias("fingerprint"), F.lit(VERSION).alias("schema_version"), F.to_json(data).alias("data_json"))


def envelopes(payloads: DataFrame) -> DataFrame:
    """One JSON text per payload, with the data as an object inside."""
    quote = lambda c: F.substring_index(F.substring_index(F.to_json(F.struct(F.col(c).alias("x"))), '{"x":', -1), "}", 1)
    return payloads.select(F.concat(F.lit('{"data":'), "data_json", F.lit(',"fingerprint":'), quote("fingerprint"), F.lit(',"schema_version":'), quote("schema_version"), F.lit("}")).alias("json"))


def read_envelopes(texts: DataFrame) -> DataFrame:
    """Payloads of JSON texts; the data keeps its text."""
    got = F.from_json("json", "struct<data:string,fingerprint:string,schema_version:string>")
    return texts.select(got.alias("p")).select("p.fingerprint", "p.schema_version", F.col("p.data").alias("data_json"))


def read_timelines(payloads: DataFrame) -> DataFrame:
    """``subject_id place`` and the events of timelines."""
    parsed = payloads.select(F.from_json("data_json", f"struct<events:array<{EVENT}>,subject_id:string>").alias("d"))
    return parsed.select("d.subject_id", F.posexplode("d.events").alias("place", "e")).select("subject_id", F.col("place").cast("long").alias("place"), "e.*")


def read_episodes(payloads: DataFrame) -> DataFrame:
    """``fingerprint subject_id start_time end_time place`` and the events of episodes."""
    parsed = payloads.select("fingerprint", F.from_json("data_json", EPISODE).alias("d"))
    return parsed.select("fingerprint", F.col("d.source_subject_id").alias("subject_id"), "d.start_time", "d.end_time", F.posexplode("d.events").alias("place", "e")).select("fingerprint", "subject_id", "start_time", "end_time", F.col("place").cast("long").alias("place"), "e.*")


def read_nodes(payloads: DataFrame) -> DataFrame:
    """``fingerprint node subject_id start_time end_time event_count`` of graphs."""
    parsed = payloads.select("fingerprint", F.from_json("data_json", f"struct<nodes:array<{EPISODE}>>").alias("d"))
    nodes = parsed.select("fingerprint", F.posexplode("d.nodes").alias("node", "n"))
    return nodes.select("fingerprint", F.col("node").cast("long").alias("node"), F.col("n.source_subject_id").alias("subject_id"), "n.start_time", "n.end_time", F.size("n.events").cast("long").alias("event_count"))


def read_edges(payloads: DataFrame) -> DataFrame:
    """``fingerprint relation source_index target_index weight`` of graphs."""
    parsed = payloads.select("fingerprint", F.from_json("data_json", f"struct<edges:array<{EDGE}>>").alias("d"))
    return parsed.select("fingerprint", F.inline("d.edges")).withColumn("weight", F.lit(1.0))
