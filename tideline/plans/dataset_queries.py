"""Queries over data sets: positions in pictures, faces, and lines cut at their last comma."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideline.sources import datasets, exif, tables
from tideline.sources.adapters import table


def pictures(spark, sf_dir):
    """A TIFF for each customer, high byte first, whose position and time follow from the key; every fifth has no position."""
    k = F.col("c_custkey")
    number = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    rational = lambda a, b: F.concat(number(a), number(F.lit(b)))
    entry = lambda tag, kind, count, value: F.concat(F.lit(f"{tag:04X}{kind:04X}{count:08X}"), value)
    letter = lambda flag, yes, no: F.when(flag, f"{ord(yes):02X}000000").otherwise(f"{ord(no):02X}000000")
    # Header of 8 bytes, a directory with one entry (18), one with six (78), then three triples of rationals and the date.
    head = F.concat(F.lit("4D4D002A000000080001"), entry(0x8825, 4, 1, F.when(k % 5 == 0, F.lit("0000FFFF")).otherwise("0000001A")), F.lit("00000000"))
    gps = F.concat(
        F.lit("0006"), entry(1, 2, 2, letter(k % 2 == 0, "N", "S")), entry(2, 5, 3, number(F.lit(104))), entry(3, 2, 2, letter(k % 3 == 0, "E", "W")), entry(4, 5, 3, number(F.lit(128))),
        entry(7, 5, 3, number(F.lit(152))), entry(29, 2, 11, number(F.lit(176))), F.lit("00000000"),
    )
    lat = F.concat(rational(k % 90, 1), rational(k % 60, 1), rational(k * 7 % 6000, 100))
    lon = F.concat(rational(k % 180, 1), rational(k * 3 % 60, 1), rational(k * 11 % 6000, 100))
    time = F.concat(rational(k % 24, 1), rational(k % 60, 1), rational(k * 5 % 60, 1))
    date = F.concat(F.hex(F.concat(F.lit("2024:01:"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))), F.lit("00"))
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("path"), F.unhex(F.concat(head, gps, lat, lon, time, date)).alias("content"))


def positions(spark, sf_dir):
    return exif.positions(pictures(spark, sf_dir)).select(F.col("path").cast("long").alias("c_custkey"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "timestamp")


def faces(spark, sf_dir):
    """Lines as pictures: quantities are scores, and some have a second face or an unknown gender."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.concat(F.lit("faces/"), F.col("l_partkey").cast("string"), F.lit(".jpg")).alias("full_path"),
        F.when(F.col("l_suppkey") % 3 < 2, F.col("l_suppkey") % 3).cast("double").alias("gender"), (F.col("l_quantity") / 10).alias("face_score"),
        F.when(F.col("l_linenumber") == 2, F.lit(1.0)).otherwise(F.lit(float("nan"))).alias("second_face_score"),
    )
    return datasets.imdb_faces(rows)


def lines(spark, sf_dir):
    """Files of lines written from parts: every third text is in quotes, every seventh line lacks a comma."""
    path = f"{tables.scratch(spark)}/lines-{uuid.uuid4().hex}"
    k = F.col("p_partkey")
    text = F.concat(F.lit("part "), k.cast("string"), F.lit(', of "'), "p_brand", F.lit('"'))
    quoted = F.when(k % 3 == 0, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    line = F.when(k % 7 == 0, F.lit("no label here")).otherwise(F.concat(quoted, F.lit(" ,"), "p_type"))
    out = table(spark, sf_dir, "part").select(line.alias("text, kind"))
    out.write.option("header", True).option("sep", datasets.NO_SEPARATOR[0]).option("quote", "\0").option("escape", "\0").csv(path)
    return datasets.last_comma_rows(spark, path)


QUERIES = {
    "picture_positions": positions,
    "faces_of_one_person": faces,
    "labelled_lines": lines,
    "class_names": lambda s, d: table(s, d, "embeddings").select(
        "vec_id", datasets.class_name("fer2013", F.col("label")).alias("emotion"), datasets.class_name("KDEF", F.col("label")).alias("code"),
        F.array_join(datasets.one_hot("KDEF", datasets.class_id("KDEF", datasets.class_name("KDEF", F.col("label")))).cast("array<string>"), "").alias("classes"),
    ),
}
_list = lambda name: "[" + ", ".join(f"'{c}'" for c in datasets.CLASSES[name]) + "]"
ORACLES = {
    "picture_positions": """SELECT c_custkey, round(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (c_custkey % 90 + c_custkey % 60 / 60.0::DOUBLE + c_custkey * 7 % 6000 / 100.0::DOUBLE / 3600), 6) AS lat,
  round(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE -1 END * (c_custkey % 180 + c_custkey * 3 % 60 / 60.0::DOUBLE + c_custkey * 11 % 6000 / 100.0::DOUBLE / 3600), 6) AS lon,
  strftime(make_timestamp(2024, 1, c_custkey % 28 + 1, c_custkey % 24, c_custkey % 60, CAST(c_custkey * 5 % 60 AS DOUBLE)), '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp FROM customer WHERE c_custkey % 5 <> 0""",
    "faces_of_one_person": """SELECT 'faces/' || l_partkey || '.jpg' AS full_path, CAST(arg_max(l_suppkey % 3, l_orderkey * 10 + l_linenumber) AS INTEGER) AS gender, ['woman', 'man'][CAST(arg_max(l_suppkey % 3, l_orderkey * 10 + l_linenumber) AS INTEGER) + 1] AS label
FROM lineitem WHERE l_quantity > 30 AND l_linenumber <> 2 AND l_suppkey % 3 < 2 GROUP BY l_partkey""",
    "labelled_lines": """SELECT CASE WHEN p_partkey % 7 <> 0 THEN 'part ' || p_partkey || ', of "' || p_brand || '"' END AS text, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS label, p_partkey % 7 = 0 AS malformed FROM part""",
    "class_names": f"SELECT vec_id, {_list('fer2013')}[label + 1] AS emotion, {_list('KDEF')}[label + 1] AS code, array_to_string(list_transform(range(7), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), '') AS classes FROM embeddings",
}
