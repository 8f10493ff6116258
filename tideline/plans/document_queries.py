"""Queries over nested JSON documents: one per subject and day, with an entry for each of its events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.scalars import iso, iso_sql
from tideline.operators import documents as D, schemas as S
from tideline.plans.misc_queries import AS_OF
from tideline.sources.adapters import EVENTS_SQL, emotion_events
from tideline.sources.tables import cut

DAY_US = 86_400_000_000
#: What the entries must look like; identifiers are text, a capture time is no number.
SCHEMA = {
    "type": "object",
    "required": ["person_id", "samples"],
    "properties": {
        "person_id": {"type": "string", "pattern": "^p[0-9]+$"},
        "samples": {
            "type": "array",
            "minItems": 2,
            "items": {
                "type": "object",
                "required": ["sample_id", "label"],
                "properties": {
                    "sample_id": {"type": "string"},
                    "timestamp": {"type": ["string", "integer"], "not": {"type": "null"}},
                    "label": {"enum": ["positive", "neutral"]},
                    "meta": {"type": "object", "additionalProperties": False, "properties": {"capture_time": {"type": "string"}, "score": {"type": "number", "maximum": 0.5}, "deep": {"items": {"maxItems": 1}}}},
                },
            },
        },
    },
}


def person_documents(spark, sf_dir):
    """``doc document``. Times come in three forms, some entries have a second one in their ``meta`` and a third in
    lists of lists; media are empty, remote, local or numbers; some parts break ``SCHEMA``."""
    e = emotion_events(spark, sf_dir)
    seq, us = F.col("seq"), F.col("us")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    form = F.pmod(seq, F.lit(3))
    time = F.when(form == 0, text(F.concat(iso(us), F.lit("Z")))).when(form == 1, F.floor(us / 1_000_000).cast("string")).otherwise(F.floor(us / 1000).cast("string"))
    number = seq.cast("string")
    medium = F.pmod(seq, F.lit(4))
    media = F.when(medium == 0, text(F.lit(""))).when(medium == 1, text(F.concat(F.lit("S3://media/"), number))).when(medium == 2, text(F.concat(F.lit("media/"), number, F.lit(".jpg")))).otherwise(number)
    capture = F.when(seq % 5 == 0, F.concat(F.lit('"capture_time":'), text(F.concat(iso(us + DAY_US), F.lit("Z"))), F.lit(","))).otherwise("")
    deep = F.when(seq % 6 == 0, F.concat(F.lit(',"deep":[[{"TS":'), F.floor(us / 1_000_000).cast("string"), F.lit("}],[1,2]]"))).otherwise("")
    entry = F.concat(
        F.lit('{"sample_id":'), F.when(seq % 7 == 0, number).otherwise(text(F.concat(F.lit("s"), number))), F.lit(',"timestamp":'), time,
        F.when(seq % 11 == 0, "").otherwise(F.concat(F.lit(',"label":'), text(F.col("label")))), F.lit(',"image":'), media,
        F.lit(',"meta":{'), capture, F.lit('"score":0.'), F.pmod(seq, F.lit(10)).cast("string"), deep, F.lit("}}"),
    )
    day = F.floor(us / DAY_US)
    docs = e.groupBy("subject_id", day.alias("day")).agg(F.array_sort(F.collect_list(F.struct((seq + F.pmod(seq, F.lit(3)) * 40).alias("at"), seq.alias("seq"), entry.alias("entry")))).alias("entries"))
    person = F.when(F.col("subject_id") % 10 == 0, "").otherwise(F.concat(F.lit('"person_id":"'), F.when(F.col("subject_id") % 10 == 1, "q").otherwise("p"), F.col("subject_id").cast("string"), F.lit('",')))
    body = F.concat(F.lit("{"), person, F.lit('"samples":['), F.array_join(F.transform("entries", lambda x: x["entry"]), ","), F.lit("]}"))
    return docs.select(F.concat_ws(":", "subject_id", "day").alias("doc"), body.alias("document"))


def known_files(spark, sf_dir):
    """A listing of media: of three local ones the first is there, the second is a folder."""
    seq = F.col("seq")
    return emotion_events(spark, sf_dir).filter((seq % 4 == 2) & (seq % 3 != 2)).select(F.concat(F.lit("/data/media/"), seq.cast("string"), F.lit(".jpg")).alias("path"), (seq % 3 == 0).alias("is_file"))


def walked(spark, sf_dir):
    docs = cut(person_documents(spark, sf_dir))
    return docs, D.walk(docs, "doc", "document")


def time_issues(spark, sf_dir, strict=False):
    docs, found = walked(spark, sf_dir)
    return D.time_issues(found, docs, "doc", AS_OF, strict)


def times(spark, sf_dir):
    _, found = walked(spark, sf_dir)
    return D.times(found, "doc").select("doc", "path", "us", "parent", "index")


def media_issues(spark, sf_dir):
    _, found = walked(spark, sf_dir)
    return D.media_issues(found, "doc", known_files(spark, sf_dir), "/data")


def schema_issues(spark, sf_dir):
    """The message of a short array shows the array; here it is cut to its end."""
    found = S.schema_issues(person_documents(spark, sf_dir), "doc", "document", SCHEMA)
    return found.withColumn("message", F.when(F.col("location") == "samples", F.substring_index("message", "]", -1)).otherwise(F.col("message")))


def reports(spark, sf_dir):
    docs, found = walked(spark, sf_dir)
    issues = D.time_issues(found, docs, "doc", AS_OF).unionByName(D.media_issues(found, "doc", known_files(spark, sf_dir), "/data"))
    issues = issues.unionByName(S.schema_issues(docs, "doc", "document", SCHEMA)).unionByName(D.unreadable(docs, "doc", "document"))
    return D.report(docs, issues, "doc")


QUERIES = {
    "document_times": times,
    "document_time_issues": time_issues,
    "document_time_issues_strict": lambda s, d: time_issues(s, d, strict=True),
    "document_media_issues": media_issues,
    "document_schema_issues": schema_issues,
    "document_reports": reports,
}
DOCS_SQL = f"""{EVENTS_SQL}, en AS (SELECT *, subject_id || ':' || us // {DAY_US} AS doc, row_number() OVER (PARTITION BY subject_id, us // {DAY_US} ORDER BY seq + seq % 3 * 40, seq) - 1 AS i FROM ev)"""
TIMES_SQL = f"""tm AS (SELECT doc, i AS index, 0 AS k, 'samples[' || i || '].timestamp' AS path, CASE seq % 3 WHEN 0 THEN us WHEN 1 THEN us // 1000000 * 1000000 ELSE us // 1000 * 1000 END AS us FROM en
  UNION ALL SELECT doc, i, 1, 'samples[' || i || '].meta.capture_time', us + {DAY_US} FROM en WHERE seq % 5 = 0
  UNION ALL SELECT doc, i, 2, 'samples[' || i || '].meta.deep[0][0].TS', us // 1000000 * 1000000 FROM en WHERE seq % 6 = 0)"""


def _late(strict: bool) -> str:
    said, sign = ("Non-strictly-monotonic timestamps: ", "<=") if strict else ("Out-of-order timestamps: ", "<")
    return f"""lt AS (SELECT *, lag(us) OVER w AS bu, lag(path) OVER w AS bp FROM tm WINDOW w AS (PARTITION BY doc ORDER BY index, k)),
ti AS (SELECT doc, 'ERROR' AS severity, 'temporal' AS category, 'Future timestamp detected: ' || {iso_sql("us")} || '+00:00' AS message, path AS location FROM tm WHERE us > {AS_OF}
  UNION ALL SELECT doc, 'ERROR', 'temporal', '{said}' || {iso_sql("us")} || '+00:00 {sign} ' || {iso_sql("bu")} || '+00:00', path || ' (previous: ' || bp || ')' FROM lt WHERE us {sign} bu)"""


MEDIA_SQL = """mi AS (SELECT doc, CASE seq % 4 WHEN 0 THEN 'WARNING' WHEN 1 THEN 'INFO' ELSE 'ERROR' END AS severity, 'path' AS category,
  CASE WHEN seq % 4 = 0 THEN 'Empty media path' WHEN seq % 4 = 1 THEN 'Skipping remote URL validation' WHEN seq % 3 = 2 THEN 'Media file not found: media/' || seq || '.jpg' ELSE 'Path exists but is not a file: media/' || seq || '.jpg' END AS message,
  'samples[' || i || '].image' AS location FROM en WHERE seq % 4 < 2 OR seq % 4 = 2 AND seq % 3 <> 0)"""
SCHEMA_SQL = f"""si AS (SELECT DISTINCT subject_id || ':' || us // {DAY_US} AS doc, 'ERROR' AS severity, 'schema' AS category, CASE subject_id % 10 WHEN 0 THEN '''person_id'' is a required property' ELSE '''q' || subject_id || ''' does not match ''^p[0-9]+$''' END AS message, CASE subject_id % 10 WHEN 0 THEN 'root' ELSE 'person_id' END AS location FROM ev WHERE subject_id % 10 < 2
  UNION ALL SELECT doc, 'ERROR', 'schema', seq || ' is not of type ''string''', 'samples.' || i || '.sample_id' FROM en WHERE seq % 7 = 0
  UNION ALL SELECT doc, 'ERROR', 'schema', '''label'' is a required property', 'samples.' || i FROM en WHERE seq % 11 = 0
  UNION ALL SELECT doc, 'ERROR', 'schema', '''negative'' is not one of [''positive'', ''neutral'']', 'samples.' || i || '.label' FROM en WHERE seq % 11 <> 0 AND label = 'negative'
  UNION ALL SELECT doc, 'ERROR', 'schema', '0.' || seq % 10 || ' is greater than the maximum of 0.5', 'samples.' || i || '.meta.score' FROM en WHERE seq % 10 > 5
  UNION ALL SELECT doc, 'ERROR', 'schema', '[1,2] is too long', 'samples.' || i || '.meta.deep.1' FROM en WHERE seq % 6 = 0)"""
SHORT_SQL = "ss AS (SELECT doc, 'ERROR' AS severity, 'schema' AS category, ' is too short' AS message, 'samples' AS location FROM en GROUP BY doc HAVING count(*) < 2)"
ORACLES = {
    "document_times": f"WITH {DOCS_SQL}, {TIMES_SQL} SELECT doc, path, us, 'samples' AS parent, index FROM tm",
    "document_time_issues": f"WITH {DOCS_SQL}, {TIMES_SQL}, {_late(False)} SELECT * FROM ti",
    "document_time_issues_strict": f"WITH {DOCS_SQL}, {TIMES_SQL}, {_late(True)} SELECT * FROM ti",
    "document_media_issues": f"WITH {DOCS_SQL}, {MEDIA_SQL} SELECT * FROM mi",
    "document_schema_issues": f"WITH {DOCS_SQL}, {SCHEMA_SQL}, {SHORT_SQL} SELECT * FROM si UNION ALL SELECT * FROM ss",
    "document_reports": f"""WITH {DOCS_SQL}, {TIMES_SQL}, {_late(False)}, {MEDIA_SQL}, {SCHEMA_SQL}, {SHORT_SQL}, a AS (SELECT doc, severity FROM ti UNION ALL SELECT doc, severity FROM mi UNION ALL SELECT doc, severity FROM si UNION ALL SELECT doc, severity FROM ss)
SELECT doc, count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings, count(*) FILTER (WHERE severity = 'INFO') AS infos, count(*) FILTER (WHERE severity = 'ERROR') = 0 AS valid
FROM (SELECT doc, NULL AS severity FROM en UNION ALL SELECT * FROM a) GROUP BY doc""",
}
