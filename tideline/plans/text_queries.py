"""Queries over texts, duplicates, labels and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import dedupe, evaluation as E
from tideline.sources.adapters import EVENTS_SQL, emotion_events, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def record(spark, sf_dir):
    got = docs(spark, sf_dir).select("doc_id", T.lexicon_sentiment(F.col("text")).alias("s"))
    rec = T.sentiment_record(F.col("s"))
    return got.select("doc_id", "s.positive", "s.negative", "s.neutral", rec["label"].alias("label"), rec["score"].alias("score"), rec["uncertainty"].alias("uncertainty"))


def emotions(spark, sf_dir):
    """Scores of five labels per subject from events, as text scores and as image scores."""
    e = emotion_events(spark, sf_dir)
    label = F.element_at(F.array(*map(F.lit, ("Joy", "fear", "SADNESS", "neutral", "surprise"))), (F.pmod("seq", F.lit(5)) + 1).cast("int"))
    return e.select("subject_id", label.alias("label"), "score", (F.pmod("seq", F.lit(2)) == 0).alias("is_text"))


EMO_SQL = "em AS (SELECT subject_id, ['Joy', 'fear', 'SADNESS', 'neutral', 'surprise'][seq % 5 + 1] AS label, score, seq % 2 = 0 AS is_text FROM ev)"


def alignment(spark, sf_dir):
    """Mean text and image scores per lower-cased label, outer-joined, missing sides 0."""
    e = emotions(spark, sf_dir).withColumn("label", F.lower("label"))
    side = lambda flag, name: e.filter(flag).groupBy("subject_id", "label").agg(F.avg("score").alias(name))
    got = side(F.col("is_text"), "text_score").join(side(~F.col("is_text"), "image_score"), ["subject_id", "label"], "full")
    return got.select("subject_id", "label", *(F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("text_score", "image_score")))


def predicted(spark, sf_dir):
    got = table(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", F.length("text").alias("n")), "doc_id")
    return got.select("doc_id", F.col("quality").alias("label"), F.when((F.col("n") > 200) & (F.col("n") < 6000), 1).otherwise(0).alias("predicted"))


PRED_SQL = "p AS (SELECT doc_id, quality AS label, CASE WHEN length(text) > 200 AND length(text) < 6000 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id))"


def sweep(spark, sf_dir):
    e = emotion_events(spark, sf_dir)
    runs = e.select((F.pmod("seq", F.lit(3)) * 10).alias("dropout"), F.pmod("seq", F.lit(2)).alias("decay"), "score", (F.col("score") * F.col("score")).alias("square"))
    got = E.sweep_summary(runs, ["dropout", "decay"], ["score", "square"])
    return got.select("dropout", "decay", "runs", *(F.round(c, 6).alias(c) for c in ("score_mean", "square_mean", "score_std", "square_std")))


def leaked(spark, sf_dir):
    """The split with every hundredth document put into a second part, and the documents that are in two."""
    rows = split(spark, sf_dir).select("doc_id", "split")
    return E.split_leakage(rows.unionByName(rows.filter("doc_id % 100 = 0").withColumn("split", F.lit("other"))), "doc_id")


def split(spark, sf_dir):
    return E.grouped_split(docs(spark, sf_dir).select("doc_id", "source"), F.col("doc_id"))


def near_pairs(spark, sf_dir):
    """The nearest texts of those with an id divisible by 100, among all."""
    return dedupe.near_duplicate_pairs(docs(spark, sf_dir), "doc_id", "text", F.col("id") % 100 == 0)


def groups(spark, sf_dir):
    return dedupe.duplicate_groups(docs(spark, sf_dir), "doc_id", "text")


def geotexts(spark, sf_dir):
    """Words for the places of customers: their segment as category, their nation as name."""
    c, n = table(spark, sf_dir, "customer"), F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows
    got = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    kind = F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.col("c_mktsegment")).when(F.pmod("c_custkey", F.lit(3)) == 1, "road_side").otherwise("")
    address = F.create_map(F.lit("road_side"), F.concat(F.lit("Road "), F.pmod("c_custkey", F.lit(9)).cast("string")))
    return got.select("c_custkey", T.location_text(F.col("c_mktsegment"), kind, F.concat("n_name", F.lit(" , x")), F.lit(1.5), F.lit(2.5), address).alias("words"))


def image_notes(spark, sf_dir):
    """Notes on three estimates of each event, and the shown score."""
    e = emotion_events(spark, sf_dir)
    p = (F.pmod("seq", F.lit(11)) / 20.0, F.pmod("seq", F.lit(4)) / 10.0)
    rec = T.image_record(F.struct(p[0].alias("positive"), p[1].alias("neutral"), (1 - p[0] - p[1]).alias("negative")))
    return e.select("seq", rec["uncertainty"].alias("uncertainty"), F.split_part(rec["note"], F.lit("("), F.lit(1)).alias("note"), F.round(T.visibility(T.image_score(F.pmod("seq", F.lit(130)).cast("double"))), 6).alias("shown"))


def scenes(spark, sf_dir):
    """Three candidates for each event, of labels with and without a category."""
    names = F.array(*map(F.lit, ("desert", "river", "chapel", "clinic", "attic", "motel")))
    pick = lambda k: F.element_at(names, (F.pmod(F.col("seq") * k, F.lit(6)) + 1).cast("int"))
    score = F.pmod("seq", F.lit(10)) / 10.0
    top = F.array(*(F.struct(pick(k).alias("scene"), (score / k).alias("score")) for k in (1, 2, 5)))
    got = T.scene_category(top)
    return emotion_events(spark, sf_dir).select("seq", got["scene_type"].alias("scene_type"), got["confidence"].alias("confidence"))


def times_and_places(spark, sf_dir):
    """Times as cameras write them, and locations in metadata, made from events."""
    e = emotion_events(spark, sf_dir)
    at = F.timestamp_micros("us")
    lat = F.when(F.pmod("seq", F.lit(4)) == 0, F.lit('"x"')).otherwise(F.pmod("seq", F.lit(120)).cast("string"))
    metadata = F.concat(F.lit('{"location":{"lat":'), lat, F.lit(',"lon":"12.5"}}'))
    exif = F.when(F.pmod("seq", F.lit(5)) == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(at, "yyyy:MM:dd HH:mm:ss"))
    gps = T.gps_time(F.date_format(at, "yyyy:MM:dd"), F.hour(at), F.minute(at), F.second(at) + 0.25)
    dms = T.dms_to_decimal(F.pmod("seq", F.lit(90)), F.lit(30.0), T.rational(F.struct(F.pmod("seq", F.lit(7)).alias("numerator"), F.lit(2).alias("denominator"))), F.when(F.pmod("seq", F.lit(2)) == 0, "S").otherwise("N"))
    return e.select("seq", T.exif_time(exif).alias("exif"), gps.alias("gps"), T.safe_location(metadata)["lat"].alias("lat"), F.round(dms, 6).alias("decimal"))


def corpora(spark, sf_dir):
    """Texts in common, and texts of one language only, as sets."""
    d = docs(spark, sf_dir).select("lang", T.normalise(F.col("text")).alias("t"))
    sets = {k: d.filter(F.col("lang") == k).select("t") for k in ("en", "de")}
    rows = [("both", sets["en"].intersect(sets["de"])), ("en only", sets["en"].subtract(sets["de"]))]
    return rows[0][1].agg(F.lit("both").alias("part"), F.count("*").alias("n")).union(rows[1][1].agg(F.lit("en only"), F.count("*")))


NORM = T.normalise_sql("text")
#: The words once more, so that a slip in the library shows.
WORDS = {
    "positive": "happy joy amazing good great love lighter grateful laughs better wonderful beautiful fantastic awesome goodvibes coffeetime smile excited delighted bright cheerful warm fun enjoy glad pleased incredible",
    "negative": "sad heavy overwhelmed bad terrible awful depressed anxious worry hurt pain cry mentalhealth struggle fear angry disgust grief lonely stressed exhausted",
    "neutral": "daily routine normal regular usual commute grind moving forward keepgoing nothing special walk working day getting putting foot front",
}
_lex = {k: "[" + ", ".join(f"'{w}'" for w in v.split()) + "]" for k, v in WORDS.items()}
_hits = ", ".join(f"len(list_intersect(w, {v})) AS {k}" for k, v in _lex.items())
_tok = "list_transform(string_split(text, ' '), lambda t: CASE WHEN starts_with(t, '@') AND length(t) > 1 THEN '@user' WHEN starts_with(t, 'http') THEN 'http' ELSE t END)"
_u = "(CAST('0x' || substring(md5('42:' || doc_id), 1, 8) AS BIGINT) % 100)"
QUERIES = {
    "mask_tweet_tokens": lambda s, d: docs(s, d).select("doc_id", F.sha2(T.mask_tweet_tokens(F.col("text")), 256).alias("masked_sha256")),
    "clean_text": lambda s, d: docs(s, d).select("doc_id", F.sha2(T.clean_text(F.col("text")), 256).alias("clean_sha256")),
    "normalised_text": lambda s, d: docs(s, d).select("doc_id", F.sha2(T.normalise(F.col("text")), 256).alias("norm_sha256")),
    "lexicon_sentiment": record,
    "emotion_rollup": lambda s, d: emotions(s, d).groupBy("subject_id", T.roll_up(F.col("label")).alias("sentiment")).agg(F.round(F.sum("score"), 6).alias("score")),
    "modal_emotion_alignment": alignment,
    "duplicate_audit": lambda s, d: dedupe.duplicate_audit(docs(s, d)),
    "top_duplicates": lambda s, d: dedupe.top_duplicates(docs(s, d)),
    "near_duplicate_pairs": lambda s, d: near_pairs(s, d).select("lo", "hi", F.round("cosine", 4).alias("cosine")),
    "duplicate_groups": groups,
    "confusion_matrix": lambda s, d: E.confusion_matrix(predicted(s, d)),
    "classification_metrics": lambda s, d: E.classification_metrics(E.confusion_matrix(predicted(s, d))).select(*(F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "precision", "recall"))),
    "label_fractions": lambda s, d: E.label_fractions(docs(s, d), "source", "lang").withColumn("fraction", F.round("fraction", 6)),
    "sweep_summary": sweep,
    "grouped_split": lambda s, d: split(s, d).select("doc_id", "split"),
    "split_leakage_check": lambda s, d: E.split_leakage(split(s, d), "doc_id"),
    "split_leakage_found": leaked,
    "location_texts": geotexts,
    "image_notes": image_notes,
    "scene_categories": scenes,
    "camera_times": times_and_places,
    "text_set_operations": corpora,
    "encoded_labels": lambda s, d: E.encode_labels(docs(s, d).select("doc_id", "lang"), "lang"),
    "word_counts": lambda s, d: docs(s, d).select("lang", F.explode(F.split(T.normalise(F.col("text")), " ")).alias("word")).filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n")),
}
_scene = "['desert', 'river', 'chapel', 'clinic', 'attic', 'motel']"
_kind = lambda x: f"CASE {x} WHEN 'river' THEN 'outdoor_or_wilderness' WHEN 'chapel' THEN 'faith_community' WHEN 'clinic' THEN 'clinical_or_institutional' WHEN 'motel' THEN 'shelter_or_dropin' END"
ORACLES = {
    "location_texts": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' ' || trim(n_name) WHEN 1 THEN c_mktsegment || ' road side Road ' || c_custkey % 9 ELSE c_mktsegment || ' ' || trim(n_name) END AS words FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "image_notes": f"""WITH {EVENTS_SQL}, p AS (SELECT seq, seq % 11 / 20.0::DOUBLE AS a, seq % 4 / 10.0::DOUBLE AS b FROM ev), q AS (SELECT *, 1 - a - b AS c, greatest(a, b, 1 - a - b) AS t FROM p), r AS (SELECT *, CASE WHEN a = t THEN 'positive' WHEN b = t THEN 'neutral' ELSE 'negative' END AS k, CASE WHEN seq % 130 > 1 THEN seq % 130 / 100.0::DOUBLE ELSE seq % 130 END AS v FROM q), w AS (SELECT *, least(v, 1) AS u, greatest(sqrt(least(v, 1)), 0.15::DOUBLE) AS x FROM r)
SELECT seq, round(least(0.25::DOUBLE, 0.05::DOUBLE + 0.2::DOUBLE * (1 - t)), 4) AS uncertainty, CASE WHEN t > 0.5 THEN 'Strong ' || k || ' expression detected ' WHEN t > 0.3 THEN 'Moderate ' || k || ' expression detected ' ELSE 'Weak facial expression. ' || k || ' is most likely ' END AS note, round(CASE WHEN u = 0 THEN 0 WHEN x > 0.8 THEN least(1, 0.8::DOUBLE + (x - 0.8::DOUBLE) * 0.3::DOUBLE) ELSE x END, 6) AS shown FROM w""",
    "scene_categories": f"""WITH {EVENTS_SQL}, s AS (SELECT seq, {_scene}[seq % 6 + 1] AS a, {_scene}[seq * 2 % 6 + 1] AS b, {_scene}[seq * 5 % 6 + 1] AS c, seq % 10 / 10.0::DOUBLE AS p FROM ev), k AS (SELECT *, {_kind('a')} AS ka, {_kind('b')} AS kb, {_kind('c')} AS kc FROM s)
SELECT seq, CASE WHEN p < 0.4 THEN 'unknown' ELSE coalesce(ka, kb, kc, 'unknown') END AS scene_type, round(CASE WHEN p < 0.4 OR ka IS NOT NULL THEN p WHEN kb IS NOT NULL THEN p / 2 WHEN kc IS NOT NULL THEN p / 5 ELSE p END, 4) AS confidence FROM k""",
    "camera_times": f"""WITH {EVENTS_SQL}, t AS (SELECT seq, make_timestamp(us) AS tm FROM ev) SELECT seq, CASE WHEN seq % 5 <> 0 THEN strftime(tm, '%Y-%m-%dT%H:%M:%S') END AS exif, strftime(tm, '%Y-%m-%dT%H:%M:%S') || '.250000+00:00' AS gps,
  CASE WHEN seq % 4 <> 0 AND seq % 120 <= 90 THEN CAST(seq % 120 AS DOUBLE) END AS lat, round(CASE WHEN seq % 2 = 0 THEN -1 ELSE 1 END * (seq % 90 + 0.5::DOUBLE + seq % 7 / 2.0::DOUBLE / 3600), 6) AS decimal FROM t""",
    "text_set_operations": f"WITH n AS (SELECT lang, {NORM} AS t FROM documents), e AS (SELECT t FROM n WHERE lang = 'en'), g AS (SELECT t FROM n WHERE lang = 'de') SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM e INTERSECT SELECT * FROM g) UNION ALL SELECT 'en only', count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM g)",
    "mask_tweet_tokens": f"SELECT doc_id, sha256(array_to_string({_tok}, ' ')) AS masked_sha256 FROM documents",
    "clean_text": f"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '{T.EMOJI}', ' ', 'g'), '#([\\p{{L}}\\p{{N}}_]+)', '\\1', 'g'), '{T.SPACES}', ' ', 'g'))) AS clean_sha256 FROM documents",
    "normalised_text": f"SELECT doc_id, sha256({NORM}) AS norm_sha256 FROM documents",
    "lexicon_sentiment": f"""WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(regexp_replace(lower(text), '[#.,!?''"]', ' ', 'g'), '{T.SPACES}')) AS w FROM documents), h AS (SELECT doc_id, {_hits} FROM w),
s AS (SELECT doc_id, {', '.join(f'CASE WHEN positive + negative + neutral = 0 THEN {v}::DOUBLE ELSE round({k} / (positive + negative + neutral), 4) END AS {k}' for k, v in (('positive', .33), ('negative', .33), ('neutral', .34)))} FROM h), g AS (SELECT *, greatest(positive, negative, neutral) AS score FROM s)
SELECT doc_id, positive, negative, neutral, CASE WHEN positive = score THEN 'positive' WHEN negative = score THEN 'negative' ELSE 'neutral' END AS label, score, round(least(0.2::DOUBLE, 0.05::DOUBLE + 0.15::DOUBLE * (1 - score)), 4) AS uncertainty FROM g""",
    "emotion_rollup": f"WITH {EVENTS_SQL}, {EMO_SQL} SELECT subject_id, CASE WHEN lower(label) IN ('joy', 'surprise') THEN 'positive' WHEN lower(label) IN ('fear', 'sadness') THEN 'negative' ELSE 'neutral' END AS sentiment, round(sum(score), 6) AS score FROM em GROUP BY ALL",
    "modal_emotion_alignment": f"WITH {EVENTS_SQL}, {EMO_SQL}, t AS (SELECT subject_id, lower(label) AS label, avg(score) AS x FROM em WHERE is_text GROUP BY ALL), i AS (SELECT subject_id, lower(label) AS label, avg(score) AS y FROM em WHERE NOT is_text GROUP BY ALL) SELECT subject_id, label, round(coalesce(x, 0), 9) AS text_score, round(coalesce(y, 0), 9) AS image_score FROM t FULL JOIN i USING (subject_id, label)",
    "duplicate_audit": f"WITH e AS (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1), m AS (SELECT count(*) AS n FROM documents GROUP BY {NORM} HAVING count(*) > 1) SELECT (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM e) AS exact_rows, (SELECT count(*) FROM e) AS exact_groups, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM m) AS normalised_rows, (SELECT count(*) FROM m) AS normalised_groups",
    "top_duplicates": f"SELECT sha256(t) AS text_sha256, n FROM (SELECT {NORM} AS t, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, t LIMIT 10)",
    "confusion_matrix": f"WITH {PRED_SQL} SELECT label, predicted, count(*) AS n FROM p GROUP BY ALL",
    "classification_metrics": f"""WITH {PRED_SQL}, c AS (SELECT k, count(*) FILTER (WHERE label = k) AS s, count(*) FILTER (WHERE predicted = k) AS q, count(*) FILTER (WHERE label = k AND predicted = k) AS h FROM p, (VALUES (0), (1)) v(k) GROUP BY k),
d AS (SELECT *, CASE WHEN q > 0 THEN h / q ELSE 0 END AS pr, CASE WHEN s > 0 THEN h / s ELSE 0 END AS re FROM c), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM d)
SELECT round(sum(h) / sum(s), 6) AS accuracy, round(avg(f), 6) AS macro_f1, round(sum(f * s) / sum(s), 6) AS weighted_f1, round(sum(pr * s) / sum(s), 6) AS precision, round(sum(re * s) / sum(s), 6) AS recall FROM f""",
    "label_fractions": "SELECT source, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS fraction FROM documents GROUP BY source, lang",
    "sweep_summary": f"WITH {EVENTS_SQL} SELECT seq % 3 * 10 AS dropout, seq % 2 AS decay, count(*) AS runs, round(avg(score), 6) AS score_mean, round(avg(score * score), 6) AS square_mean, round(stddev_samp(score), 6) AS score_std, round(stddev_samp(score * score), 6) AS square_std FROM ev GROUP BY ALL",
    "grouped_split": f"SELECT doc_id, CASE WHEN {_u} < 80 THEN 'train' WHEN {_u} < 90 THEN 'validation' ELSE 'test' END AS split FROM documents",
    "split_leakage_found": "SELECT doc_id, CAST(2 AS BIGINT) AS splits FROM documents WHERE doc_id % 100 = 0",
    "split_leakage_check": "SELECT doc_id, count(*) AS splits FROM documents WHERE false GROUP BY doc_id",
    "encoded_labels": "SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS label_id FROM documents",
    "word_counts": f"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split({NORM}, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY ALL",
}
