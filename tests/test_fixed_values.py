"""Literal expectations for values that are fixed by definition."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import integrity, places


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "want"), [("church", "church", 1.0), ("Hospital ", "clinic", 0.5), ("temple", "church", 0.5), ("cafe", "restaurant", 0.5), ("park", "garden", 0.0), ("church", "restaurant", 0.0), ("", "", 0.0), (None, "church", 0.0)])
def test_categorical(spark, a, b, want):
    assert one(spark, places.categorical(F.lit(a).cast("string"), F.lit(b).cast("string"))) == want


def strings(*values):
    return F.array(*map(F.lit, values)).cast("array<string>")


@pytest.mark.parametrize(("a", "b", "want"), [(("european", "catholic"), ("european", "traditional"), 1 / 3), (("A ", "b"), ("a", "B"), 1.0), (("a",), ("b",), 0.0), ((), (), 1.0), (("a",), (), 0.0)])
def test_cultural(spark, a, b, want):
    assert one(spark, places.cultural(strings(*a), strings(*b))) == pytest.approx(want)


def test_composite_weights(spark):
    parts = [F.lit(x) for x in (0.5, 1.0, 0.0, 1 / 3)]
    assert one(spark, places.composite(*parts)) == pytest.approx(0.3 * 0.5 + 0.4 + 0.15 / 3)
    merged = (0.6 * 0.5 + 0.4 + 0.15 / 3) / 1.3
    assert one(spark, places.composite(*parts, {"geographic": 0.6})) == pytest.approx(merged)
    assert one(spark, places.composite(*parts, dict.fromkeys(places.WEIGHTS, 0.0))) == 0.0


def test_lexicon(spark):
    got = lambda t: tuple(one(spark, T.lexicon_sentiment(F.lit(t))))
    assert got("So HAPPY, happy! a great 'day' #goodvibes") == (0.75, 0.0, 0.25)
    assert got("good-day nothings") == (0.33, 0.33, 0.34)
    assert got("overwhelmed by the daily\ngrind") == (0.0, 0.3333, 0.6667)


def test_clean_text(spark):
    assert one(spark, T.clean_text(F.lit("hi😀there #Sunny_day‍\t ok ❤️"))) == "hi there Sunny_day ok"


@pytest.mark.parametrize(("score", "shown"), [(0.0, 0.0), (0.01, 0.15), (0.25, 0.5), (1.0, 0.86)])
def test_visibility(spark, score, shown):
    assert one(spark, T.visibility(F.lit(score))) == pytest.approx(shown)


@pytest.mark.parametrize(("score", "want"), [(0.4, 0.4), (40.0, 0.4), (250.0, 1.0), (-1.0, 0.0)])
def test_image_score(spark, score, want):
    assert one(spark, T.image_score(F.lit(score))) == pytest.approx(want)


@pytest.mark.parametrize(("top", "note"), [(0.5, "Moderate neutral expression detected (50.0% confidence)."), (0.7, "Strong neutral expression detected (70.0% confidence)."), (0.3, "Weak facial expression. positive is most likely (35.0%).")])
def test_image_note(spark, top, note):
    scores = F.struct(F.lit(0.35 if top == 0.3 else 0.1).alias("positive"), F.lit(top).alias("neutral"), F.lit(0.1).alias("negative"))
    want = note if top != 0.3 else "Moderate positive expression detected (35.0% confidence)."
    assert one(spark, T.image_record(scores))["note"] == want


@pytest.mark.parametrize(
    ("labels", "scores", "want"),
    [
        (("church/indoor", "attic", "park"), (0.8, 0.1, 0.05), ("faith_community", 0.8)),
        (("attic", "hospital_room", "park"), (0.5, 0.3, 0.2), ("clinical_or_institutional", 0.3)),
        (("park", "beach", "river"), (0.39, 0.3, 0.2), ("unknown", 0.39)),
        (("attic", "desert", "bank"), (0.9, 0.05, 0.01), ("unknown", 0.9)),
    ],
)
def test_scene_category(spark, labels, scores, want):
    top = F.array(*(F.struct(F.lit(n).alias("scene"), F.lit(s).alias("score")) for n, s in zip(labels, scores, strict=True)))
    assert tuple(one(spark, T.scene_category(top))) == want


def test_scene_table():
    assert {k: len(v) for k, v in T.SCENES.items()} == {"clinical_or_institutional": 9, "faith_community": 11, "recovery_support": 8, "residential_or_transitional": 14, "shelter_or_dropin": 6, "outdoor_or_wilderness": 21}


def words(spark, category, kind, name, address=None):
    pairs = [F.lit(x) for kv in (address or {}).items() for x in kv]
    return one(spark, T.location_text(F.lit(category), F.lit(kind), F.lit(name), F.lit(61.2), F.lit(-149.9), F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")))


def test_location_text(spark):
    assert words(spark, "park", "leisure", "Road, City", {"leisure": "Westchester Lagoon", "road": "Spenard Rd"}) == "park leisure Westchester Lagoon"
    assert words(spark, "residential", "residential", "Some Road, Anchorage, AK, USA") == "residential Some Road"
    assert words(spark, "place_of_worship", "amenity", "St. Mary's , City") == "place of worship amenity St. Mary's"
    assert words(spark, "", "", "") == "unknown location at coordinates 61.2 -149.9"


def test_camera_times(spark):
    assert one(spark, T.exif_time(F.lit("2024:02:29 13:05:09"))) == "2024-02-29T13:05:09"
    assert one(spark, T.exif_time(F.lit("2024-02-29 13:05:09"))) is None and one(spark, T.exif_time(F.lit("2023:02:29 13:05:09"))) is None
    assert one(spark, T.gps_time(F.lit("2024:02:29"), F.lit(13.0), F.lit(5.0), F.lit(9.5))) == "2024-02-29T13:05:09.500000+00:00"
    assert one(spark, T.gps_time(F.lit("2024:02:30"), F.lit(13.0), F.lit(5.0), F.lit(9.0))) is None


def test_a_zero_denominator_is_an_error(spark):
    with pytest.raises(Exception, match="zero denominator"):
        one(spark, T.rational(F.struct(F.lit(1).alias("numerator"), F.lit(0).alias("denominator"))))


@pytest.mark.parametrize(("text", "want"), [('{"location":{"lat":"61.2","lon":-149}}', (61.2, -149.0)), ('{"location":{"lat":91,"lon":0}}', None), ('{"location":"x"}', None), ('{"location":{"lat":"n","lon":1}}', None)])
def test_safe_location(spark, text, want):
    got = one(spark, T.safe_location(F.lit(text)))
    assert (got and tuple(got)) == want


def test_haversine_by_the_arc_sine(spark):
    far = one(spark, places.haversine_asin_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert far == pytest.approx(6371 * math.pi / 2) and one(spark, places.linear_decay(F.lit(5.0))) == 0.75


def test_davies_bouldin(spark):
    """Two clusters of spread 1 whose centres are 10 apart."""
    rows = [(1, 0.0, 1.0), (1, 0.0, -1.0), (2, 10.0, 1.0), (2, 10.0, -1.0), (-1, 99.0, 99.0)]
    assert places.davies_bouldin(spark.createDataFrame(rows, "cluster_id long, x double, y double")).first()[0] == pytest.approx(0.2)


def test_field_names():
    assert set(integrity.TIME_FIELDS) == {"timestamp", "time", "datetime", "created_at", "recorded_at", "date", "ts", "event_time", "capture_time"}
    assert set(integrity.PATH_FIELDS) == {"image", "audio", "video", "media", "image_path", "audio_path", "video_path", "file_path", "img", "sound", "recording"}
