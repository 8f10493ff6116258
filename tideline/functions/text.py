"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that speak for a sentiment.
LEXICON = {
    "positive": (
        "happy", "joy", "amazing", "good", "great", "love", "lighter", "grateful",
        "laughs", "better", "wonderful", "beautiful", "fantastic", "awesome",
        "goodvibes", "coffeetime", "smile", "excited", "delighted", "bright",
        "cheerful", "warm", "fun", "enjoy", "glad", "pleased", "incredible",
    ),
    "negative": (
        "sad", "heavy", "overwhelmed", "bad", "terrible", "awful", "depressed",
        "anxious", "worry", "hurt", "pain", "cry", "mentalhealth", "struggle",
        "fear", "angry", "disgust", "grief", "lonely", "stressed", "exhausted",
    ),
    "neutral": (
        "daily", "routine", "normal", "regular", "usual", "commute", "grind",
        "moving", "forward", "keepgoing", "nothing", "special", "walk", "working",
        "day", "getting", "putting", "foot", "front",
    ),
}
#: Seven emotions in three classes.
ROLL_UP = {"joy": "positive", "surprise": "positive", "neutral": "neutral", "anger": "negative", "disgust": "negative", "fear": "negative", "sadness": "negative"}
#: What counts as emoji, and white space and word characters beyond ASCII.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}\x{200D}\x{FE0F}]+"
SPACES = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def mask_tweet_tokens(text: Column) -> Column:
    """``@name`` becomes ``@user`` and a link ``http``, token by token between single spaces."""
    mask = lambda t: F.when(F.startswith(t, F.lit("@")) & (F.length(t) > 1), "@user").when(F.startswith(t, F.lit("http")), "http").otherwise(t)
    return F.array_join(F.transform(F.split(text, " ", -1), mask), " ")


def clean_text(text: Column) -> Column:
    """Emoji become a space, tags lose their mark, white space is single spaces."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), EMOJI, " "), r"#([\p{L}\p{N}_]+)", "$1")
    return F.trim(F.regexp_replace(plain, SPACES, " "))


def normalise(text: Column) -> Column:
    """Lower case, single spaces, only a-z, 0-9 and spaces."""
    spaced = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"[ \t\n\r]+", " ")
    return F.trim(F.regexp_replace(spaced, "[^a-z0-9 ]", ""))


def normalise_sql(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim(lower(coalesce({text}, ''))), '[ \\t\\n\\r]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'))"


#: Marks that end a word.
MARKS = "[#.,!?'\"]"


def once(value: Column, f) -> Column:
    """``f`` of a value that is worked out once a row, however often ``f`` uses it: a column used several times is written
    out as often, and not all of its uses are found to be the same."""
    return F.transform(F.array(value), f)[0]


def lexicon_sentiment(text: Column, lexicon: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Shares of distinct lexicon words as a struct (positive, negative, neutral), four decimals; without any
    hit .33, .33 and .34."""
    lexicon = lexicon or LEXICON
    words = F.array_distinct(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), MARKS, " "), SPACES))
    hits = once(words, lambda w: F.struct(*(F.size(F.array_intersect(w, F.array(*map(F.lit, v)))).alias(k) for k, v in lexicon.items())))
    none = {"positive": 0.33, "negative": 0.33, "neutral": 0.34}

    def shares(h):
        total = h["positive"] + h["negative"] + h["neutral"]
        return F.struct(*(F.when(total == 0, none[k]).otherwise(F.round(h[k] / total, 4)).alias(k) for k in ("positive", "negative", "neutral")))

    return once(hits, shares)


def sentiment_record(scores: Column) -> Column:
    """Dominant class (positive, negative, neutral on ties), its share and an uncertainty of at most .2."""
    top = F.greatest(scores["positive"], scores["negative"], scores["neutral"])
    label = F.when(scores["positive"] == top, "positive").when(scores["negative"] == top, "negative").otherwise("neutral")
    return F.struct(label.alias("label"), top.alias("score"), F.round(F.least(F.lit(0.2), 0.05 + 0.15 * (1 - top)), 4).alias("uncertainty"))


def image_record(scores: Column) -> Column:
    """Uncertainty and note of an image estimate (positive, neutral, negative) from the confidence of its best class."""
    top = F.greatest(scores["positive"], scores["neutral"], scores["negative"])
    best = F.when(scores["positive"] == top, "positive").when(scores["neutral"] == top, "neutral").otherwise("negative")
    share = F.format_string("%.1f%%", top.cast("double") * 100)
    note = F.when(top > 0.5, F.concat(F.lit("Strong "), best, F.lit(" expression detected ("), share, F.lit(" confidence)."))).when(top > 0.3, F.concat(F.lit("Moderate "), best, F.lit(" expression detected ("), share, F.lit(" confidence)."))).otherwise(F.concat(F.lit("Weak facial expression. "), best, F.lit(" is most likely ("), share, F.lit(").")))
    return F.struct(F.round(F.least(F.lit(0.25), 0.05 + 0.2 * (1 - top)), 4).alias("uncertainty"), note.alias("note"))


def roll_up(label: Column) -> Column:
    out = F.lit("neutral")
    for kind, group in ROLL_UP.items():
        out = F.when(F.lower(label) == kind, group).otherwise(out)
    return out


def first_existing(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """The first of ``candidates`` among ``columns``."""
    return next((c for c in candidates if c in columns), None)


#: Names of a text and of a label, the likeliest first.
TEXT_NAMES = ("CAPTIONS", "caption", "captions", "text", "sentence", "content")
LABEL_NAMES = ("labels", "label", "category", "class", "target")


def top_result(results: Column) -> Column:
    """The entry (label, score) with the highest score, the first of equal ones, of an array, or of the first array of an
    array of arrays; a missing score is 0. Uncategorized and 0 without any."""
    none = F.struct(F.lit("Uncategorized").alias("label"), F.lit(0.0).alias("score"))
    score = lambda e: F.coalesce(e["score"], F.lit(0.0))
    place = lambda e, i: F.struct(score(e).alias("s"), (-i).alias("i"), F.struct(e["label"].alias("label"), score(e).alias("score")).alias("e"))
    return F.coalesce(F.array_max(F.transform(results, place))["e"], none)


def first_list(results: Column) -> Column:
    """The first array of an array of arrays."""
    return F.get(results, F.lit(0))


def softmax(values: Column) -> Column:
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == index, 1).otherwise(0))


def scale_pixels(values: Column, centred: bool = True) -> Column:
    """x / 255, and (x - .5) * 2 if centred."""
    return F.transform(values, lambda x: (x / 255.0 - 0.5) * 2.0 if centred else x / 255.0)


def box_with_offsets(x: Column, y: Column, w: Column, h: Column, ox: int, oy: int) -> Column:
    """Bounds of a box (x, y, width, height) grown by offsets."""
    return F.struct((x - ox).alias("x1"), (x + w + ox).alias("x2"), (y - oy).alias("y1"), (y + h + oy).alias("y2"))


def image_score(score: Column) -> Column:
    """Scores above 1 are percentages; the result is within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(score > 1, score / 100.0).otherwise(score)))


def visibility(score: Column) -> Column:
    """Square root, at least .15, what is above .8 shrunk to three tenths, at most 1; zero stays zero."""
    x = F.greatest(F.sqrt(score), F.lit(0.15))
    return F.when(score == 0, 0.0).otherwise(F.least(F.lit(1.0), F.when(x > 0.8, 0.8 + (x - 0.8) * 0.3).otherwise(x)))


def fenced_json(text: Column) -> Column:
    """The first object, inside a code fence if there is one."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.nullif(inside, F.lit("")), F.nullif(bare, F.lit("")), text)


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    """Parts are numbers, or structs (numerator, denominator); a zero denominator is an error."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(hemisphere.isin("S", "W"), -value).otherwise(value)


def rational(part: Column) -> Column:
    """The value of a struct (numerator, denominator); a zero denominator is an error."""
    return F.when(part["denominator"] == 0, F.raise_error(F.lit("zero denominator"))).otherwise(part["numerator"] / part["denominator"])


def exif_time(text: Column) -> Column:
    """``yyyy:MM:dd HH:mm:ss`` as ISO text without a zone; null for other forms."""
    good = text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$")
    return F.date_format(F.try_to_timestamp(F.when(good, text), F.lit("yyyy:MM:dd HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss")


def gps_time(date: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    """A date ``yyyy:MM:dd`` and a time of day in UTC as ISO text with its zone and, where it isn't zero, a fraction; null if there is no such time."""
    part = F.split(date, ":")
    whole = F.floor(seconds)
    micros = F.floor((seconds - whole) * 1_000_000).cast("int")
    valid = date.rlike(r"^\d{1,4}:\d{1,2}:\d{1,2}$") & hours.between(0, 23) & minutes.between(0, 59) & seconds.between(0, 59.999999)
    made = F.try_make_timestamp(F.get(part, F.lit(0)).cast("int"), F.get(part, F.lit(1)).cast("int"), F.get(part, F.lit(2)).cast("int"), hours.cast("int"), minutes.cast("int"), whole.cast("decimal(16,6)"))
    at = F.date_format(F.when(valid, made), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(at, F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def safe_location(metadata: Column) -> Column:
    """``location.lat`` and ``location.lon`` of JSON metadata as a struct, or null where they are missing, no numbers or out of range."""
    lat, lon = (F.get_json_object(metadata, f"$.location.{c}").try_cast("double") for c in ("lat", "lon"))
    return F.when(F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)), F.struct(lat.alias("lat"), lon.alias("lon")))


def location_text(category: Column, kind: Column, name: Column, lat: Column, lon: Column, address: Column | None = None) -> Column:
    """Words for a geocoded place: category, type where it differs, and its name: the entry of ``address`` (a map) under
    the type, else the first part of ``name``. A place without any is named by its coordinates."""
    empty = lambda c: F.nullif(c, F.lit(""))
    spaced = lambda c: empty(F.replace(c, F.lit("_"), F.lit(" ")))
    first = empty(F.trim(F.split_part(name, F.lit(","), F.lit(1))))
    called = first if address is None else F.coalesce(empty(F.try_element_at(address, empty(kind))), first)
    parts = F.concat_ws(" ", spaced(category), F.when(~F.coalesce(spaced(kind) == spaced(category), F.lit(False)), spaced(kind)), called)
    return F.when(parts == "", F.concat(F.lit("unknown location at coordinates "), lat.cast("string"), F.lit(" "), lon.cast("string"))).otherwise(parts)


#: Scene labels and their categories; other scenes have none.
SCENES = {
    "clinical_or_institutional": ("hospital", "hospital_room", "clinic", "pharmacy", "dentists_office", "operating_room", "waiting_room", "laboratory", "nursing_home"),
    "faith_community": (
        "church/indoor", "church/outdoor", "mosque/indoor", "mosque/outdoor", "temple/east_asia", "temple/south_asia", "synagogue/indoor",
        "chapel", "cathedral/indoor", "cathedral/outdoor", "abbey",
    ),
    "recovery_support": ("community_center", "recreation_room", "conference_room", "meeting_room", "classroom", "lecture_room", "office", "gym/indoor"),
    "residential_or_transitional": (
        "bedroom", "living_room", "house", "apartment_building/outdoor", "kitchen", "dining_room", "bathroom", "home_office", "porch", "yard",
        "balcony/interior", "balcony/exterior", "garage/indoor", "residential_neighborhood",
    ),
    "shelter_or_dropin": ("tent/outdoor", "dormitory", "youth_hostel", "motel", "locker_room", "campsite"),
    "outdoor_or_wilderness": (
        "park", "forest_path", "forest/broadleaf", "forest/needleleaf", "mountain", "mountain_path", "mountain_snowy", "field/cultivated", "field/wild",
        "lake/natural", "river", "ocean", "beach", "creek", "sky", "valley", "snowfield", "glacier", "trail", "swamp", "waterfall",
    ),
}


def scene_category(top: Column, least: float = 0.4) -> Column:
    """Of up to three (scene, score) candidates in order, the first with a category, as a struct (scene_type, confidence).
    Where the first candidate is below ``least`` or none has a category, unknown with the first one's score."""
    table = F.create_map(*(F.lit(x) for kind, scenes in SCENES.items() for scene in scenes for x in (scene, kind)))
    first = F.round(F.get(top, F.lit(0))["score"], 4)
    known = F.get(F.filter(F.slice(top, 1, 3), lambda c: table[c["scene"]].isNotNull()), F.lit(0))
    sure = (first >= least) & known.isNotNull()
    return F.struct(F.when(sure, table[known["scene"]]).otherwise("unknown").alias("scene_type"), F.coalesce(F.when(sure, F.round(known["score"], 4)).otherwise(first), F.lit(0.0)).alias("confidence"))
