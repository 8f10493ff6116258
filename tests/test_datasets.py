"""Pictures' positions, data sets and files, from files made here."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from tideline.sources import datasets, exif, files


def directory(order, at, rows):
    """A directory at ``at`` and the values that don't fit in it. ``rows`` are (tag, type, count, bytes)."""
    body, extra, place = struct.pack(f"{order}H", len(rows)), b"", at + 2 + 12 * len(rows) + 4
    for tag, kind, count, data in rows:
        body += struct.pack(f"{order}HHI", tag, kind, count)
        if len(data) <= 4:
            body += data.ljust(4, b"\0")
        else:
            body += struct.pack(f"{order}I", place + len(extra))
            extra += data
    return body + b"\0\0\0\0" + extra


def rationals(order, *parts):
    return b"".join(struct.pack(f"{order}II", *p) for p in parts)


def tiff(order, lat=((51, 1), (30, 1), (3600, 100)), lon=((0, 1), (7, 1), (30, 1)), refs=(b"N\0", b"W\0"), stamp=None, taken=None, sub=False):
    gps = [(1, 2, 2, refs[0]), (2, 5, len(lat), rationals(order, *lat)), (3, 2, 2, refs[1]), (4, 5, 3, rationals(order, *lon))]
    if stamp:
        gps += [(7, 5, 3, rationals(order, *stamp[1])), (29, 2, 11, stamp[0])]
    camera = [(0x9003, 2, 20, taken)] if taken else []
    first = [(0x8825, 4, 1, b"")] + ([(0x8769, 4, 1, b"")] if sub else camera)
    size = len(directory(order, 8, first))
    gps_at = 8 + size
    exif_at = gps_at + len(directory(order, gps_at, gps))
    first[0] = (0x8825, 4, 1, struct.pack(f"{order}I", gps_at))
    if sub:
        first[1] = (0x8769, 4, 1, struct.pack(f"{order}I", exif_at))
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 8)
    return head + directory(order, 8, first) + directory(order, gps_at, gps) + (directory(order, exif_at, camera) if sub else b"")


def jpeg(data):
    other = b"\xff\xe0" + struct.pack(">H", 6) + b"JFIF"
    return b"\xff\xd8" + other + b"\xff\xe1" + struct.pack(">H", len(data) + 8) + b"Exif\0\0" + data + b"\xff\xda rest"


def png(data):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 3) + b"IHDRabc0000" + struct.pack(">I", len(data)) + b"eXIf" + data + b"0000"


STAMP = (b"2023:12:01\0", ((10, 1), (5, 1), (725, 100)))
LAT, LON = 51 + 30 / 60 + 36 / 3600, -(7 / 60 + 30 / 3600)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("wrap", [jpeg, png, bytes])
def test_positions(order, wrap):
    assert exif.position(wrap(tiff(order))) == (pytest.approx(LAT), pytest.approx(LON), None)
    south = exif.position(wrap(tiff(order, refs=(b"S\0", b"E\0"), stamp=STAMP, taken=b"2020:01:02 03:04:05\0")))
    assert south == (pytest.approx(-LAT), pytest.approx(-LON), "2023-12-01T10:05:07.250000+00:00")
    for sub in (False, True):
        assert exif.position(wrap(tiff(order, taken=b"2020:01:02 03:04:05\0", sub=sub)))[2] == "2020-01-02T03:04:05"
    bad = (b"2023:13:01\0", STAMP[1])
    assert exif.position(wrap(tiff(order, stamp=bad, taken=b"2020:01:02 03:04:05\0")))[2] == "2020-01-02T03:04:05"


def test_broken_files_have_no_position():
    whole = jpeg(tiff(">", stamp=STAMP))
    for data in (None, b"", b"text", b"\xff\xd8", jpeg(b""), jpeg(b"MM\0*"), png(b"II*\0\xff\xff\xff\xff"), jpeg(tiff("<", lat=((1, 0), (2, 1), (3, 1))))):
        assert exif.position(data) is None
    for cut in range(len(whole)):
        found = exif.position(whole[:cut])
        assert found is None or found[:2] == (pytest.approx(LAT), pytest.approx(LON))


def test_positions_of_files(spark, tmp_path):
    for name, data in {"a.jpg": jpeg(tiff("<")), "b.png": png(tiff(">", refs=(b"S\0", b"W\0"))), "c.jpg": b"no picture", "d.jpg": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = exif.positions(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert {(r["path"][-5:], round(r["lat"], 6), round(r["lon"], 6)) for r in got} == {("a.jpg", round(LAT, 6), round(LON, 6)), ("b.png", round(-LAT, 6), round(LON, 6))}


def test_faces_of_one_person(spark):
    nan = float("nan")
    rows = [(0, "a", 1.0, 4.0, nan), (1, "b", 0.0, 3.0, nan), (2, "c", nan, 9.0, nan), (3, "d", 1.0, 9.0, 1.0), (4, "e", 0.0, 3.1, None), (5, "a", 0.0, 5.0, nan), (6, "f", 1.0, nan, nan)]
    got = datasets.imdb_faces(spark.createDataFrame(rows, "position int, full_path string, gender double, face_score double, second_face_score double"))
    assert {(r["full_path"], r["gender"], r["label"]) for r in got.collect()} == {("a", 0, "woman"), ("e", 0, "woman")}


def test_faces_by_the_code_in_their_name(spark, tmp_path):
    for name in ("AF01/AF01ANFL.JPG", "AF01/AF01NES.jpg", "AM02/AM02XX.jpg", "AM02/AM02HAS.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {r["code"]: (r["emotion"], r["classes"]) for r in datasets.kdef_files(spark, str(tmp_path)).collect()}
    assert got == {"AN": (0, [1, 0, 0, 0, 0, 0, 0]), "NE": (6, [0, 0, 0, 0, 0, 0, 1]), "XX": (None, [0] * 7)}


def test_class_names(spark):
    row = spark.range(1).select(datasets.class_name("fer2013", F.lit(3)).alias("a"), datasets.class_name("imdb", F.lit(2)).alias("b"), datasets.class_name("imdb", F.lit(-1)).alias("c"), datasets.class_id("fer2013", F.lit("neutral")).alias("d")).first()
    assert tuple(row) == ("happy", None, None, 6)
    with pytest.raises(ValueError, match="data set"):
        datasets.class_id("other", F.lit("x"))


def test_lines_cut_at_the_last_comma(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('text, mood \nplain, Hope\n\n  \na, b, c ,"Meaning"\n"he said ""no"", twice" , Identity\nno comma\n"open,None\n,x\n')
    rows = datasets.last_comma_rows(spark, str(path)).collect()
    assert [(r["text"], r["label"]) for r in rows if not r["malformed"]] == [("plain", "Hope"), ("a, b, c", '"Meaning"'), ('he said "no", twice', "Identity"), ('"open', "None"), ("", "x")]
    assert sum(r["malformed"] for r in rows) == 1 and datasets.label_name(spark, str(path)) == "mood"


def test_posts_from_csv(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text('user_id,image_path,caption,timestamp\nu,a.jpg,"one\ntwo, three",2024-01-02T03:04:05\nv,b.jpg,x,never\n,c.jpg,y,\nw,d.jpg,,2024-01-01\n')
    posts, rejected = files.posts_from_csv(spark, str(path))
    assert [(r["user_id"], r["caption"], r["ts"] and r["ts"].isoformat()) for r in posts.collect()] == [("u", "one\ntwo, three", "2024-01-02T03:04:05"), ("v", "x", None)]
    assert [r["image_path"] for r in rejected.collect()] == ["c.jpg", "d.jpg"]
    (tmp_path / "short.csv").write_text("user_id,caption\na,b\n")
    with pytest.raises(ValueError, match="image_path"):
        files.posts_from_csv(spark, str(tmp_path / "short.csv"))


def test_photos_and_objects_with_a_tail(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"subject": "bob",\n "photos": [{"filename": "a.png", "category": "happy", "description": "d"}, {"filename": "b.png"}]}')
    assert [tuple(r) for r in files.photo_list(spark, str(tmp_path / "p.json")).collect()] == [("bob", "a.png", "happy", "d"), ("bob", "b.png", None, None)]
    (tmp_path / "t.json").write_text('{"a": 1,\n"b": {"c": "x"}}\n""\n')
    assert [tuple(r) for r in files.json_with_tail(spark, str(tmp_path / "t.json"), "a int, b struct<c:string>").collect()] == [(1, ("x",))]


def test_sample_folders(spark, tmp_path):
    for name in ("p1/s1/clip-1.txt", "p1/s1/transcript-a.txt", "p1/s1/clip.wav", "p1/s1/pic.jpeg", "p1/s2/clip-2.txt", "p1/s2/description-x.txt", "p2/s1/other.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {(r["person"], r["sample"]): tuple(v and v.rsplit("/", 1)[1] for v in (r["text"], r["description"], r["image"], r["audio"])) for r in files.sample_files(spark, str(tmp_path)).collect()}
    assert got == {("p1", "s1"): ("transcript-a.txt", None, "pic.jpeg", "clip.wav"), ("p1", "s2"): ("clip-2.txt", "description-x.txt", None, None), ("p2", "s1"): (None, None, None, None)}


def test_pixels_digests_and_results(spark, tmp_path):
    import hashlib

    df = spark.createDataFrame([("1 2 255",)], "pixels string")
    assert files.pixels(df).first()["pixels"] == [1, 2, 255]
    (tmp_path / "m.bin").write_bytes(b"model")
    good, bad = (files.verified(spark, str(tmp_path / "m.bin"), d).first()["ok"] for d in (hashlib.sha256(b"model").hexdigest(), "0" * 64))
    assert good and not bad
    files.write_results(df, f"{tmp_path}/out", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").first()["pixels"] == "1 2 255"
    files.write_results(df, f"{tmp_path}/out.parquet")
    assert spark.read.parquet(f"{tmp_path}/out.parquet").count() == 1
