"""Positions and times of pictures, read from the EXIF part of JPEG, PNG and TIFF files in Arrow batches."""

from __future__ import annotations

import re
import struct
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags of the format, and bytes of each of its types from 1 on.
GPS_IFD, EXIF_IFD, TAKEN = 0x8825, 0x8769, 0x9003
LAT_REF, LAT, LON_REF, LON, TIME, DATE = 1, 2, 3, 4, 7, 29
WIDTHS = (1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)
FOUND = "path string, lat double, lon double, timestamp string"


def tiff_part(data: bytes) -> bytes | None:
    """The TIFF structure of a picture: of the first Exif segment of a JPEG, of the eXIf chunk of a PNG, or the file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    at = 2
    if data[:2] == b"\xff\xd8":
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
            size = struct.unpack_from(">H", data, at + 2)[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = struct.unpack_from(">I", data, at)[0]
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def entries(tiff: bytes, order: str, at: int) -> dict[int, list]:
    """Values of a directory by tag: bytes, numbers, or (numerator, denominator). Whatever lies outside the data is an
    error; types that aren't known are left out."""
    out = {}
    for i in range(struct.unpack_from(f"{order}H", tiff, at)[0]):
        tag, kind, count = struct.unpack_from(f"{order}HHI", tiff, at + 2 + 12 * i)
        if not 1 <= kind <= len(WIDTHS):
            continue
        size = WIDTHS[kind - 1] * count
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{order}I", tiff, at + 10 + 12 * i)[0]
        if place + size > len(tiff):
            raise ValueError("outside of the data")
        if kind in (1, 2, 6, 7):
            out[tag] = [tiff[place : place + size]]
        elif kind in (5, 10):
            parts = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", tiff, place)
            out[tag] = list(zip(parts[::2], parts[1::2], strict=True))
        else:
            out[tag] = list(struct.unpack_from(f"{order}{count}{ {3: 'H', 4: 'I', 8: 'h', 9: 'i', 11: 'f', 12: 'd'}[kind]}", tiff, place))
    return out


def _number(part) -> float:
    return part[0] / part[1] if isinstance(part, tuple) else float(part)


def _text(values: list | None) -> str:
    return values[0].split(b"\0")[0].decode("ascii", "replace") if values and isinstance(values[0], bytes) else ""


def degrees(parts: list, ref: str, negative: str) -> float:
    """Degrees, minutes and seconds as a number."""
    value = sum(_number(p) / 60**i for i, p in enumerate(parts))
    return -value if ref == negative else value


def gps_time(date: str, parts: list) -> str | None:
    """UTC in ISO 8601; null if it is no time."""
    try:
        year, month, day = map(int, date.split(":"))
        hour, minute, second = (_number(p) for p in parts)
        whole = int(second)
        return datetime(year, month, day, int(hour), int(minute), whole, int((second - whole) * 1_000_000), tzinfo=timezone(timedelta(0))).isoformat()
    except (ValueError, ZeroDivisionError, OverflowError):
        return None


def taken(text: str) -> str | None:
    """The time that a camera wrote, in ISO 8601 without a zone; null if it is no time."""
    try:
        return datetime.strptime(text, "%Y:%m:%d %H:%M:%S").isoformat() if re.fullmatch(r"\d{4}:\d\d:\d\d \d\d:\d\d:\d\d", text) else None
    except ValueError:
        return None


def position(data: bytes | None) -> tuple[float, float, str | None] | None:
    """``(lat, lon, timestamp)`` of a picture; null without a position, and of a file that is broken at one. The time is
    that of the position, else that of the camera."""
    try:
        tiff = tiff_part(data or b"")
        if tiff is None:
            return None
        order = "<" if tiff[:2] == b"II" else ">"
        top = entries(tiff, order, struct.unpack_from(f"{order}I", tiff, 4)[0])
        if GPS_IFD not in top:
            return None
        gps = entries(tiff, order, top[GPS_IFD][0])
        if LAT not in gps or LON not in gps:
            return None
        lat, lon = degrees(gps[LAT], _text(gps.get(LAT_REF)), "S"), degrees(gps[LON], _text(gps.get(LON_REF)), "W")
        at = gps_time(_text(gps[DATE]), gps[TIME]) if DATE in gps and TIME in gps else None
        if at is None:
            at = taken(_text(top.get(TAKEN) or (entries(tiff, order, top[EXIF_IFD][0]).get(TAKEN) if EXIF_IFD in top else None)))
        return lat, lon, at
    except (struct.error, ValueError, ZeroDivisionError, TypeError, IndexError, OverflowError):
        return None


def positions(files: DataFrame) -> DataFrame:
    """``path lat lon timestamp`` of files (``path content``, as ``binaryFile`` reads them) that have a position."""

    def run(batches):
        for batch in batches:
            rows = [(path, *found) for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (found := position(data))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.string()), strict=True)], ["path", "lat", "lon", "timestamp"])

    return files.select("path", "content").mapInArrow(run, FOUND)
