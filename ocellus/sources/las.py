"""LAS files: public header, variable length records, point formats 0 to 10 with extra bytes, both ways."""

from __future__ import annotations

import struct

import numpy as np

#: The fields of the public header block, those that only later versions have apart.
HEADER = [
    ("fileSignature", "S4"), ("fileSourceID", "<u2"), ("globalEncoding", "<u2"), ("projectID_GUID_Data1", "<u4"), ("projectID_GUID_Data2", "<u2"), ("projectID_GUID_Data3", "<u2"),
    ("projectID_GUID_Data4", "u1", 8), ("versionMajor", "u1"), ("versionMinor", "u1"), ("systemIdentifier", "S32"), ("generatingSoftware", "S32"), ("fileCreationDayOfYear", "<u2"),
    ("fileCreationYear", "<u2"), ("headerSize", "<u2"), ("offsetToPointData", "<u4"), ("numberOfVariableLengthRecords", "<u4"), ("pointDataRecordFormat", "u1"),
    ("pointDataRecordLength", "<u2"), ("legacyNumberOfPointRecords", "<u4"), ("legacyNumberOfPointsByReturn", "<u4", 5), ("xScaleFactor", "<f8"), ("yScaleFactor", "<f8"),
    ("zScaleFactor", "<f8"), ("xOffset", "<f8"), ("yOffset", "<f8"), ("zOffset", "<f8"), ("maxX", "<f8"), ("minX", "<f8"), ("maxY", "<f8"), ("minY", "<f8"), ("maxZ", "<f8"), ("minZ", "<f8"),
]
HEADER_13 = [("startOfWaveformDataPacketRecord", "<u8")]
HEADER_14 = [("startOfFirstExtendedVariableLengthRecord", "<u8"), ("numberOfExtendedVariableLengthRecords", "<u4"), ("numberOfPointRecords", "<u8"), ("numberOfPointsByReturn", "<u8", 15)]
_OLD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classes", "u1"), ("scanAngleRank", "i1"), ("userData", "u1"), ("pointSourceID", "<u2")]
_NEW = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("userData", "u1"), ("scanAngle", "<i2"), ("pointSourceID", "<u2"), ("GPSTime", "<f8")]
_TIME, _RGB, _NIR = [("GPSTime", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("NIR", "<u2")]
_WAVE = [("waveDescriptor", "u1"), ("waveOffset", "<u8"), ("waveSize", "<u4"), ("waveReturn", "<f4"), ("waveX", "<f4"), ("waveY", "<f4"), ("waveZ", "<f4")]
#: The fields of point formats 0 to 10.
LAS_FORMATS = {
    0: _OLD, 1: _OLD + _TIME, 2: _OLD + _RGB, 3: _OLD + _TIME + _RGB, 4: _OLD + _TIME + _WAVE, 5: _OLD + _TIME + _RGB + _WAVE,
    6: _NEW, 7: _NEW + _RGB, 8: _NEW + _RGB + _NIR, 9: _NEW + _WAVE, 10: _NEW + _RGB + _NIR + _WAVE,
}
#: Where bits stand (field, first bit, how many), in formats 0 to 5 and in the others.
_OLD_BITS = {
    "returnNumber": ("flags", 0, 3), "numberOfReturns": ("flags", 3, 3), "scanDirection": ("flags", 6, 1), "edge": ("flags", 7, 1), "classification": ("classes", 0, 5),
    "synthetic": ("classes", 5, 1), "keyPoint": ("classes", 6, 1), "withheld": ("classes", 7, 1),
}
_NEW_BITS = {
    "returnNumber": ("returns", 0, 4), "numberOfReturns": ("returns", 4, 4), "synthetic": ("flags", 0, 1), "keyPoint": ("flags", 1, 1), "withheld": ("flags", 2, 1), "overlap": ("flags", 3, 1),
    "scannerChannel": ("flags", 4, 2), "scanDirection": ("flags", 6, 1), "edge": ("flags", 7, 1),
}
_PACKED = ("X", "Y", "Z", "flags", "returns", "classes")
NO_POSITION = 2147483647
#: Kinds of extra bytes by number; any other number is bytes as they stand.
EXTRA_KINDS = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
_SPEC, _EXTRA_RECORD, _DESCRIPTOR = "LASF_Spec", 4, 192


def public_header(raw: bytes) -> dict:
    """All values of the public header block, by name."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    raw = raw[:375]
    size = struct.unpack_from("<H", raw, 94)[0]
    late = (raw[24], raw[25]) >= (1, 4)
    fields = HEADER + HEADER_13 * (size >= 235) + HEADER_14 * late
    row = np.frombuffer(raw, dtype=np.dtype(fields), count=1)[0]
    out = {}
    for name in row.dtype.names:
        v = row[name]
        out[name] = v.decode("latin-1") if isinstance(v, bytes) else v.tolist()
    if not late:
        legacy = out["legacyNumberOfPointsByReturn"]
        out |= {"startOfFirstExtendedVariableLengthRecord": 0, "numberOfExtendedVariableLengthRecords": 0, "numberOfPointRecords": out["legacyNumberOfPointRecords"], "numberOfPointsByReturn": legacy + [0] * 10}
    return out


def las_header(raw: bytes) -> dict:
    """What reading points takes of the header."""
    h = public_header(raw)
    return {
        "major": h["versionMajor"], "minor": h["versionMinor"], "format": h["pointDataRecordFormat"] & 0x3F, "record_size": h["pointDataRecordLength"],
        "points": h["numberOfPointRecords"] or h["legacyNumberOfPointRecords"], "data_at": h["offsetToPointData"], "scale": tuple(h[f"{c}ScaleFactor"] for c in "xyz"), "offset": tuple(h[f"{c}Offset"] for c in "xyz"),
    }


def variable_records(raw: bytes) -> list[dict]:
    """Variable length records and, where the version has them, extended ones: user, record, description, extended, data."""
    h, out = public_header(raw), []
    for at, count, extended in ((h["headerSize"], h["numberOfVariableLengthRecords"], False), (h["startOfFirstExtendedVariableLengthRecord"], h["numberOfExtendedVariableLengthRecords"], True)):
        for _ in range(count):
            head = 60 if extended else 54
            user, record, size = struct.unpack("<16sHQ" if extended else "<16sHH", raw[at + 2 : at + head - 32])
            text = lambda b: b.split(b"\0")[0].decode("latin-1")
            out.append({"user": text(user), "record": record, "description": text(raw[at + head - 32 : at + head]), "extended": extended, "data": raw[at + head : at + head + size]})
            at += head + size
    return out


def extra_fields(raw: bytes) -> list[tuple[str, str]]:
    """Name and kind of each attribute that the extra bytes of a record hold; of two lists of descriptors the extended one counts."""
    said = [v["data"] for v in variable_records(raw) if v["user"] == _SPEC and v["record"] == _EXTRA_RECORD]
    out = []
    for at in range(0, len(said[-1]) // _DESCRIPTOR * _DESCRIPTOR if said else 0, _DESCRIPTOR):
        kind, options = said[-1][at + 2], said[-1][at + 3]
        name = said[-1][at + 4 : at + 36].split(b"\0")[0].decode("latin-1")
        out.append((name, EXTRA_KINDS.get(kind, f"V{options}")))
    return out


def record_type(h: dict, extras: list[tuple[str, str]]) -> tuple[np.dtype, list[str]]:
    """The layout of a record, and the names of its extra attributes; what no descriptor covers is `extraBytes`."""
    own = list(LAS_FORMATS[h["format"]])
    taken = {f for f, _ in own} | {"x", "y", "z", *(_OLD_BITS if h["format"] <= 5 else _NEW_BITS)}
    names = []
    for k, (name, kind) in enumerate(extras):
        name = name or f"extra{k}"
        while name in taken:
            name += "_"
        taken.add(name)
        names.append(name)
        own.append((name, kind))
    left = h["record_size"] - np.dtype(own).itemsize
    if left < 0:
        raise ValueError("records are shorter than their fields")
    if left:
        own.append(("extraBytes", f"V{left}"))
        names.append("extraBytes")
    return np.dtype(own), names


def las_records(raw: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    """Header and columns of a whole file."""
    h = las_header(raw)
    dtype, names = record_type(h, extra_fields(raw))
    return h, las_columns(h, names, np.frombuffer(raw, dtype=dtype, count=h["points"], offset=h["data_at"]))


def las_columns(h: dict, names: list[str], rows: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of records: positions scaled (NaN where there is none), bit fields apart, extra attributes typed, other extra bytes as they are."""
    out = {c: np.where(rows[c.upper()] == NO_POSITION, np.nan, rows[c.upper()] * s + o) for c, s, o in zip("xyz", h["scale"], h["offset"], strict=True)}
    out |= {f: rows[f] for f, _ in LAS_FORMATS[h["format"]] if f not in _PACKED}
    out |= {k: (rows[f] >> s) & ((1 << n) - 1) for k, (f, s, n) in (_OLD_BITS if h["format"] <= 5 else _NEW_BITS).items()}
    return out | {n: rows[n] for n in names}


def suitable_format(names: set[str]) -> int:
    """The least point format that holds these attributes (lower-case names); the old ones where there is a scan angle rank."""
    colour, time, wave, near = "red" in names, "gpstime" in names, "wavedescriptor" in names, "nir" in names
    if "scananglerank" in names:
        return (5 if wave else 3 if time else 2) if colour else (4 if wave and time else 1 if time else 0)
    return (10 if wave and near else 8 if near else 7) if colour else (9 if wave else 6)


def cast(values: np.ndarray, kind: str) -> np.ndarray:
    """Values in a field's kind: whole numbers are cut off at the kind's ends, NaN is 0 there."""
    a, to = np.asarray(values), np.dtype(kind)
    if to.kind in "iu" and a.dtype != to:
        ends = np.iinfo(to)
        if a.dtype.kind == "f":
            a = np.trunc(np.nan_to_num(a))
            return np.where(a >= ends.max, ends.max, np.where(a <= ends.min, ends.min, a)).astype(to)
        return np.clip(a.astype(object), ends.min, ends.max).astype(to)
    return a.astype(to)


def _descriptor(name: str, kind: np.dtype) -> bytes:
    numbers = {np.dtype(k): n for n, k in EXTRA_KINDS.items()}
    out = bytearray(_DESCRIPTOR)
    out[2] = numbers.get(kind, 0)
    out[3] = 0 if out[2] else kind.itemsize
    raw = name.encode("latin-1", "replace")[:31]
    out[4 : 4 + len(raw)] = raw
    return bytes(out)


def _extra(name: str, values: np.ndarray) -> np.ndarray:
    a = np.asarray(values)
    if a.dtype.kind == "b":
        return a.astype("u1")
    if a.dtype.kind in "iuf" and a.dtype.itemsize <= 8:
        return a.astype(a.dtype.newbyteorder("<"))
    if a.dtype.kind == "V":
        return a
    if a.dtype == object and len(a) and all(isinstance(v, (bytes, bytearray)) for v in a):
        size = max(map(len, a))
        return np.array([bytes(v).ljust(size, b"\0") for v in a], dtype=f"V{size}")
    raise ValueError(f"{name} has no kind that extra bytes can hold")


def las_bytes(columns: dict[str, np.ndarray], scale: float = 0.01, offset: tuple[float, float, float] = (0.0, 0.0, 0.0), point_format: int | None = None) -> bytes:
    """A version 1.4 file in the given point format, or the least that holds the attributes; any others become extra bytes with their descriptors."""
    n = len(columns["x"])
    lower = {c.lower(): c for c in columns}
    fmt = suitable_format(set(lower)) if point_format is None else point_format
    fields, bits = LAS_FORMATS[fmt], _OLD_BITS if fmt <= 5 else _NEW_BITS
    own = {"x", "y", "z"} | {f.lower() for f, _ in fields if f not in _PACKED} | {b.lower() for b in bits}
    extras = {c: _extra(c, columns[c]) for low, c in lower.items() if low not in own}
    rows = np.zeros(n, dtype=[*fields, *[(c, a.dtype) for c, a in extras.items()]])
    for c, o in zip("xyz", offset, strict=True):
        v = np.asarray(columns[lower[c]], dtype=float)
        rows[c.upper()] = np.where(np.isnan(v), NO_POSITION, np.round((np.nan_to_num(v) - o) / scale))
    for f, kind in fields:
        if f.lower() in lower and f not in _PACKED:
            rows[f] = cast(columns[lower[f.lower()]], kind)
    for b, (f, shift, width) in bits.items():
        first = 1 if b in ("returnNumber", "numberOfReturns") else 0
        said = np.asarray(columns[lower[b.lower()]]) if b.lower() in lower else np.full(n, first)
        rows[f] |= (cast(np.clip(said, 0, (1 << width) - 1), "u1") << shift).astype("u1")
    for c, a in extras.items():
        rows[c] = a
    vlr = b""
    if extras:
        data = b"".join(_descriptor(c, a.dtype) for c, a in extras.items())
        vlr = struct.pack("<H16sHH32s", 0, _SPEC.encode(), _EXTRA_RECORD, len(data), b"extra bytes") + data
    head = np.zeros(1, dtype=np.dtype(HEADER + HEADER_13 + HEADER_14))
    returns = np.bincount((rows[bits["returnNumber"][0]] & ((1 << bits["returnNumber"][2]) - 1)).astype(int), minlength=16)[1:16]
    said = {
        "fileSignature": b"LASF", "versionMajor": 1, "versionMinor": 4, "headerSize": head.dtype.itemsize, "offsetToPointData": head.dtype.itemsize + len(vlr), "numberOfVariableLengthRecords": int(bool(vlr)),
        "pointDataRecordFormat": fmt, "pointDataRecordLength": rows.dtype.itemsize, "numberOfPointRecords": n, "numberOfPointsByReturn": returns,
    }
    if fmt <= 5 and n < 1 << 32:
        said |= {"legacyNumberOfPointRecords": n, "legacyNumberOfPointsByReturn": returns[:5]}
    for c, o in zip("xyz", offset, strict=True):
        v = np.asarray(columns[lower[c]], dtype=float)
        v = v[~np.isnan(v)]
        said |= {f"{c}ScaleFactor": scale, f"{c}Offset": o, f"max{c.upper()}": v.max() if len(v) else 0.0, f"min{c.upper()}": v.min() if len(v) else 0.0}
    for name, v in said.items():
        head[name] = v
    return head.tobytes() + vlr + rows.tobytes()
