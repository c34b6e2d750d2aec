"""Byte layouts of point-cloud and array files: headers, records, and how they are written."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np

from ocellus.sources.las import las_bytes, las_header, las_records

__all__ = ["las_bytes", "las_header", "las_records"]

PCD_TYPES = {("F", 4): "f4", ("F", 8): "f8", ("I", 1): "i1", ("I", 2): "i2", ("I", 4): "i4", ("I", 8): "i8", ("U", 1): "u1", ("U", 2): "u2", ("U", 4): "u4", ("U", 8): "u8"}


@dataclass
class PcdHeader:
    fields: list[str]
    kinds: list[str]
    counts: list[int]
    points: int
    data: str
    size: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(f, f"<{k}") if c == 1 else (f, f"<{k}", (c,)) for f, k, c in zip(self.fields, self.kinds, self.counts, strict=True)])


def pcd_header(raw: bytes) -> PcdHeader:
    """Lines up to DATA; comments begin with #."""
    said: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in said:
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError("a PCD header without DATA")
        line = raw[at:end].decode("ascii", "replace").strip()
        at = end + 1
        if line and not line.startswith("#"):
            key, *rest = line.split()
            said[key.upper()] = rest
    if said["DATA"][0] not in ("ascii", "binary"):
        raise ValueError(f"PCD data of kind {said['DATA'][0]} cannot be read")
    counts = [int(x) for x in said.get("COUNT", ["1"] * len(said["FIELDS"]))]
    kinds = [PCD_TYPES[(t, int(s))] for t, s in zip(said["TYPE"], said["SIZE"], strict=True)]
    points = int(said["POINTS"][0]) if "POINTS" in said else int(said["WIDTH"][0]) * int(said["HEIGHT"][0])
    return PcdHeader(said["FIELDS"], kinds, counts, points, said["DATA"][0], at)


def pcd_records(raw: bytes) -> tuple[PcdHeader, np.ndarray]:
    h = pcd_header(raw)
    if h.data == "binary":
        return h, np.frombuffer(raw, dtype=h.dtype, count=h.points, offset=h.size)
    out = np.zeros(h.points, dtype=h.dtype)
    for k, line in enumerate(raw[h.size :].decode("ascii").splitlines()[: h.points]):
        parts, at = line.split(), 0
        for f, kind, c in zip(h.fields, h.kinds, h.counts, strict=True):
            own = [float(x) if kind[0] == "f" else int(x) for x in parts[at : at + c]]
            out[f][k] = own[0] if c == 1 else own
            at += c
    return h, out


def with_colours(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """r, g, b (and a) of a packed rgb or rgba of four bytes, beside it."""
    for packed in ("rgba", "rgb"):
        if packed in columns and columns[packed].dtype.itemsize == 4 and columns[packed].ndim == 1:
            bits = np.ascontiguousarray(columns[packed]).view("<u4")
            parts = {"r": 16, "g": 8, "b": 0} | ({"a": 24} if packed == "rgba" else {})
            columns = {**{c: ((bits >> s) & 255).astype("u1") for c, s in parts.items()}, **columns}
    return columns


def pcd_bytes(columns: dict[str, np.ndarray], binary: bool = True) -> bytes:
    """A PCD file; names keep only letters, digits and underscores."""
    names = [re.sub(r"[^A-Za-z0-9_]", "_", c) for c in columns]
    arrays = [np.asarray(a) for a in columns.values()]
    n = len(arrays[0]) if arrays else 0
    kind = {"f": "F", "i": "I", "u": "U"}
    head = "\n".join([
        "# .PCD v0.7", "VERSION 0.7", "FIELDS " + " ".join(names), "SIZE " + " ".join(str(a.dtype.itemsize) for a in arrays), "TYPE " + " ".join(kind[a.dtype.kind] for a in arrays),
        "COUNT " + " ".join("1" for _ in arrays), f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", f"DATA {'binary' if binary else 'ascii'}\n",
    ])
    if binary:
        rows = np.zeros(n, dtype=[(c, a.dtype.newbyteorder("<")) for c, a in zip(names, arrays, strict=True)])
        for c, a in zip(names, arrays, strict=True):
            rows[c] = a
        return head.encode() + rows.tobytes()
    return head.encode() + "".join(" ".join(str(a[k].item()) for a in arrays) + "\n" for k in range(n)).encode()


#: The fields of SDC records, and the versions that add to them.
SDC_FIELDS = [
    ("time", "<f8"), ("range", "<f4"), ("theta", "<f4"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("amplitude", "<u2"), ("width", "<u2"), ("targettype", "u1"), ("target", "u1"),
    ("numtarget", "u1"), ("rgindex", "<u2"), ("channeldesc", "u1"),
]
SDC_LATER = [((5, 2), ("classid", "u1")), ((5, 3), ("rho", "<f4")), ((5, 4), ("reflectance", "<i2"))]


def sdc_dtype(major: int, minor: int) -> np.dtype:
    return np.dtype(SDC_FIELDS + [f for v, f in SDC_LATER if (major, minor) >= v])


def sdc_records(raw: bytes) -> tuple[dict, np.ndarray]:
    size, major, minor = struct.unpack_from("<IHH", raw)
    dtype = sdc_dtype(major, minor)
    return {"major": major, "minor": minor, "header_size": size}, np.frombuffer(raw, dtype=dtype, offset=size, count=(len(raw) - size) // dtype.itemsize)


def sdc_bytes(columns: dict[str, np.ndarray], major: int = 5, minor: int = 4) -> bytes:
    rows = np.zeros(len(columns["x"]), dtype=sdc_dtype(major, minor))
    for f in rows.dtype.names:
        if f in columns:
            rows[f] = columns[f]
    return struct.pack("<IHH", 8, major, minor) + rows.tobytes()


def flow_array(raw: bytes) -> np.ndarray:
    """h, w, 2."""
    if raw[:4] != b"PIEH":
        raise ValueError("not an optical flow file")
    w, h = struct.unpack_from("<ii", raw, 4)
    return np.frombuffer(raw, dtype="<f4", offset=12, count=2 * w * h).reshape(h, w, 2)


def flow_bytes(flow: np.ndarray) -> bytes:
    return b"PIEH" + struct.pack("<ii", flow.shape[1], flow.shape[0]) + np.ascontiguousarray(flow, dtype="<f4").tobytes()


def dense_array(raw: bytes) -> np.ndarray:
    """A line `dtype ndim shape strides`, then the values; strides count values."""
    head, _, body = raw.partition(b"\n")
    kind, ndim, *rest = head.decode("ascii").split()
    shape, strides = [int(x) for x in rest[: int(ndim)]], [int(x) for x in rest[int(ndim) : 2 * int(ndim)]]
    dtype = np.dtype(kind)
    flat = np.frombuffer(body, dtype=dtype)
    return np.lib.stride_tricks.as_strided(flat, shape, [s * dtype.itemsize for s in strides]).copy()


def dense_bytes(array: np.ndarray) -> bytes:
    a = np.ascontiguousarray(array)
    head = [a.dtype.str[1:], str(a.ndim), *map(str, a.shape), *[str(s // a.itemsize) for s in a.strides]]
    return " ".join(head).encode() + b"\n" + a.tobytes()


@dataclass
class Metacloud:
    """Members in order; side files with (kind, name) of their attributes; indices (path, type, name); typed attributes of the whole."""

    members: list[str]
    sides: list[tuple[str, list[tuple[str, str]]]]
    indices: list[tuple[str, str, str]]
    attributes: dict[str, int | float | str]


SECTIONS = ("POINTS_FILES", "EXTRA_ATTRIBUTES", "INDEX_FILES", "METACLOUD_ATTRIBUTES")
#: The kinds of a side file's attributes.
SIDE_KINDS = {"uint8": "u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "int8": "i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "float32": "<f4", "float64": "<f8"}
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|([^\s"#]+)|(#.*)')
_WHOLE = re.compile(r"[+-]?[0-9]+")
_REAL = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


def _tokens(line: str) -> list[tuple[str, bool]]:
    """Words of a line up to a comment, and whether each was in quotes."""
    out = []
    for quoted, bare, comment in _TOKEN.findall(line):
        if comment:
            break
        out.append((bare, False) if bare else (re.sub(r"\\(.)", r"\1", quoted), True))
    return out


def read_metacloud_text(text: str) -> Metacloud:
    """A section's name stands alone on a line; its entries follow up to the next name."""
    out, now = Metacloud([], [], [], {}), None
    for line in text.splitlines():
        words = _tokens(line)
        if not words:
            continue
        said = [w for w, _ in words]
        if len(words) == 1 and not words[0][1] and said[0] in SECTIONS:
            now = said[0]
        elif now == "POINTS_FILES":
            out.members += said
        elif now == "EXTRA_ATTRIBUTES":
            if len(said) < 3 or len(said) % 2 == 0 or any(k not in SIDE_KINDS for k in said[1::2]):
                raise ValueError(f"not a side file: {line}")
            out.sides.append((said[0], list(zip(said[1::2], said[2::2], strict=True))))
        elif now == "INDEX_FILES":
            if len(said) != 3:
                raise ValueError(f"not an index file: {line}")
            out.indices.append((said[0], said[1], said[2]))
        elif now == "METACLOUD_ATTRIBUTES":
            if len(said) != 2:
                raise ValueError(f"not an attribute: {line}")
            bare = not words[1][1]
            out.attributes[said[0]] = int(said[1]) if bare and _WHOLE.fullmatch(said[1]) else float(said[1]) if bare and _REAL.fullmatch(said[1]) else said[1]
        else:
            raise ValueError(f"outside of any section: {line}")
    return out


def metacloud(text: str) -> dict[str, list[str]]:
    """Members by section name."""
    return {"POINTS_FILES": read_metacloud_text(text).members}


def side_records(raw: bytes, attributes: list[tuple[str, str]]) -> np.ndarray:
    """A side file: records of its attributes one after another, without a header."""
    dtype = np.dtype([(name, SIDE_KINDS[kind]) for kind, name in attributes])
    return np.frombuffer(raw, dtype=dtype, count=len(raw) // dtype.itemsize)
