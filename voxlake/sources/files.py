"""Image files: NIfTI-1 and -2, the attribute-list format with big-endian blocks ("V-data 2"), PNM and a plain DICOM reader.

Files are read whole as rows (``binaryFile``) and decoded by the executors; gzip is undone on the way.
Volumes come out as rows (path, t, b, r, c, value) without zeros; NaN and infinities are 0.
"""

from __future__ import annotations

import gzip
import math
import re
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, t int, b int, r int, c int, value double"


def unpack(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def clean(a: np.ndarray) -> np.ndarray:
    a = a.astype(float)
    return np.where(np.isfinite(a), a, 0.0)


# -- NIfTI -----------------------------------------------------------------------------------------

#: Data type codes of the format.
NIFTI_TYPES = {1: "?", 2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def read_nifti(data: bytes) -> tuple[np.ndarray, dict]:
    """(values [t, band, row, column], header) of either version and byte order."""
    data = unpack(data)
    for order in "<>":
        size = struct.unpack_from(order + "i", data)[0]
        if size in (348, 540):
            break
    else:
        raise ValueError("not a NIfTI file")
    if size == 348:
        dim = struct.unpack_from(order + "8h", data, 40)
        kind, pixdim = struct.unpack_from(order + "h", data, 70)[0], struct.unpack_from(order + "8f", data, 76)
        offset, slope, inter = (struct.unpack_from(order + "f", data, k)[0] for k in (108, 112, 116))
        units = data[123]
        qcode, scode = struct.unpack_from(order + "2h", data, 252)
        quatern, srow = struct.unpack_from(order + "6f", data, 256), struct.unpack_from(order + "12f", data, 280)
    else:
        dim = struct.unpack_from(order + "8q", data, 16)
        kind, pixdim = struct.unpack_from(order + "h", data, 12)[0], struct.unpack_from(order + "8d", data, 104)
        offset = struct.unpack_from(order + "q", data, 168)[0]
        slope, inter = struct.unpack_from(order + "2d", data, 176)
        units = struct.unpack_from(order + "i", data, 500)[0]
        qcode, scode = struct.unpack_from(order + "2i", data, 344)
        quatern, srow = struct.unpack_from(order + "6d", data, 352), struct.unpack_from(order + "12d", data, 400)
    nx, ny, nz, nt = (max(int(dim[k]), 1) if k <= dim[0] else 1 for k in (1, 2, 3, 4))
    a = np.frombuffer(data, np.dtype(NIFTI_TYPES[kind]).newbyteorder(order), nx * ny * nz * nt, int(offset)).reshape(nt, nz, ny, nx)
    a = clean(a)
    if slope not in (0.0, 1.0) or inter:
        a = a * (slope or 1.0) + inter
    tr = float(pixdim[4]) * (1000 if units & 0x38 == 8 else 1) if dim[0] >= 4 else 0.0
    return a, {"dim": list(map(int, dim)), "pixdim": list(map(float, pixdim)), "tr_ms": tr, "qform_code": qcode, "sform_code": scode, "quatern": list(quatern), "srow": list(srow), "datatype": kind}


def write_nifti(a: np.ndarray, pixdim: Iterable[float] = (1, 1, 1), tr_ms: float = 0.0, kind: str = "f4", srow: Iterable[float] = ()) -> bytes:
    """Values [band, row, column] or [t, band, row, column] as NIfTI-1."""
    a = np.asarray(a)
    four = a.ndim == 4
    shape = a.shape[::-1]
    code = {v: k for k, v in NIFTI_TYPES.items()}[kind]
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, 4 if four else 3, *shape[:3], shape[3] if four else 1, 1, 1, 1)
    struct.pack_into("<hh", h, 70, code, np.dtype(kind).itemsize * 8)
    struct.pack_into("<8f", h, 76, 1, *list(pixdim)[:3], tr_ms / 1000, 0, 0, 0)
    struct.pack_into("<3f", h, 108, 352, 1, 0)
    h[123] = 2 | 8
    if srow := list(srow):
        struct.pack_into("<2h", h, 252, 0, 1)
        struct.pack_into("<12f", h, 280, *srow)
    h[344:348] = b"n+1\0"
    return bytes(h) + a.astype("<" + kind).tobytes()


# -- attribute lists with blocks -------------------------------------------------------------------

#: Pixel types by name, big-endian; bits are packed, first bit highest.
V_TYPES = {"bit": None, "ubyte": "u1", "sbyte": "i1", "short": ">i2", "ushort": ">u2", "integer": ">i4", "uinteger": ">u4", "long": ">i8", "ulong": ">u8", "float": ">f4", "double": ">f8"}
_TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[{}:]|[^\s{}:"]+)')


def read_attributes(text: str) -> list:
    """[(name, value)], where a value is a string, a list, or (type, list)."""
    tokens, at = _TOKEN.findall(text), 0

    def word(t: str) -> str:
        return re.sub(r"\\(.)", r"\1", t[1:-1]) if t.startswith('"') else t

    def body() -> list:
        nonlocal at
        at += 1  # {
        out = []
        while at < len(tokens) and tokens[at] != "}":
            name, at = tokens[at], at + 2  # name and :
            if tokens[at] == "{":
                out.append((name, body()))
            elif at + 1 < len(tokens) and tokens[at + 1] == ":" or tokens[at] == "}":
                out.append((name, ""))
            else:
                value, at = word(tokens[at]), at + 1
                if at < len(tokens) and tokens[at] == "{":
                    out.append((name, (value, body())))
                else:
                    out.append((name, value))
        at += 1
        return out

    return body()


def read_v(data: bytes) -> tuple[list, list[tuple[str, np.ndarray, dict]]]:
    """(attributes, images): each image as (name, values [band, row, column], its own attributes)."""
    data = unpack(data)
    if not data.startswith(b"V-data 2"):
        raise ValueError("not a V-data 2 file")
    cut = data.find(b"\f\n")
    text, blocks = data[8 : cut if cut >= 0 else len(data)].decode("latin-1"), data[cut + 2 :] if cut >= 0 else b""
    listed, images = read_attributes(text), []
    for name, value in listed:
        if isinstance(value, tuple) and value[0] == "image":
            a = dict(value[1])
            shape = tuple(int(a.get(k, 1)) for k in ("nbands", "nrows", "ncolumns"))
            part = blocks[int(a["data"]) : int(a["data"]) + int(a["length"])]
            if a["repn"] == "bit":
                x = np.unpackbits(np.frombuffer(part, np.uint8))[: math.prod(shape)]
            else:
                x = np.frombuffer(part, V_TYPES[a["repn"]])
            images.append((name, clean(x.reshape(shape)), {k: v for k, v in a.items() if k not in ("data", "length", "nbands", "nrows", "ncolumns")}))
    return listed, images


def write_v(images: Iterable[tuple[str, np.ndarray, str, dict]], attributes: dict | None = None) -> bytes:
    """images: (name, values, pixel type, attributes)."""

    def quoted(v) -> str:
        v = str(v)
        return v if re.fullmatch(r"[^\s{}\":]+", v) else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'

    lines, blocks, at = ["V-data 2 {"], [], 0
    lines += [f"\t{k}: {quoted(v)}" for k, v in (attributes or {}).items()]
    for name, a, repn, own in images:
        a = np.asarray(a).reshape((1,) * (3 - np.ndim(a)) + np.shape(a))
        part = np.packbits(a.ravel() > 0).tobytes() if repn == "bit" else a.astype(V_TYPES[repn]).tobytes()
        head = {"data": at, "length": len(part), **({"nbands": a.shape[0]} if a.shape[0] != 1 else {}), "nrows": a.shape[1], "ncolumns": a.shape[2], "repn": repn, **{k: v for k, v in own.items() if k != "repn"}}
        lines += [f"\t{name}: image {{", *(f"\t\t{k}: {quoted(v)}" for k, v in head.items()), "\t}"]
        blocks.append(part)
        at += len(part)
    return ("\n".join([*lines, "}"]) + "\n\f\n").encode("latin-1") + b"".join(blocks)


def v_volumes(data: bytes) -> tuple[np.ndarray, dict]:
    """(values [t, band, row, column], attributes): one image is a volume, or a list of slices whose bands are time steps."""
    _, images = read_v(data)
    if not images:
        return np.zeros((0, 0, 0, 0)), {}
    if len(images) == 1:
        return images[0][1][None], images[0][2]
    return np.stack([a for _, a, _ in images], axis=1), images[0][2]


# -- PNM and plain rasters -------------------------------------------------------------------------


def read_pnm(data: bytes) -> np.ndarray:
    """[band, row, column] of pbm, pgm or ppm, text or binary; colours are bands."""
    head, at = [], 0
    while len(head) < (3 if data[:2] in (b"P1", b"P4") else 4):
        m = re.compile(rb"\s*(#[^\n]*\n|\S+)").match(data, at)
        at = m.end()
        if not m[1].startswith(b"#"):
            head.append(m[1])
    kind, w, h = head[0], int(head[1]), int(head[2])
    n = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        x = np.array(list(body.replace(b" ", b"").replace(b"\n", b""))) - 48 if kind == b"P1" else np.array(body.split(), int)
    elif kind == b"P4":
        x = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1), axis=1)[:, :w].ravel()
    else:
        x = np.frombuffer(data, "u1" if int(head[3]) < 256 else ">u2", w * h * n, at + 1)
    return np.moveaxis(np.asarray(x[: w * h * n]).reshape(h, w, n), 2, 0).astype(float)


def read_plain(data: bytes) -> np.ndarray:
    """[band, row, column] of text: three sizes, then values."""
    x = data.split()
    shape = tuple(map(int, x[:3]))
    return np.array(x[3 : 3 + math.prod(shape)], float).reshape(shape)


# -- DICOM -----------------------------------------------------------------------------------------

_LONG = {b"OB", b"OW", b"OF", b"SQ", b"UN", b"UT", b"OD", b"OL", b"UC", b"UR"}


def read_dicom(data: bytes) -> tuple[np.ndarray, dict]:
    """(values [band, row, column], elements by (group, element)) of uncompressed little-endian files; mosaics become bands."""
    at = 132 if data[128:132] == b"DICM" else 0
    explicit, out = True, {}
    while at + 8 <= len(data):
        group, element = struct.unpack_from("<HH", data, at)
        if group == 2 or explicit:
            vr = data[at + 4 : at + 6]
            if vr in _LONG:
                n, at = struct.unpack_from("<I", data, at + 8)[0], at + 12
            else:
                n, at = struct.unpack_from("<H", data, at + 6)[0], at + 8
        else:
            vr, n, at = b"", struct.unpack_from("<I", data, at + 4)[0], at + 8
        if n == 0xFFFFFFFF:
            end = data.find(b"\xfe\xff\xdd\xe0\0\0\0\0", at)
            at = end + 8 if end >= 0 else len(data)
            continue
        out[group, element] = data[at : at + n]
        at += n
        if (group, element) == (2, 0x10):
            explicit = out[2, 0x10].rstrip(b"\0 ") != b"1.2.840.10008.1.2"
    number = lambda k: struct.unpack("<H", out[k][:2])[0]
    rows, cols = number((0x28, 0x10)), number((0x28, 0x11))
    signed = number((0x28, 0x103)) if (0x28, 0x103) in out else 0
    kind = f"<{'i' if signed else 'u'}{number((0x28, 0x100)) // 8}"
    a = np.frombuffer(out[0x7FE0, 0x10], kind, rows * cols * (len(out[0x7FE0, 0x10]) // (rows * cols * np.dtype(kind).itemsize))).reshape(-1, rows, cols).astype(float)
    text = lambda k: out.get(k, b"").decode("latin-1").strip(" \0")
    if (0x28, 0x1053) in out:
        a = a * float(text((0x28, 0x1053)) or 1) + float(text((0x28, 0x1052)) or 0)
    if "MOSAIC" in text((8, 8)) and len(a) == 1:
        a = unpack_mosaic(a[0], int(number((0x19, 0x100A))) if (0x19, 0x100A) in out else None)
    return a, out


def unpack_mosaic(a: np.ndarray, slices: int | None = None) -> np.ndarray:
    """Tiles of a square mosaic as bands; without a number of slices, empty tiles at the end are dropped."""
    side = math.ceil(math.sqrt(slices)) if slices else next(k for k in range(int(a.shape[0] ** 0.5), 0, -1) if a.shape[0] % k == 0 and a.shape[1] % k == 0)
    h, w = a.shape[0] // side, a.shape[1] // side
    tiles = a.reshape(side, h, side, w).transpose(0, 2, 1, 3).reshape(-1, h, w)
    if slices:
        return tiles[:slices]
    full = np.flatnonzero(tiles.any(axis=(1, 2)))
    return tiles[: full[-1] + 1] if len(full) else tiles[:0]


# -- DataFrames ------------------------------------------------------------------------------------


def decode(name: str, data: bytes) -> np.ndarray:
    """[t, band, row, column] by the file's name."""
    stem = name.lower().removesuffix(".gz")
    if stem.endswith(".nii"):
        return read_nifti(data)[0]
    if stem.endswith(".v"):
        return v_volumes(data)[0]
    if stem.endswith((".pbm", ".pgm", ".ppm", ".pnm")):
        return read_pnm(unpack(data))[None]
    if stem.endswith((".dcm", ".ima")):
        return read_dicom(unpack(data))[0][None]
    if stem.endswith(".txt"):
        return read_plain(unpack(data))[None]
    raise ValueError(f"unknown kind of file: {name}")


def read_volumes(spark: SparkSession, path: str, f: Callable[[str, bytes], np.ndarray] = decode) -> DataFrame:
    """Rows of all files of a path (glob or folder); a file is read by one task and given out step by step."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf.path, pdf.content):
                for t, a in enumerate(f(name, bytes(data))):
                    b, r, c = np.nonzero(a)
                    yield pd.DataFrame({"path": name, "t": np.int32(t), "b": b.astype(np.int32), "r": r.astype(np.int32), "c": c.astype(np.int32), "value": a[b, r, c]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def encode_volumes(volumes: DataFrame, shape: tuple[int, int, int], kind: str = "nii", keys: str = "path", pixdim=(1, 1, 1), tr_ms: float = 0.0) -> DataFrame:
    """(key, content): each key's rows (t, b, r, c, value) as the bytes of one file."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf.t.max()) + 1 if len(pdf) else 1, *shape))
        a[pdf.t.to_numpy(), pdf.b.to_numpy(), pdf.r.to_numpy(), pdf.c.to_numpy()] = pdf.value.to_numpy()
        if kind == "nii":
            data = write_nifti(a if len(a) > 1 else a[0], pixdim, tr_ms)
        elif len(a) == 1:
            data = write_v([("image", a[0], "float", {})])
        else:
            data = write_v([("image", a[:, b], "float", {"repetition_time": tr_ms}) for b in range(shape[0])])
        return pd.DataFrame({keys: [key[0]], "content": [data]})

    return volumes.groupBy(keys).applyInPandas(run, f"{keys} string, content binary")
