"""Raw pixels of PDF images to PNG and PPM, and sinks that write images as files."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File extensions of images that keep their own format (K2).
EXTENSIONS = {"DCTDecode": ".jpg", "JPXDecode": ".jp2"}


def cmyk_to_rgb(pixels: np.ndarray) -> np.ndarray:
    """Rows of four inks to three colours."""
    inks = pixels.astype(np.uint16)
    return ((255 - inks[:, :3]) * (255 - inks[:, 3:]) // 255).astype(np.uint8)


def pixels(data: bytes, width: int, height: int, space: str = "", bits: int = 8) -> np.ndarray:
    """The pixels as rows of one or three bytes, channels by the colour space, else by size; what is missing is zero."""
    many = max(width * height, 1)
    if bits in (1, 2, 4) and width > 0:
        line = -(-width * bits // 8)
        raw = np.frombuffer(data[: line * height].ljust(line * height, b"\0"), np.uint8).reshape(height, line)
        unpacked = np.unpackbits(raw, axis=1).reshape(height, -1, bits)
        values = np.packbits(np.concatenate([np.zeros((*unpacked.shape[:2], 8 - bits), np.uint8), unpacked], axis=2), axis=2)[:, :width, 0]
        return (values.reshape(-1, 1).astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    named = {"RGB": 3, "CMYK": 4, "Grayscale": 1}.get(space) or (int(space[9]) if space.startswith("ICCBased(") and space[9:10].isdigit() else 0)
    channels = named or {1: 1, 3: 3, 4: 4}.get(len(data) // many, 3)
    rows = np.frombuffer(data[: many * channels].ljust(many * channels, b"\0"), np.uint8).reshape(-1, channels)
    return cmyk_to_rgb(rows) if channels == 4 else rows


def png(data: bytes, width: int, height: int, space: str = "", bits: int = 8) -> bytes:
    """A PNG file of raw pixels (I4)."""
    rows = pixels(data, width, height, space, bits)
    lines = rows.reshape(max(height, 1), -1)
    body = zlib.compress(np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes())
    chunk = lambda kind, own: struct.pack(">I", len(own)) + kind + own + struct.pack(">I", zlib.crc32(kind + own))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if rows.shape[1] == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def ppm(data: bytes, width: int, height: int, space: str = "", bits: int = 8) -> bytes:
    """A PPM file of raw pixels, PGM where they are grey (K3)."""
    rows = pixels(data, width, height, space, bits)
    return b"P%d\n%d %d\n255\n" % (6 if rows.shape[1] == 3 else 5, width, height) + rows.tobytes()


def encoded(filter: str, data: bytes, width: int, height: int, space: str = "", bits: int = 8) -> tuple[str, bytes]:
    """(extension, bytes) of an image's file: as it is for JPEG and JPEG 2000, else a PNG (K2)."""
    if filter in EXTENSIONS:
        return EXTENSIONS[filter], data
    return ".png", png(data, width, height, space, bits)


def png_column(data: Column, width: Column, height: Column, space: Column, bits: Column) -> Column:
    """``png`` over columns, in Arrow batches."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, width: pd.Series, height: pd.Series, space: pd.Series, bits: pd.Series) -> pd.Series:
        rows = zip(data, width, height, space, bits, strict=True)
        return pd.Series([None if d is None else png(bytes(d), int(w), int(h), s or "", int(b)) for d, w, h, s, b in rows])

    return run(data, width, height, space, bits)


def saved(images: DataFrame, folder: str, ppm_files: bool = False) -> None:
    """Writes the images of ``pdf.elements`` as files of a folder that all executors reach, named by document, page and number (K2, K3)."""

    def write(rows) -> None:
        for r in rows:
            attrs = r["attrs"] or {}
            own = (bytes(r["data"] or b""), int(r["x2"]), int(r["y2"]), attrs.get("color_space", ""), int(attrs.get("bits", 8)))
            raw = r["font"] not in EXTENSIONS
            ending, body = (".ppm", ppm(*own)) if ppm_files and raw else encoded(r["font"], *own)
            path = os.path.join(folder, f"{r['doc_id']}-{r['page'] + 1}-{r['seq'] + 1}{ending}")
            with open(f"{path}.part-{os.getpid()}", "wb") as f:  # a task that runs again leaves whole files
                f.write(body)
            os.replace(f.name, path)

    os.makedirs(folder, exist_ok=True)
    images.where("kind = 'image'").select("doc_id", "page", "seq", "x2", "y2", "font", "attrs", "data").foreachPartition(write)
