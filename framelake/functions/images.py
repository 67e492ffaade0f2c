"""Frames as images: grey, Lanczos grid, and PNG."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@cache
def lanczos(source: int, target: int) -> np.ndarray:
    """Weights (target, source) of a Lanczos-3 resize that widens its kernel when it shrinks."""
    scale = source / target
    reach = 3 * max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    x = (np.arange(source)[None, :] + 0.5 - centre[:, None]) / max(scale, 1.0)
    w = np.where(np.abs(x) * max(scale, 1.0) < reach, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """uint8 images (n, h, w) to (n, height, width), rounded between the passes as 8-bit images are."""
    across = np.clip(np.rint(images @ lanczos(images.shape[2], width).T), 0, 255)
    return np.clip(np.rint(np.einsum("th,nhw->ntw", lanczos(images.shape[1], height), across)), 0, 255).astype(np.uint8)


def grid(frames: np.ndarray, size: int) -> np.ndarray:
    """Frames (n, h, w[, c]) to ``size`` numbers: grey, a square grid, over 255, padded with zeros."""
    if frames.ndim == 4:
        frames = frames.astype(np.float32).mean(axis=3) if frames.shape[3] > 1 else frames[..., 0]
    elif frames.ndim != 3:
        raise ValueError(f"frames of images have 2 or 3 axes, not {frames.ndim - 1}")
    side = int(size**0.5)
    if side < 1:
        raise ValueError("an embedding needs at least one number")
    out = np.zeros((len(frames), size), np.float32)
    out[:, : side * side] = resize(np.clip(frames, 0, 255).astype(np.uint8), side, side).reshape(len(frames), -1) / np.float32(255)
    return out


def channel_grid(frames: np.ndarray, size: int) -> np.ndarray:
    """Frames (n, h, w[, c]) to floor(sqrt(size)) squared numbers a channel, over 255."""
    frames = frames[..., None] if frames.ndim == 3 else frames
    side = max(1, int(size**0.5))
    planes = [resize(np.clip(frames[..., c], 0, 255).astype(np.uint8), side, side) for c in range(frames.shape[3])]
    return (np.stack(planes, axis=3).reshape(len(frames), -1) / np.float32(255)).astype(np.float32)


def grid_features(frames: DataFrame, size: int) -> DataFrame:
    """``frames`` (with payload, shape and dtype of a frame) with ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for payload, shape, dtype in zip(
                batch.column("payload"), batch.column("shape").to_pylist(), batch.column("dtype").to_pylist(), strict=True
            ):
                out.append(grid(np.frombuffer(payload.as_buffer(), np.dtype(dtype)).reshape(1, *shape), size)[0].astype(np.float64))
            yield batch.append_column("features", pa.array(out, pa.list_(pa.float64())))

    return frames.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in frames.dtypes) + ", features array<double>")


def read_png(content: bytes) -> np.ndarray:
    """(h, w, channels) of an 8-bit PNG that isn't interlaced; a palette is looked up."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(content):
        n, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None or head[8] != 8 or head[12]:
        raise ValueError("only 8-bit PNGs that aren't interlaced are read")
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[9]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * channels)
    image = _unfiltered(raw[:, 0], raw[:, 1:].reshape(height, width, channels))
    return palette[image[..., 0]] if palette is not None else image


def _unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo a PNG's line filters; lines are (h, w, channels) of bytes.

    Lines that lean on the left alone are running sums, those that lean on the line above one addition.
    The two kinds that lean on both go pixel by pixel, but only along the diagonals
    of a run of such lines: pixels of a diagonal don't depend on one another.
    """
    height, width, _ = lines.shape
    out = np.zeros((height + 1, width + 1, lines.shape[2]), np.int16)  # a zero line above, a zero pixel to the left
    y = 0
    while y < height:
        kind, line = kinds[y], lines[y].astype(np.int16)
        if kind < 3:
            base = out[y, 1:] if kind == 2 else 0
            out[y + 1, 1:] = (np.cumsum(line, axis=0, dtype=np.int64) if kind == 1 else line + base) & 255
            y += 1
            continue
        end = y
        while end < height and kinds[end] >= 3:
            end += 1
        rows, average = np.arange(y, end), (kinds[y:end] == 3)[:, None]
        for d in range(len(rows) + width - 1):
            own = rows[max(0, d - width + 1) : d + 1]
            x = d - (own - y)
            left, above, corner = out[own + 1, x], out[own, x + 1], out[own, x]
            near_left, near_above, near_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
            paeth = np.where((near_left <= near_above) & (near_left <= near_corner), left, np.where(near_above <= near_corner, above, corner))
            out[own + 1, x + 1] = (lines[own, x] + np.where(average[own - y], (left + above) // 2, paeth)) & 255
        y = end
    return out[1:, 1:].astype(np.uint8)


def to_uint8(frame: np.ndarray) -> np.ndarray:
    """Bytes as they are; other numbers scaled from their range to 0..255, half to even."""
    if frame.dtype == np.uint8:
        return frame
    x = frame.astype(np.float64)
    low, high = x.min(), x.max()
    if high - low < 1e-9:
        return np.zeros(frame.shape, np.uint8)
    return np.clip(np.rint((x - low) / (high - low) * 255), 0, 255).astype(np.uint8)


def to_image(frame: np.ndarray, largest: int | None = None) -> tuple[np.ndarray, str]:
    """A frame (h, w), (h, w, 1), (h, w, 3) or (h, w, 4) as bytes and its mode (L, RGB or RGBA), shrunk so
    that its larger side is at most ``largest``."""
    mode = {(2,): "L", (3, 1): "L", (3, 3): "RGB", (3, 4): "RGBA"}.get((frame.ndim, *frame.shape[2:]))
    if mode is None:
        raise ValueError(f"a frame of shape {frame.shape} is no image")
    image = to_uint8(frame[..., 0] if frame.shape[2:] == (1,) else frame)
    if largest is not None and max(image.shape[:2]) > largest:
        h, w = (max(1, round(n * largest / max(image.shape[:2]))) for n in image.shape[:2])
        planes = image[..., None] if image.ndim == 2 else image
        planes = np.stack([resize(planes[None, ..., c], h, w)[0] for c in range(planes.shape[2])], axis=2)
        image = planes[..., 0] if image.ndim == 2 else planes
    return image, mode


def frame_images(frames: DataFrame, largest: int | None = None) -> DataFrame:
    """(recording_id, frame_idx, mode, height, width, pixels) of frames that are images; one that isn't is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                to_image(np.frombuffer(p.as_buffer(), np.dtype(d)).reshape(s), largest) for p, s,
                d in zip(batch.column("payload"), batch.column("shape").to_pylist(), batch.column("dtype").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("recording_id"), batch.column("frame_idx"), pa.array([m for _, m in made], pa.string()),
                    *(pa.array([i.shape[k] for i, _ in made], pa.int32()) for k in (0, 1)),
                    pa.array([i.tobytes() for i, _ in made], pa.binary())
                ],
                ["recording_id", "frame_idx", "mode", "height", "width", "pixels"],
            )

    ready = frames.select(
        F.col("recording_id").cast("string").alias("recording_id"), F.col("frame_idx").cast("long").alias("frame_idx"), "payload",
        "shape", "dtype"
    )
    return ready.mapInArrow(run, "recording_id string, frame_idx long, mode string, height int, width int, pixels binary")
