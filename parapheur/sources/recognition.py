"""The boundary to recognition models: a backend turns files into lines inside the executors; everything after it is Spark SQL.

A backend is any picklable object with ``lines(path, content)`` that yields (page, line_no, text, confidence, polygon) and, if it
finds tables itself, ``tables(path, content)`` that yields (page, table). It is built once a worker, on first use, by ``load()``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = "doc_id STRING, page INT, line_no INT, text STRING, confidence DOUBLE, polygon ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, error STRING"


class Backend(Protocol):
    def load(self) -> None: ...

    def lines(self, path: str, content: bytes) -> Iterable[tuple[int, int, str, float | None, list[tuple[float, float]]]]: ...


class PlainTextBackend:
    """Reads files that hold text already, a form feed between pages; stands in for a model in tests and dry runs."""

    def load(self) -> None:
        self.height = 40.0

    def lines(self, path: str, content: bytes) -> Iterator[tuple[int, int, str, float | None, list[tuple[float, float]]]]:
        for page, text in enumerate(content.decode("utf-8").split("\f"), 1):
            for i, line in enumerate(text.split("\n")):
                right, top = 12.0 * len(line), self.height * i
                yield page, i, line, 0.9, [(0.0, top), (right, top), (right, top + self.height), (0.0, top + self.height)]


def recognised_lines(files: DataFrame, backend: Backend) -> DataFrame:
    """``ocr_lines`` of document files (path, doc_id, content). A file the backend fails on gives one row with the error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not getattr(backend, "_ready", False):
            backend.load()
            backend._ready = True
        for batch in batches:
            for path, doc_id, content in batch[["path", "doc_id", "content"]].itertuples(index=False):
                try:
                    rows = [(doc_id, p, i, text, conf, [{"x": x, "y": y} for x, y in polygon], None) for p, i, text, conf, polygon in backend.lines(path, bytes(content))]
                except Exception as error:  # noqa: BLE001 - any failure of a model is data here
                    rows = [(doc_id, None, None, None, None, None, f"{type(error).__name__}: {error}")]
                yield pd.DataFrame(rows, columns=["doc_id", "page", "line_no", "text", "confidence", "polygon", "error"])

    return files.select("path", "doc_id", "content").mapInPandas(run, LINES)


# Images ----------------------------------------------------------------------------------------------------------------
# Grey images as 2-d arrays; each step is a plain function on one page, so that a backend runs them all in one worker.


def gray(image: np.ndarray) -> np.ndarray:
    """Grey values of a blue-green-red image; grey images as they are."""
    return image.astype(float) if image.ndim == 2 else image[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299])


def is_digital(image: np.ndarray) -> bool:
    """Bright and even pages were never printed and scanned."""
    g = gray(image)
    return bool(g.mean() > 200 and g.std() < 60)


def _gaussian(sigma: float) -> np.ndarray:
    radius = max(1, round(3 * sigma))
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    return k / k.sum()


def _blur(g: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r = len(kernel) // 2
    rows = np.pad(g, ((0, 0), (r, r)), mode="reflect" if g.shape[1] > r else "edge")
    g = sum(w * rows[:, i : i + g.shape[1]] for i, w in enumerate(kernel))
    columns = np.pad(g, ((r, r), (0, 0)), mode="reflect" if g.shape[0] > r else "edge")
    return sum(w * columns[i : i + g.shape[0]] for i, w in enumerate(kernel))


def sharpen(image: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """Unsharp mask: 1.5 parts of the page less half a part of its blur."""
    planes = image[..., None] if image.ndim == 2 else image
    out = np.stack([np.clip(np.rint(1.5 * p - 0.5 * _blur(p.astype(float), _gaussian(sigma))), 0, 255) for p in np.moveaxis(planes, -1, 0)], axis=-1).astype(np.uint8)
    return out[..., 0] if image.ndim == 2 else out


def skew_angle(image: np.ndarray, limit: float = 45.0, step: float = 0.25) -> float:
    """Degrees by which the lines of a page are turned: where the profile of all its ink has the sharpest edges. 0 below half a degree.

    The whole range is tried in steps, then the neighbourhood of the best in twentieths of a degree.
    """
    ys, xs = np.nonzero(gray(image) < 128)
    if not len(ys):
        return 0.0

    def sharpness(angle: float) -> float:
        # every column is moved by a whole number of rows, so that even ink stays even at any angle
        rows = ys - np.rint(np.tan(np.radians(angle)) * np.arange(image.shape[1])).astype(int)[xs]
        return float((np.diff(np.bincount(rows - rows.min()), prepend=0, append=0).astype(float) ** 2).sum())

    def sharpest(angles: np.ndarray) -> float:
        return float(max(angles, key=lambda a: (sharpness(a), -abs(a))))

    n = round(limit / step)
    best = sharpest(np.arange(-n, n + 1) * step)
    near = best + np.arange(-round(step / 0.05), round(step / 0.05) + 1) * 0.05
    best = sharpest(near[np.abs(near) <= limit + 1e-9])
    return 0.0 if abs(best) < 0.5 else best


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the four pixels around a place, ``t`` behind the second (cubic convolution, a = -0.75)."""
    a = -0.75
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def deskew(image: np.ndarray) -> np.ndarray:
    """The page turned back about its middle by its skew; pixels are interpolated, the edge's go on outside."""
    angle = np.radians(skew_angle(image))
    if not angle:
        return image
    h, w = image.shape[:2]
    out = np.empty_like(image)
    across = np.arange(w)[None, :] - w // 2
    for top in range(0, h, 256):  # bands keep the copies small
        down = np.arange(top, min(top + 256, h))[:, None] - h // 2
        x = w // 2 + np.cos(angle) * across - np.sin(angle) * down
        y = h // 2 + np.sin(angle) * across + np.cos(angle) * down
        left, upper = np.floor(x).astype(int), np.floor(y).astype(int)
        total = np.zeros((*x.shape, *image.shape[2:]))
        for j, v in enumerate(_cubic(y - upper), -1):
            for i, u in enumerate(_cubic(x - left), -1):
                weight = (u * v).reshape(*x.shape, *[1] * (image.ndim - 2))
                total += weight * image[np.clip(upper + j, 0, h - 1), np.clip(left + i, 0, w - 1)]
        out[top : top + 256] = np.clip(np.rint(total), 0, 255)
    return out


def denoise(image: np.ndarray, strength: float = 10.0, patch: int = 7, reach: int = 10) -> np.ndarray:
    """Non-local means: every pixel a mean of near ones, weighted by how alike their surroundings are.

    ``patch`` is the width of the surroundings compared; pixels up to ``reach`` away count, so 10 is a window of 21.
    """
    g = gray(image).astype(np.float32)
    h, w = g.shape
    r = patch // 2
    pad = np.pad(g, reach + r, mode="reflect")
    total, weight = g.copy(), np.ones_like(g)
    here = pad[reach : reach + h + 2 * r, reach : reach + w + 2 * r]
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            if not dy and not dx:
                continue
            there = pad[reach + dy : reach + dy + h + 2 * r, reach + dx : reach + dx + w + 2 * r]
            apart = (here - there) ** 2
            rows = sum(apart[:, i : i + w] for i in range(2 * r + 1))
            apart = sum(rows[i : i + h] for i in range(2 * r + 1)) / np.float32((2 * r + 1) ** 2 * strength**2)
            alike = np.exp(-apart)
            alike[alike < 0.001] = 0
            total += alike * there[r : r + h, r : r + w]
            weight += alike
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


def denoised_for_tables(image: np.ndarray) -> np.ndarray:
    """The milder smoothing before tables are looked for: strength 5, surroundings of 7, a window of 15."""
    return denoise(image, strength=5.0, patch=7, reach=7)


def threshold(image: np.ndarray, block: int = 31, less: float = 11.0) -> np.ndarray:
    """Black where a pixel is darker than its Gaussian surroundings by more than ``less``."""
    g = gray(image)
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-(np.arange(-(block // 2), block // 2 + 1) ** 2) / (2 * sigma**2))
    return np.where(g > _blur(g, kernel / kernel.sum()) - less, 255, 0).astype(np.uint8)


def preprocessed(image: np.ndarray) -> np.ndarray:
    """Digital pages are sharpened; scanned ones are turned upright, denoised and made black and white."""
    return sharpen(image) if is_digital(image) else threshold(denoise(deskew(image)))


def stamps(image: np.ndarray, smallest: int = 30, largest: int = 200, apart: int = 50, complete: float = 0.5) -> list[tuple[int, int, int]]:
    """(x, y, radius) of round stamps: edge points vote for centres along their gradient, a circle needs half its rim.

    Stronger circles come first; a weaker one nearer than ``apart`` to one already found is left out.
    """
    g = _blur(gray(image), _gaussian(1.5))
    gy, gx = np.gradient(g)
    size = np.hypot(gx, gy)
    ys, xs = np.nonzero(size > 12)
    if not len(ys):
        return []
    dx, dy = gx[ys, xs] / size[ys, xs], gy[ys, xs] / size[ys, xs]
    found: list[tuple[float, int, int, int]] = []
    for radius in range(smallest, largest + 1, 2):
        votes = np.zeros(g.shape)
        for side in (1, -1):
            cx, cy = np.rint(xs + side * radius * dx).astype(int), np.rint(ys + side * radius * dy).astype(int)
            ok = (cx >= 0) & (cx < g.shape[1]) & (cy >= 0) & (cy < g.shape[0])
            np.add.at(votes, (cy[ok], cx[ok]), 1.0)
        votes = _blur(votes, np.ones(5)) / (2 * np.pi * radius)  # share of the rim whose normals meet within two pixels
        for y, x in np.argwhere(votes >= complete):
            found.append((float(votes[y, x]), int(x), int(y), radius))
    kept: list[tuple[int, int, int]] = []
    for _, x, y, radius in sorted(found, key=lambda c: (-c[0], c[3], c[2], c[1])):
        if all(np.hypot(x - a, y - b) >= apart for a, b, _ in kept):
            kept.append((x, y, radius))
    return kept


def looks_handwritten(image: np.ndarray) -> bool:
    """Strokes of very uneven size: at least five components whose areas vary by more than half the region's size.

    Regions wider than three times their height, or under 30 pixels either way, are taken for print.
    """
    h, w = image.shape[:2]
    if w > 3 * h or h < 30 or w < 30:
        return False
    areas = _component_areas(gray(image) < 128)
    return bool(len(areas) >= 5 and np.var(areas) / (h * w) > 0.5)


def _component_areas(ink: np.ndarray) -> list[int]:
    areas, left = [], ink.copy()
    while left.any():
        y, x = np.argwhere(left)[0]
        todo, size = [(y, x)], 0
        left[y, x] = False
        while todo:
            y, x = todo.pop()
            size += 1
            for a in range(max(0, y - 1), min(ink.shape[0], y + 2)):
                for b in range(max(0, x - 1), min(ink.shape[1], x + 2)):
                    if left[a, b]:
                        left[a, b] = False
                        todo.append((a, b))
        areas.append(size)
    return areas


def page_statistics(images: DataFrame) -> DataFrame:
    """(doc_id, page, mean, std) of grey images (doc_id, page, height, width, channels, data), from which SQL tells digital pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stats = [gray(np.frombuffer(bytes(d), np.uint8).reshape((h, w) if c == 1 else (h, w, c))) for h, w, c, d in batch[["height", "width", "channels", "data"]].itertuples(index=False)]
            yield batch[["doc_id", "page"]].assign(mean=[float(s.mean()) for s in stats], std=[float(s.std()) for s in stats])

    return images.select("doc_id", "page", "height", "width", "channels", "data").mapInPandas(run, "doc_id STRING, page INT, mean DOUBLE, std DOUBLE")


def digital(mean: Column, std: Column) -> Column:
    return (mean > 200) & (std < 60)


def layout_regions(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, text, tables): a layout model's labelled boxes as two lists; labels that name a table are tables."""
    table = F.lower("label").contains("table")
    part = lambda want: F.sort_array(F.collect_list(F.when(table if want else ~table, F.col("bbox"))))
    return boxes.groupBy("doc_id", "page").agg(part(False).alias("text"), part(True).alias("tables"))


def with_fallback(first: DataFrame, pages: DataFrame, second) -> DataFrame:
    """Tables (doc_id, page, ...) of a first method, and of ``second(pages)`` only for the pages where the first found none."""
    missing = pages.join(first.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return first.unionByName(second(missing), allowMissingColumns=True)
