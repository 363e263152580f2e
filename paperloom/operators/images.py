"""Image preparation and features over a table of images.

An image row has ``width``, ``height`` and ``px``: gray levels row by row, as binary (compact, for
storage) or ``array<int>``.  Each row is worked on alone inside its task, in small numpy batches,
and nothing is shuffled.  Every function keeps the other columns of the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 256
PRECISION = 22

# Reach of each resampling kernel in source pixels.
SUPPORT = {"bilinear": 1.0, "bicubic": 2.0, "lanczos": 3.0}
LUMA_WEIGHTS = (19595, 38470, 7471)


def kernel(name: str, x: np.ndarray) -> np.ndarray:
    """Resampling weight at distance ``x``."""
    x = np.abs(x)
    if name == "bilinear":
        return np.clip(1.0 - x, 0.0, None)
    if name == "bicubic":
        near = (1.5 * x - 2.5) * x * x + 1.0
        far = ((-0.5 * x + 2.5) * x - 4.0) * x + 2.0
        return np.where(x < 1, near, np.where(x < 2, far, 0.0))
    if name == "lanczos":
        return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    raise ValueError(f"unknown kernel {name}")


def resize_weights(source: int, target: int, name: str) -> np.ndarray:
    """``target × source`` fixed-point weights; shrinking widens the kernel to avoid aliasing."""
    scale = source / target
    stretch = max(scale, 1.0)
    reach = SUPPORT[name] * stretch
    centre = (np.arange(target) + 0.5) * scale
    first = np.maximum(np.trunc(centre - reach + 0.5), 0)[:, None]
    last = np.minimum(np.trunc(centre + reach + 0.5), source)[:, None]
    at = np.arange(source)[None, :]
    raw = np.where((at >= first) & (at < last), kernel(name, (at - centre[:, None] + 0.5) / stretch), 0.0)
    share = raw / raw.sum(axis=1, keepdims=True)
    return np.trunc(share * (1 << PRECISION) + np.copysign(0.5, share))


def resize_stack(stack: np.ndarray, size: int, name: str) -> np.ndarray:
    """Resize ``(n, h, w)`` images to ``size × size``: rows first, 8-bit in between, then columns.

    The weights are whole numbers, so the float products are exact.
    """

    def settle(x):
        return np.clip(np.floor((x + (1 << (PRECISION - 1))) / (1 << PRECISION)), 0, 255)

    out = stack.astype(np.float64)
    height, width = out.shape[1:]
    if width != size:
        out = settle(out @ resize_weights(width, size, name).T)
    if height != size:
        out = settle(resize_weights(height, size, name) @ out)
    return out.astype(np.uint8)


def hog_stack(stack: np.ndarray, cell: int = 8, block: int = 2, bins: int = 9, clip: float = 0.2) -> np.ndarray:
    """Gradient-orientation histograms of ``(n, h, w)`` images in 0..1, clipped block normalisation."""
    rows, cols = np.zeros_like(stack), np.zeros_like(stack)
    rows[:, 1:-1, :] = stack[:, 2:, :] - stack[:, :-2, :]
    cols[:, :, 1:-1] = stack[:, :, 2:] - stack[:, :, :-2]
    strength = np.hypot(cols, rows)
    slot = np.minimum((np.rad2deg(np.arctan2(rows, cols)) % 180.0) // (180.0 / bins), bins - 1)
    n, height, width = stack.shape
    down, across = height // cell, width // cell
    cells = np.empty((n, down, across, bins))
    for b in range(bins):
        part = np.where(slot == b, strength, 0.0)[:, : down * cell, : across * cell]
        cells[..., b] = part.reshape(n, down, cell, across, cell).mean(axis=(2, 4))
    spans = np.lib.stride_tricks.sliding_window_view(cells, (block, block), axis=(1, 2))
    blocks = np.moveaxis(spans, 3, 5)

    def unit(x):
        return x / np.sqrt((x * x).sum(axis=(3, 4, 5), keepdims=True) + 1e-10)

    return unit(np.minimum(unit(blocks), clip)).reshape(n, -1)


def otsu_levels(counts: np.ndarray) -> np.ndarray:
    """For each row of 256 level counts the first level that maximises the between-class variance, levels with an empty
    side left out; 0 where there is no other."""
    below, mass = np.cumsum(counts, axis=1), np.cumsum(counts * np.arange(256), axis=1)
    total, whole = below[:, -1:], mass[:, -1:]
    split = (below > 0) & (below < total)
    apart = total * mass.astype(np.float64) - below * whole.astype(np.float64)
    spread = np.where(split, apart * apart / np.where(split, below * (total - below).astype(np.float64), 1.0), -1.0)
    return np.where(split.any(axis=1), np.argmax(spread, axis=1), 0)


def otsu_level(px: np.ndarray) -> int:
    """The threshold of one image."""
    return int(otsu_levels(np.bincount(px, minlength=256)[None])[0])


def flat_levels(images) -> tuple[np.ndarray, np.ndarray]:
    """Levels 0 to 255 of all images, one after the other, and where each starts and the last ends; other levels are an
    error.  Pixels are bytes or arrays."""
    images = list(images)
    ends = np.concatenate([[0], np.cumsum([len(px) for px in images], dtype=np.int64)])
    if all(isinstance(px, (bytes, bytearray)) for px in images):
        return np.frombuffer(b"".join(images), np.uint8), ends
    levels = np.concatenate([np.frombuffer(px, np.uint8) if isinstance(px, (bytes, bytearray)) else np.asarray(px) for px in images])
    if levels.size and (levels.min() < 0 or levels.max() > 255):
        raise ValueError("levels must lie between 0 and 255")
    return levels.astype(np.uint8), ends


def level_counts(levels: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Groups x 256 counts of levels, by one count over numbers that carry the group."""
    return np.bincount(group * 256 + levels, minlength=groups * 256).reshape(groups, 256)


def _usable(piece: pd.DataFrame) -> np.ndarray:
    """Rows with a size and pixels."""
    ok = np.ones(len(piece), bool)
    for name in ("height", "width", "px", "data"):
        if name in piece:
            ok &= piece[name].notna().to_numpy()
    for name in ("height", "width"):
        if name in piece:
            ok &= piece[name].fillna(0).to_numpy() > 0
    return ok


def _with_nulls(values, ok: np.ndarray) -> pd.Series:
    """Results of the usable rows in their places, null elsewhere."""
    out = pd.Series([None] * len(ok), dtype=object)
    out[np.flatnonzero(ok)] = pd.Series(list(values), index=np.flatnonzero(ok), dtype=object)
    return out


def _map_images(df: DataFrame, work: Callable[[pd.DataFrame], dict], added: list[T.StructField]) -> DataFrame:
    """Run ``work`` on small pieces of each Arrow batch and append or replace columns.

    Rows without size or pixels stay, with nulls in the added columns.
    """
    names = [f.name for f in added]
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *added])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), CHUNK):
                piece = pdf.iloc[start : start + CHUNK].reset_index(drop=True)
                ok = _usable(piece)
                if ok.all():
                    piece = piece.assign(**work(piece))
                else:
                    done = work(piece[ok].reset_index(drop=True)) if ok.any() else {}
                    piece = piece.assign(**{n: _with_nulls(done.get(n, ()), ok) for n in names})
                yield piece[[f.name for f in schema.fields]]

    return df.mapInPandas(run, schema)


def _by_size(piece: pd.DataFrame, work: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Apply ``work`` to stacks of equally sized images and their rows, results in row order."""
    out = None
    for (height, width), part in piece.groupby(["height", "width"]):
        result = work(flat_levels(part["px"])[0].reshape(len(part), height, width), part)
        if out is None:
            out = np.empty((len(piece), *result.shape[1:]), dtype=result.dtype)
        out[part.index] = result
    return out


def _as_bytes(stack: np.ndarray) -> np.ndarray:
    """A stack of images as one binary value each."""
    out = np.empty(len(stack), dtype=object)
    out[:] = [image.tobytes() for image in stack]
    return out


def resize(df: DataFrame, size: int, method: str = "lanczos") -> DataFrame:
    """Resize to ``size × size``; pixels come back as binary.

    Lanczos for the stored corpus, bicubic for features, bilinear for network input.
    """
    if method not in SUPPORT:
        raise ValueError(f"method is one of {sorted(SUPPORT)}")

    def work(piece):
        done = _by_size(piece, lambda s, _: resize_stack(s, size, method))
        return {"width": size, "height": size, "px": [img.tobytes() for img in done]}

    fields = [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("px", T.BinaryType()),
    ]
    return _map_images(df, work, fields)


FEATURES = [T.StructField("features", T.ArrayType(T.DoubleType()))]


def pixel_features(df: DataFrame, size: int = 64) -> DataFrame:
    """Pixels after a bicubic resize, as ``features``."""

    def work(piece):
        flat = _by_size(piece, lambda s, _: resize_stack(s, size, "bicubic").reshape(len(s), -1).astype(np.float64))
        return {"features": list(flat)}

    return _map_images(df, work, FEATURES).drop("px", "width", "height")


def hog_features(df: DataFrame, size: int = 128, cell: int = 8) -> DataFrame:
    """Gradient descriptor after a bicubic resize, as ``features``; 8100 values at 128 pixels."""

    def work(piece):
        flat = _by_size(
            piece, lambda s, _: hog_stack(resize_stack(s, size, "bicubic") / 255.0, cell)
        )
        return {"features": list(flat)}

    return _map_images(df, work, FEATURES).drop("px", "width", "height")


def to_gray(images: DataFrame) -> DataFrame:
    """Rows of the image source (1, 3 or 4 channels, blue first) to one 8-bit gray channel; null pixels where a file can't be decoded."""
    red, green, blue = LUMA_WEIGHTS

    def work(piece):
        gray = np.empty(len(piece), dtype=object)
        for (height, width, channels), part in piece.groupby(["height", "width", "nChannels"]):
            px = np.frombuffer(b"".join(part["data"]), np.uint8).reshape(len(part), height * width, channels)
            if channels == 1:
                level = px[..., 0]
            else:
                wide = px.astype(np.int64)
                level = ((wide[..., 2] * red + wide[..., 1] * green + wide[..., 0] * blue + 32768) >> 16).astype(np.uint8)
            gray[part.index] = [row.tobytes() for row in level]
        return {"px": gray}

    return _map_images(images, work, [T.StructField("px", T.BinaryType())]).drop("data", "nChannels", "mode")


def otsu(df: DataFrame) -> DataFrame:
    """Threshold of each image, and its pixels above the threshold as 255, others as 0."""

    def work(piece):
        levels, ends = flat_levels(piece["px"])
        row = np.repeat(np.arange(len(piece)), np.diff(ends))
        cut = otsu_levels(level_counts(levels, row, len(piece)))
        white = np.where(levels > cut[row], 255, 0).astype(np.uint8).tobytes()
        bounds = ends.tolist()
        return {"threshold": cut, "binary": [white[a:b] for a, b in zip(bounds, bounds[1:])]}

    return _map_images(df, work, [T.StructField("threshold", T.IntegerType()), T.StructField("binary", T.BinaryType())])


DRAWS = 5
TURN = 1 << 16  # fixed-point unit of the turn


def draw(doc_id: Column, epoch: int, seed: int, number: int) -> Column:
    """A number from 0 to 2^28 - 1: a function of document, epoch, seed and the draw's number alone."""
    key = F.concat(doc_id.cast("string"), F.lit(f":{epoch}:{seed}:{number}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("int")


def augment_stack(stack: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Mirror with chance 0.2, turn by up to 5 degrees in tenths, then brightness and contrast by up to a fifth in
    hundredths, in either order.  ``draws`` has `DRAWS` numbers per image; all steps are whole numbers."""
    n, height, width = stack.shape
    image = stack.astype(np.int64)
    image = np.where((draws[:, 0] % 5 == 0)[:, None, None], image[:, :, ::-1], image)
    angle = np.deg2rad((draws[:, 1] % 101 - 50) / 10.0)
    cos, sin = (np.floor(f(angle) * TURN + 0.5).astype(np.int64)[:, None, None] for f in (np.cos, np.sin))
    y, x = 2 * np.mgrid[0:height, 0:width] - np.array([height - 1, width - 1])[:, None, None]
    from_x = (cos * x - sin * y + width * TURN) // (2 * TURN)
    from_y = (sin * x + cos * y + height * TURN) // (2 * TURN)
    inside = (from_x >= 0) & (from_x < width) & (from_y >= 0) & (from_y < height)
    at = np.arange(n)[:, None, None], np.clip(from_y, 0, height - 1), np.clip(from_x, 0, width - 1)
    turned = np.where(inside, image[at], 0)
    bright, contrast = (80 + draws[:, k, None, None] % 41 for k in (2, 3))

    def lighter(v):
        return np.minimum(v * bright // 100, 255)

    def harder(v):
        size = height * width
        mean = (2 * v.sum(axis=(1, 2), keepdims=True) + size) // (2 * size)
        return np.clip((mean * 100 + (v - mean) * contrast) // 100, 0, 255)

    swapped = (draws[:, 4] % 2 == 1)[:, None, None]
    return np.where(swapped, lighter(harder(turned)), harder(lighter(turned))).astype(np.uint8)


def augment(df: DataFrame, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Randomly changed copies for training, in stacks of equal size.

    The draws depend on document, epoch and seed only, so a lost task repeats them exactly.
    """
    drawn = df.withColumn("_draws", F.array(*(draw(F.col("doc_id"), epoch, seed, k) for k in range(DRAWS))))

    def work(piece):
        return {"px": _by_size(piece, lambda s, rows: _as_bytes(augment_stack(s, np.stack(rows["_draws"]).astype(np.int64))))}

    return _map_images(drawn, work, [T.StructField("px", T.BinaryType())]).drop("_draws")
