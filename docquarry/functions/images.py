"""Column functions on images in a binary column: PNG in, numpy in Arrow batches, values or PNG out.

A blob that is null or cannot be read as PNG gives null everywhere."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docquarry.functions import pixels
from docquarry.functions.similarity import ssim

# ---- fixed values
#: Least ratio of sides of a square image; greatest difference of channels in a grey one.
SQUARE, GREY_DELTA = 0.9, 3
#: Pixels looked at for grey; pixels from which colours are counted on a sample, and its size.
GREY_SAMPLE, COUNTED_WHOLE, COLOUR_SAMPLE = 5000, 300_000, 100_000


def of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


INT, LONG, REAL = T.IntegerType(), T.LongType(), T.DoubleType()
BOX = of(x=INT, y=INT, width=INT, height=INT, area=INT)
REGIONS = of(pixels=LONG, boxes=T.ArrayType(BOX))


def _each(blobs: pd.Series, run: Callable[[np.ndarray], object], none: object = None) -> list:
    decoded = map(pixels.decode_png, blobs)
    return [none if image is None else run(image) for image in decoded]


@pandas_udf(T.BinaryType())
def grey_png(values: pd.Series, width: pd.Series) -> pd.Series:
    """PNG of grey levels in rows of ``width``."""
    return pd.Series([pixels.encode_png(np.asarray(v, np.uint8).reshape(-1, w)) for v, w in zip(values, width)], dtype=object)


@pandas_udf(T.BinaryType())
def colour_png(values: pd.Series, width: pd.Series) -> pd.Series:
    """PNG of red, green and blue levels, pixel by pixel, in rows of ``width`` pixels."""
    return pd.Series([pixels.encode_png(np.asarray(v, np.uint8).reshape(-1, w, 3)) for v, w in zip(values, width)], dtype=object)


def _looked_at(image: np.ndarray, most: int = 5):
    flat = pixels.colours(image).reshape(-1, 3).astype(np.int64)
    part = flat[:: max(1, len(flat) // GREY_SAMPLE)]
    if (part.max(1) - part.min(1) <= GREY_DELTA).all():
        return True, None
    if len(flat) > COUNTED_WHOLE:
        flat = flat[:: max(1, len(flat) // COLOUR_SAMPLE)]
    kinds, first, n = np.unique(flat @ (1 << 16, 1 << 8, 1), return_index=True, return_counts=True)
    best = np.lexsort((first, -n))[:most]
    return False, [{"r": int(c >> 16), "g": int(c >> 8 & 255), "b": int(c & 255), "ratio": round(int(k) / len(flat), 4)} for c, k in zip(kinds[best], n[best])]


@pandas_udf(of(width=INT, height=INT, grey=T.BooleanType(), colours=T.ArrayType(of(r=INT, g=INT, b=INT, ratio=REAL))))
def _seen(blobs: pd.Series) -> pd.DataFrame:
    rows = _each(blobs, lambda image: (image.shape[1], image.shape[0], *_looked_at(image)), (None,) * 4)
    return pd.DataFrame(rows, columns=["width", "height", "grey", "colours"]).astype(object)


def colours_json(colours: Column) -> Column:
    """Text of [[[r, g, b], share], ...], spaced as Python's json does."""
    share = lambda x: F.regexp_replace(x["ratio"].cast("decimal(5,4)").cast("string"), r"(\.\d+?)0*$", "$1")
    one = lambda x: F.concat(F.lit("[["), F.concat_ws(", ", *(x[c].cast("string") for c in "rgb")), F.lit("], "), share(x), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(colours, one), ", "), F.lit("]"))


def features(blob: Column) -> Column:
    """Struct width, height, aspect_ratio, is_square, is_grayscale, top_colors; null for what cannot be read."""
    seen = _seen(blob)
    w, h = seen["width"], seen["height"]
    made = F.struct(
        w.alias("width"),
        h.alias("height"),
        F.round(w / h, 6).alias("aspect_ratio"),
        (F.least(w, h) / F.greatest(w, h) >= SQUARE).cast("int").alias("is_square"),
        seen["grey"].cast("int").alias("is_grayscale"),
        colours_json(seen["colours"]).alias("top_colors"),
    )
    return F.when(w.isNotNull(), made)


@pandas_udf(T.LongType())
def perceptual_hash(blobs: pd.Series) -> pd.Series:
    return pd.Series(_each(blobs, pixels.perceptual_hash), dtype="Int64")


@pandas_udf(T.DoubleType())
def structural_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """SSIM of two images in grey at 512 pixels or less; 0 if one cannot be read."""
    score = lambda x, y: 0.0 if x is None or y is None else ssim(pixels.compared(x), pixels.compared(y))
    return pd.Series([score(pixels.decode_png(x), pixels.decode_png(y)) for x, y in zip(a, b)], dtype=float)


@pandas_udf(of(level=INT, above=LONG, over=LONG))
def thresholds(blobs: pd.Series) -> pd.DataFrame:
    """Otsu's level, the pixels above it, and those above 128."""

    def run(image):
        image = pixels.grey(image)
        level = pixels.otsu(image)
        return level, int((image > level).sum()), int((image > 128).sum())

    return pd.DataFrame(_each(blobs, run, (None,) * 3), columns=["level", "above", "over"]).astype("Int64")


@pandas_udf(T.BinaryType())
def cropped(blobs: pd.Series, x: pd.Series, y: pd.Series, width: pd.Series, height: pd.Series, pad: pd.Series) -> pd.Series:
    """PNG of a box with ``pad`` pixels about it, cut to the image; null if nothing is left."""
    out = []
    for blob, *box in zip(blobs, x, y, width, height, pad):
        image = pixels.decode_png(blob)
        got = None if image is None else pixels.crop(image, *map(int, box))
        out.append(None if got is None else pixels.encode_png(got))
    return pd.Series(out, dtype=object)


@pandas_udf(T.BinaryType())
def framed(blobs: pd.Series, by: pd.Series) -> pd.Series:
    """PNG with a white frame."""
    images = map(pixels.decode_png, blobs)
    return pd.Series([None if i is None else pixels.encode_png(pixels.framed(i, int(n))) for i, n in zip(images, by)], dtype=object)


@pandas_udf(T.BinaryType())
def thumbnail(blobs: pd.Series, side: pd.Series) -> pd.Series:
    """PNG of the image, made to fit in side x side."""
    images = map(pixels.decode_png, blobs)
    return pd.Series([None if i is None else pixels.encode_png(pixels.fitted(i, int(n), "lanczos")) for i, n in zip(images, side)], dtype=object)


@pandas_udf(T.ArrayType(T.IntegerType()))
def grey_levels(blobs: pd.Series) -> pd.Series:
    """Grey levels row by row."""
    return pd.Series(_each(blobs, lambda image: pixels.grey(image).reshape(-1).astype(np.int32)), dtype=object)


@pandas_udf(of(width=INT, height=INT, total=LONG))
def grey_totals(blobs: pd.Series) -> pd.DataFrame:
    """Width, height and the sum of the grey levels: three numbers for an image, however large."""
    run = lambda image: (image.shape[1], image.shape[0], int(pixels.grey(image).sum(dtype=np.int64)))
    return pd.DataFrame(_each(blobs, run, (None,) * 3), columns=["width", "height", "total"]).astype("Int64")


def _regions(blobs: pd.Series, marks: Callable[[np.ndarray], np.ndarray]) -> pd.DataFrame:
    names = ("x", "y", "width", "height", "area")
    run = lambda image: (image.shape[0] * image.shape[1], [dict(zip(names, map(int, c))) for c in pixels.components(marks(image))])
    return pd.DataFrame(_each(blobs, run, (None, None)), columns=["pixels", "boxes"]).astype(object)


@pandas_udf(REGIONS)
def page_regions(blobs: pd.Series) -> pd.DataFrame:
    """Connected regions of what stands out from a page."""
    return _regions(blobs, pixels.page_marks)


@pandas_udf(REGIONS)
def bright_regions(blobs: pd.Series) -> pd.DataFrame:
    """Connected regions of pixels above 128."""
    return _regions(blobs, lambda image: pixels.grey(image) > 128)


def candidates(regions: Column, *, share: tuple[float, float] = (0.004, 0.70), side: int = 110, aspect: tuple[float, float] = (0.50, 2.20), most: int = 120) -> Column:
    """Boxes of a region struct that may hold a board, the largest first (a limit of the feature), ties by first pixel."""
    total, ratio = regions["pixels"], lambda b: b["width"] / b["height"]
    fits = lambda b: (b["width"] >= side) & (b["height"] >= side) & b["area"].between(total * share[0], total * share[1]) & ratio(b).between(*aspect)
    ranked = F.transform(F.filter(regions["boxes"], fits), lambda b, i: F.struct((-b["width"] * b["height"]).alias("k"), i.alias("i"), b.alias("b")))
    return F.slice(F.transform(F.array_sort(ranked), lambda x: x["b"]), 1, most)


def descriptor_matches(a: Column, b: Column, width: int) -> Column:
    """Struct n, total, clear of two sets of ``width``-byte descriptors: mutual nearest ones, their distances' sum, matches that pass the ratio test.

    Null as soon as one set is."""

    @pandas_udf(of(n=INT, total=LONG, clear=INT))
    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(left, right):
            if x is None or y is None:
                rows.append((None,) * 3)
                continue
            x, y = (np.frombuffer(v, np.uint8).reshape(-1, width) for v in (x, y))
            found = pixels.mutual_matches(x, y)
            rows.append((len(found), int(found[:, 2].sum()), pixels.clear_matches(x, y)))
        return pd.DataFrame(rows, columns=["n", "total", "clear"]).astype("Int64")

    return run(a, b)


def descriptor_scores(a: Column, b: Column, points: Column, matches: Column, width: int) -> Column:
    """Struct orb, akaze of two sets of descriptors, with the least key points and matches that count; 0 where a set is missing."""

    @pandas_udf(of(orb=REAL, akaze=REAL))
    def run(left: pd.Series, right: pd.Series, points: pd.Series, matches: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y, p, m in zip(left, right, points, matches):
            if x is None or y is None:
                rows.append((0.0, 0.0))
                continue
            x, y = (np.frombuffer(v, np.uint8).reshape(-1, width) for v in (x, y))
            rows.append((pixels.mutual_score(x, y, p, m), pixels.clear_score(x, y, p, m)))
        return pd.DataFrame(rows, columns=["orb", "akaze"])

    return run(a, b, points, matches)
