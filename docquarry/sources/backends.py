"""Hooks for what needs a library outside Spark: PDF and image decoding, detectors, networks, OCR.

A backend is a function that is registered by name; operators that need one raise
BackendMissing when it is not there.  Each runs in mapInPandas, once loaded for each
Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

NAMES = ["pdf_lines", "pdf_images", "decode_image", "resize_image", "encode_png", "canny_edges", "contours", "chessboard_corners", "warp_board", "orb_similarity", "akaze_similarity", "person_detector", "board_detector", "chessboard_network", "piece_network", "ocr", "entity_model"]
_found: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


class BackendMissing(RuntimeError):
    pass


def register(name: str, run: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
    if name not in NAMES:
        raise ValueError(f"no such backend: {name}")
    _found[name] = run


def apply(df: DataFrame, name: str, schema: str) -> DataFrame:
    """df through a backend, batch by batch."""
    if name not in _found:
        raise BackendMissing(f"{name}: backend not installed")
    run = _found[name]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(run, frames)

    return df.mapInPandas(batches, schema)
