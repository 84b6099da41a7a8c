"""The functions of this package by name, for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docquarry.functions import images, pixels, similarity

#: Functions that run in Arrow batches.
PYTHON = {
    "indel_ratio": similarity.indel_ratio,
    "jaro_winkler": similarity.jaro_winkler,
    "grid_ssim": similarity.grid_ssim,
    "image_hash": images.perceptual_hash,
    "image_ssim": images.structural_similarity,
    "image_thumbnail": images.thumbnail,
    "image_crop": images.cropped,
    "image_thresholds": images.thresholds,
}
#: Functions that are SQL themselves: arguments, type, body.
INLINED = {
    "hash_similarity": ("a BIGINT, b BIGINT", "DOUBLE", "coalesce(1 - bit_count(a ^ b) / 64D, 0D)"),
    "clamp_share": ("x DOUBLE", "DOUBLE", "greatest(0D, least(1D, x))"),
    "pack_index": ("image BIGINT, rect BIGINT", "BIGINT", "image * 1000 + rect"),
    "page_of_rank": ("rank BIGINT, size BIGINT", "BIGINT", "(rank - 1) div size + 1"),
}


@udtf(returnType=images.BOX)
class ImageRegions:
    """Connected regions of pixels above 128 of one image, as rows; none for what cannot be read."""

    def eval(self, blob: bytes):
        image = pixels.decode_png(blob)
        if image is not None:
            yield from (tuple(map(int, box)) for box in pixels.components(pixels.grey(image) > 128))


def register(spark: SparkSession) -> None:
    """Make all of them known to the session, in place of what had their names."""
    for name, function in PYTHON.items():
        spark.udf.register(name, function)
    for name, (arguments, result, body) in INLINED.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udtf.register("image_regions", ImageRegions)
