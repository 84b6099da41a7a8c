"""Jobs over tables of images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import images, similarity
from docquarry.operators import windows
from docquarry.operators.decisions import decide_pair
from docquarry.plans import materialize

OUT = ["id_a", "id_b", "ssim", "phash", "orb", "akaze", "label", "decision_phase", "reason"]


def similarity_job(rows: DataFrame, *, part: list[str], order: list[str], ident: str, blob: str = "blob", sha256: str = "sha256", k: int = 5, known: DataFrame | None = None, gate: float = 0.85, features: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Labels of each image with its next k of the same part, pairs already known (id_a, id_b, in any order) left out.

    Images are hashed once; only pairs whose hashes pass the gate have their pixels read
    again.  features gives a struct of orb and akaze from both blobs; without it both are
    0, as where no key points are found.  A pair with an image that cannot be read (or a
    null) is LOW_QUALITY.  Ids must be unique; an empty table gives no rows."""
    hashed = materialize.cut(rows.select(*dict.fromkeys([ident, *part, *order]), F.col(sha256).alias("sha"), images.perceptual_hash(blob).alias("h")))
    pairs = windows.canonical_pair(windows.window_pairs(hashed, part, order, ident, k, carry=["sha", "h"]), "id_a", "id_b")
    if known is not None:
        pairs = windows.new_pairs(pairs, known)
    readable, same = F.col("a_h").isNotNull() & F.col("b_h").isNotNull(), F.coalesce(F.col("a_sha") == F.col("b_sha"), F.lit(False))
    pairs = pairs.select("id_a", "id_b", readable.alias("readable"), same.alias("same"), similarity.hash_similarity(F.col("a_h"), F.col("b_h")).alias("p"))
    look = F.col("readable") & ~F.col("same") & (F.col("p") >= gate)
    pictures = lambda x: rows.select(F.col(ident).alias(f"id_{x}"), F.col(blob).alias(f"blob_{x}"))
    near = pairs.where(look).join(pictures("a"), "id_a").join(pictures("b"), "id_b")
    points = features(F.col("blob_a"), F.col("blob_b")) if features else F.struct(F.lit(0.0).alias("orb"), F.lit(0.0).alias("akaze"))
    near = near.withColumn("s", images.structural_similarity("blob_a", "blob_b")).withColumn("f", points).drop("blob_a", "blob_b")
    near = near.select("id_a", "id_b", decide_pair(F.lit(False), F.col("p"), F.col("s"), F.col("f.orb"), F.col("f.akaze"), gate=gate).alias("d"))
    null = F.lit(None).cast("double")
    poor = F.struct(F.lit("LOW_QUALITY").alias("label"), F.lit(2).alias("decision_phase"), F.lit("decode_fail").alias("reason"), *(null.alias(c) for c in ("phash", "ssim", "orb", "akaze")))
    rest = pairs.where(~look).select("id_a", "id_b", F.when(~F.col("readable"), poor).otherwise(decide_pair(F.col("same"), F.col("p"), null, null, null, gate=gate)).alias("d"))
    return near.unionByName(rest).select("id_a", "id_b", "d.*").select(*OUT)


def thumbnails(rows: DataFrame, *, filename: Column, page: Column, packed: Column, blob: str = "blob", side: int = 128) -> DataFrame:
    """name, thumbnail of images that can be read; write them with any sink for binary rows."""
    from docquarry.functions.text import thumbnail_name

    made = rows.select(thumbnail_name(filename, page, packed).alias("name"), images.thumbnail(F.col(blob), F.lit(side)).alias("thumbnail"))
    return made.where("thumbnail is not null")


def candidate_boxes(rows: DataFrame, ident: str, regions: Column, **limits) -> DataFrame:
    """One row for each candidate box: ident, rank, x, y, width, height, area."""
    each = rows.select(ident, regions.alias("regions")).select(ident, F.posexplode(images.candidates(F.col("regions"), **limits)).alias("at", "box"))
    return each.select(ident, (F.col("at") + 1).alias("rank"), "box.*")
