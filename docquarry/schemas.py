"""Spark schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "file_index": "file_id BIGINT, filename STRING, path STRING, sha256 STRING, doc_type STRING",
    "text_lines": "line_id BIGINT, file_id BIGINT, page_no INT, line_no INT, text STRING, length INT",
    "text_similarity": "line_id_a BIGINT, line_id_b BIGINT, lev_ratio DOUBLE, jaro DOUBLE, dice DOUBLE, tfidf_cosine DOUBLE, jaccard_tokens DOUBLE, avg_score DOUBLE, passed_threshold INT",
    "pdf_images": "image_id BIGINT, file_id BIGINT, page_no INT, image_index INT, xref INT, rect_i INT, sha256 STRING, sha256_raw STRING, blob BINARY",
    "image_features": "image_id BIGINT, width INT, height INT, aspect_ratio DOUBLE, is_square INT, is_grayscale INT, top_colors ARRAY<STRUCT<rgb: ARRAY<INT>, ratio: DOUBLE>>, is_chessboard INT, chessboard_score DOUBLE, has_person INT, person_score DOUBLE, has_logo INT, logo_score DOUBLE, has_game_notation INT, game_notation_score DOUBLE, predicted_label STRING, predicted_confidence DOUBLE",
    "image_similarity": "image_id_a BIGINT, image_id_b BIGINT, ssim DOUBLE, phash DOUBLE, orb DOUBLE, akaze DOUBLE, label STRING, decision_phase INT, reason STRING",
    "binary_similarity": "file_id_a BIGINT, file_id_b BIGINT, similarity_ratio DOUBLE, longest_match_size INT",
    "ocr_extracts": "image_id BIGINT, text_raw STRING",
    "notation_ocr": "image_id BIGINT, roi_type STRING, raw_text STRING, normalized_text STRING, filtered_text STRING, created_at TIMESTAMP",
    "entities_raw": "line_id BIGINT, ent_text STRING, ent_type STRING, norm_text STRING",
    "persons": "person_id BIGINT, norm_name STRING",
    "person_mentions": "person_id BIGINT, line_id BIGINT, raw_name STRING",
    "chess_fen": "image_id BIGINT, fen_format STRING, created_at TIMESTAMP, model_version STRING, preprocess_version STRING",
    "chess_fen_multi": "image_id BIGINT, board_index INT, fen_format STRING",
    "final_boards": "image_id BIGINT, board_index INT, source STRING, clf_score DOUBLE, w INT, h INT, blob_png BINARY, created_at BIGINT",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def migrate(df: DataFrame, table: str) -> DataFrame:
    """df with the table's missing columns added as nulls; columns it has keep their place, further ones stay."""
    missing = [f for f in schema(table) if f.name not in df.columns]
    return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in missing))


def missing_columns(df: DataFrame, table: str) -> list[str]:
    return [f.name for f in schema(table) if f.name not in df.columns]
