"""Decision cascades as Column expressions: first rule that holds wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decide_pair(same: Column, p: Column, s: Column, orb: Column, akaze: Column, *, gate=0.85, very_high=0.90, near=0.92, mid=0.85, cut=0.90, feature=0.15) -> Column:
    """Struct label, decision_phase, reason and the scores that were reached (the others null)."""
    has_o, has_a = orb >= feature, akaze >= feature

    def features(stem: str, none: str) -> Column:
        return F.when(has_o & has_a, f"{stem}+orb+akaze").when(has_o, f"{stem}+orb").when(has_a, f"{stem}+akaze").otherwise(none)

    def out(label: str, phase: int, reason, depth: int) -> Column:
        shown = lambda c, level: c if depth >= level else F.lit(None).cast("double")
        return F.struct(
            F.lit(label).alias("label"), F.lit(phase).alias("decision_phase"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
            shown(p, 1).alias("phash"), shown(s, 2).alias("ssim"), shown(orb, 3).alias("orb"), shown(akaze, 3).alias("akaze"),
        )

    return (
        F.when(same, out("EXACT_DUPLICATE", 1, "sha256", 0))
        .when(p < gate, out("NOT_SIMILAR", 2, "phash_low", 1))
        .when(s >= near, out("NEAR_DUPLICATE", 3, "phash+ssim", 2))
        .when(s < 0.50, out("NOT_SIMILAR", 3, "ssim_too_low_for_override", 2))
        .when((s < mid) & (p >= very_high), out("SIMILAR_THEME", 4, features("phash_override", "phash_override_low_ssim"), 3))
        .when(s < mid, out("NOT_SIMILAR", 3, "phash+ssim_low", 2))
        .when(has_o | has_a, out("NEAR_DUPLICATE", 4, features("ssim", ""), 3))
        .when(s >= cut, out("SIMILAR", 4, "ssim_high_feature_low", 3))
        .otherwise(out("NOT_SIMILAR", 4, "ssim_feature_low", 3))
    )


def person_dominant(person: Column, score: Column, area: Column, text_len: Column) -> Column:
    return (person == 1) & (score >= 0.55) & (area >= 0.18) & (text_len < 80)


def logo_dominant(logo: Column, score: Column, area: Column, text_len: Column, person: Column, person_area: Column) -> Column:
    return (
        F.when(logo != 1, False)
        .when((score >= 0.75) & (area >= 0.25), True)
        .when(score < 0.68, False)
        .when(area < 0.015, False)
        .when(area > 0.50, True)
        .when((text_len >= 80) & (area < 0.15), False)
        .when((person == 1) & (person_area >= 0.15), False)
        .otherwise(True)
    )


def choose_label(person, p_score, logo, l_score, game, g_score, person_area, logo_area, text_len) -> Column:
    """Struct label, confidence."""
    out = lambda label, score: F.struct(F.lit(label).alias("label"), score.alias("confidence"))
    p_dom = person_dominant(person, p_score, person_area, text_len)
    l_dom = logo_dominant(logo, l_score, logo_area, text_len, person, person_area)
    return F.when((game == 1) & (g_score >= 0.45), out("game_notation", g_score)).when(p_dom & (p_score >= l_score), out("person", p_score)).when(l_dom & (l_score > p_score), out("logo", l_score)).otherwise(out("unknown", F.lit(0.0)))


def logo_score(edge, color, entropy, large, medium, compact, components, width, height, text_len, density, person, p_score, rect_area, rect_centered, rect_tall) -> Column:
    """Heuristic logo score from image figures: bands that add, then conditions that shrink, clamped and rounded to 4."""
    band = lambda x, a, b, y, c, d, z: F.when((x > a) & (x < b), y).when((x > c) & (x < d), z).otherwise(0.0)
    aspect = width / height
    total = (
        F.when((edge > 0.01) & (edge < 0.12), 0.22).when((edge >= 0.12) & (edge < 0.18), 0.10).otherwise(0.0)
        + F.when(color < 0.12, 0.18).when(color < 0.20, 0.08).otherwise(0.0)
        + band(entropy, 2.3, 5.2, 0.18, 2.0, 5.8, 0.08)
        + F.when(large.between(1, 8), 0.14).when(medium.between(1, 15), 0.06).otherwise(0.0)
        + band(compact, 0.015, 0.35, 0.12, 0.01, 0.45, 0.05)
        + F.when(components.between(2, 18), 0.11).when(components.between(1, 28), 0.05).otherwise(0.0)
        + F.when(aspect.between(0.6, 3.2), 0.05).otherwise(0.0)
    )
    total = total * F.when((text_len >= 80) & (density > 0.55), 0.45).when((text_len >= 35) & (density > 0.45), 0.70).otherwise(1.0)
    total = total * F.when((person == 1) & (p_score >= 0.40), 0.55).otherwise(1.0) * F.when(height > 1.35 * width, 0.65).otherwise(1.0)
    total = total * F.when(rect_centered & rect_tall & (rect_area > 0.18) & (rect_area < 0.70), 0.65).otherwise(1.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


LOGO_FLAG, CHESSBOARD_FLAG, CROP_FLAG, CONTOUR_FLAG = 0.62, 0.65, 0.50, 0.65


def flag(score: Column, least: float) -> Column:
    """1, 0, or null for a null score."""
    return (score >= least).cast("int")


def classifier_score(output: Column) -> Column:
    """Of a model's output row: the only value, or the second of several."""
    return F.when(F.size(output) >= 2, F.get(output, F.lit(1))).otherwise(F.get(output, F.lit(0)))


def near_full_page(x0, y0, x1, y1, width, height) -> Column:
    """A crop that covers most of its page with small margins and a squarish shape; boxes include their last pixel."""
    w, h = x1 - x0 + 1, y1 - y0 + 1
    margins = (x0 / width <= 0.08) & (y0 / height <= 0.08) & ((width - 1 - x1) / width <= 0.08) & ((height - 1 - y1) / height <= 0.08)
    return (w * h / (width * height) >= 0.55) & margins & (w / h).between(0.80, 1.25)


def is_grayscale(pixels: Column) -> Column:
    """Whether no pixel's channels differ by more than 3."""
    far = lambda a, b: F.abs(a - b) > 3
    return ~F.exists(pixels, lambda p: far(p[0], p[1]) | far(p[1], p[2]) | far(p[0], p[2]))


def ocr_mode(width: Column, height: Column) -> Column:
    """skip, line (wide images) or page."""
    return F.when((width < 20) | (height < 10), "skip").when(width > 4 * height, "line").otherwise("page")


def split_policy(n: int, classes: int) -> int:
    """Documents held out for a test of n labelled ones in some classes; 0 for none."""
    if n < 3 or classes < 2:
        return 0
    held = max(classes, -(-n // 5))
    return 0 if held >= n else held
