"""Images: PNG, regions, hashes, matching and the jobs over them, against plain versions."""

import json
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from docquarry.functions import images, pixels, similarity
from docquarry.functions import sql as named
from docquarry.functions import text as tx
from docquarry.operators import doctypes, relational
from docquarry.operators import images as jobs
from docquarry.sources import readers

RANDOM = np.random.default_rng(7)


def picture(height, width, *more):
    return RANDOM.integers(0, 256, (height, width, *more), dtype=np.uint8)


def png(raw_rows, width, height, depth, colour, palette=b"", interlaced=0):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)
    return pixels.SIGNATURE + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw_rows)) + chunk(b"IEND", b"")


def filtered(image, kinds):
    """Rows of an image under the PNG filters of the given kinds, in turn."""
    step = 1 if image.ndim == 2 else image.shape[2]
    flat = image.reshape(len(image), -1).astype(int)
    out = b""
    for y, line in enumerate(flat):
        kind, up = kinds[y % len(kinds)], flat[y - 1] if y else np.zeros_like(line)
        left, corner = (np.concatenate([np.zeros(step, int), v[:-step]]) for v in (line, up))
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * line, left, up, (left + up) // 2, near][kind]
        out += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    return out


@pytest.mark.parametrize("shape", [(9, 7), (9, 7, 3), (1, 1), (5, 1, 3)])
def test_png_round_trip_and_filters(shape):
    image = picture(*shape)
    assert (pixels.decode_png(pixels.encode_png(image)) == image).all()
    for kinds in ([0], [1], [2], [3], [4], [4, 3, 1, 2, 0]):
        blob = png(filtered(image, kinds), shape[1], shape[0], 8, 2 if len(shape) == 3 else 0)
        assert (pixels.decode_png(blob) == image).all()


def test_png_kinds():
    bits = png(b"\x00\xa0\x00\x40", 3, 2, 1, 0)
    assert pixels.decode_png(bits).tolist() == [[255, 0, 255], [0, 255, 0]]
    named_colours = png(b"\x00\x01\x00", 2, 1, 8, 3, bytes([1, 2, 3, 4, 5, 6]))
    assert pixels.decode_png(named_colours).tolist() == [[[4, 5, 6], [1, 2, 3]]]
    assert pixels.decode_png(png(b"\x00\x12\x34\xab\xcd", 2, 1, 16, 0)).tolist() == [[0x12, 0xAB]]
    assert pixels.decode_png(png(b"\x00" + bytes([9, 8, 7, 255]), 1, 1, 8, 6)).tolist() == [[[9, 8, 7]]]
    assert pixels.decode_png(png(b"\x00" + bytes([9, 255]), 1, 1, 8, 4)).tolist() == [[9]]


@pytest.mark.parametrize("blob", [None, b"", b"x", pixels.SIGNATURE, png(b"\x00", 2, 2, 8, 0), png(b"\x00" * 6, 2, 2, 8, 0, interlaced=1), png(b"\x09\x01\x02", 2, 1, 8, 0), png(b"", 1 << 30, 1 << 30, 8, 2), png(b"\x00\x05", 1, 1, 8, 3, bytes(3)), pixels.encode_png(picture(9, 9))[:60]])
def test_what_cannot_be_read(blob):
    assert pixels.decode_png(blob) is None


def test_sizes_and_frames():
    image = picture(20, 30)
    for kind in ("bilinear", "lanczos", "area"):
        assert (pixels.resize(np.full((20, 30), 77, np.uint8), 7, 9, kind) == 77).all()
        assert pixels.resize(image, 7, 9, kind).shape == (9, 7)
    assert (pixels.resize(image, 15, 10, "area") == np.rint(image.reshape(10, 2, 15, 2).mean((1, 3)))).all()
    assert pixels.resize(picture(4, 4, 3), 8, 8).shape == (8, 8, 3)
    assert pixels.fitted(image, 15).shape == (10, 15) and pixels.fitted(image, 30) is image
    assert pixels.framed(image).shape == (70, 80) and pixels.framed(image)[0, 0] == 255
    assert pixels.crop(image, 28, 18, 5, 5, 1).shape == (3, 3) and pixels.crop(image, 40, 0, 5, 5) is None
    assert pixels.network_input(image).shape == (1, 128, 128, 3) and pixels.network_input(image).max() <= 1
    assert pixels.grey(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], np.uint8)).tolist() == [[76, 150, 29, 9]]


def test_marks():
    image = picture(40, 40)
    levels = range(256)
    apart = [0.0 if not 0 < (image <= t).sum() < image.size else (image <= t).sum() * (image > t).sum() * (image[image <= t].mean() - image[image > t].mean()) ** 2 for t in levels]
    assert pixels.otsu(image) == int(np.argmax(apart))
    marks = np.zeros((30, 30), bool)
    marks[15, 15] = True
    assert pixels.dilated(marks, 5).sum() == 25 and (pixels.closed(marks) == marks).all()
    marks[15, 20] = True
    assert pixels.closed(marks)[15, 15:21].all()
    page = np.full((200, 200), 250, np.uint8)
    page[40:42, 40:160] = page[158:160, 40:160] = page[40:160, 40:42] = page[40:160, 158:160] = 0
    (box,) = pixels.components(pixels.page_marks(page))
    assert abs(box[:4] - [40, 40, 120, 120]).max() <= 2
    assert pixels.blurred(np.full((1, 5), 9, np.uint8)).tolist() == [[9] * 5]


def plain_components(marks):
    left, out = set(zip(*np.nonzero(marks))), []
    while left:
        todo, region = [min(left)], []
        left.discard(todo[0])
        while todo:
            y, x = todo.pop()
            region.append((y, x))
            for near in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if near in left:
                    left.discard(near)
                    todo.append(near)
        ys, xs = zip(*region)
        out.append([min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(region)])
    return out


@pytest.mark.parametrize("share", [0.0, 0.1, 0.3, 0.45, 0.7, 1.0])
def test_components(share):
    for shape in ((1, 1), (1, 40), (40, 1), (30, 37)):
        marks = RANDOM.random(shape) < share
        assert pixels.components(marks).tolist() == plain_components(marks)


def test_hash_and_matches():
    image = picture(64, 64)
    small = pixels.resize(image, 32, 32, "lanczos").astype(float)
    low = [sum(small[y, x] * np.cos(np.pi * v * (2 * y + 1) / 64) * np.cos(np.pi * u * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8) for u in range(8)]
    want = "".join("1" if v > np.median(low) else "0" for v in low)
    assert f"{pixels.perceptual_hash(image) & (1 << 64) - 1:064b}" == want
    a, b = RANDOM.integers(0, 256, (30, 4), dtype=np.uint8), RANDOM.integers(0, 256, (25, 4), dtype=np.uint8)
    d = [[sum((int(x) ^ int(y)).bit_count() for x, y in zip(r, s)) for s in b] for r in a]
    assert pixels.distances(a, b).tolist() == d
    there, back = [r.index(min(r)) for r in d], [min(range(30), key=lambda i: (d[i][j], i)) for j in range(25)]
    mutual = [[i, j, d[i][j]] for i, j in enumerate(there) if back[j] == i]
    assert pixels.mutual_matches(a, b).tolist() == mutual
    assert pixels.clear_matches(a, b) == sum(sorted(r)[0] < 0.75 * sorted(r)[1] for r in d)
    best = sorted(m[2] for m in mutual)
    assert pixels.mutual_score(a, b, 8, 4) == pytest.approx(1 - np.mean(best[: max(4, int(len(best) * 0.15))]) / 100)
    assert pixels.mutual_score(a, b, 26, 4) == pixels.mutual_score(a, b, 8, 31) == 0
    assert pixels.clear_score(a, a, 8, 4) == 1.0 and pixels.clear_score(a, b, 26, 4) == 0
    none = a[:0]
    assert pixels.mutual_score(none, b, 0, 0) == pixels.clear_score(none, none, 0, 0) == pixels.clear_matches(a, b[:1]) == 0


def test_features(spark):
    flat, mixed = np.full((10, 11), 3, np.uint8), np.array([[[1, 2, 9]] * 3 + [[200, 0, 0]]], np.uint8)
    tall = picture(4, 1, 3)
    blobs = [pixels.encode_png(x) for x in (flat, mixed, tall)] + [b"x", None]
    got = [r.f for r in spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, blob binary").orderBy("i").select(images.features(F.col("blob")).alias("f")).collect()]
    assert tuple(got[0]) == (11, 10, 1.1, 1, 1, None)
    assert tuple(got[1]) == (4, 1, 4.0, 0, 0, json.dumps([[[1, 2, 9], 0.75], [[200, 0, 0], 0.25]]))
    seen = Counter(map(tuple, tall[:, 0].tolist())).most_common(5)
    assert got[2].top_colors == json.dumps([[list(c), round(n / 4, 4)] for c, n in seen])
    assert got[3] is None and got[4] is None


def test_json_of_shares(spark):
    shares = [1.0, 0.5, 0.0001, 0.1234, 0.0, 0.35]
    rows = spark.createDataFrame([([(1, 2, 3, s) for s in shares],), ([],)], "c array<struct<r:int,g:int,b:int,ratio:double>>")
    assert sorted(r.j for r in rows.select(images.colours_json(F.col("c")).alias("j")).collect()) == sorted([json.dumps([[[1, 2, 3], s] for s in shares]), "[]"])


def plain_job(rows, known, k):
    """Labels by the rules, pair by pair."""
    out, done = {}, {tuple(sorted(p)) for p in known}
    decoded = {i: pixels.decode_png(b) for i, _, b, _ in rows}
    for group in {r[1] for r in rows}:
        members = sorted((r for r in rows if r[1] == group), key=lambda r: r[0])
        for at, a in enumerate(members):
            for b in members[at + 1 : at + 1 + k]:
                if (a[0], b[0]) in done:
                    continue
                x, y = decoded[a[0]], decoded[b[0]]
                if x is None or y is None:
                    out[a[0], b[0]] = ("LOW_QUALITY", 2, "decode_fail", None, None)
                    continue
                p = 1 - ((pixels.perceptual_hash(x) ^ pixels.perceptual_hash(y)) & (1 << 64) - 1).bit_count() / 64
                s = similarity.ssim(pixels.compared(x), pixels.compared(y))
                if a[3] is not None and a[3] == b[3]:
                    found = ("EXACT_DUPLICATE", 1, "sha256", None, None)
                elif p < 0.85:
                    found = ("NOT_SIMILAR", 2, "phash_low", p, None)
                elif s >= 0.92:
                    found = ("NEAR_DUPLICATE", 3, "phash+ssim", p, s)
                elif s < 0.5:
                    found = ("NOT_SIMILAR", 3, "ssim_too_low_for_override", p, s)
                elif s < 0.85 and p >= 0.9:
                    found = ("SIMILAR_THEME", 4, "phash_override_low_ssim", p, s)
                elif s < 0.85:
                    found = ("NOT_SIMILAR", 3, "phash+ssim_low", p, s)
                else:
                    found = ("SIMILAR", 4, "ssim_high_feature_low", p, s) if s >= 0.9 else ("NOT_SIMILAR", 4, "ssim_feature_low", p, s)
                out[a[0], b[0]] = found
    return out


def test_similarity_job(spark):
    base = pixels.resize(picture(6, 6), 48, 40)
    noisy = lambda by: np.clip(base.astype(int) + RANDOM.integers(-by, by + 1, base.shape), 0, 255).astype(np.uint8)
    shown = [base, base, noisy(3), noisy(40), noisy(90), 255 - base, pixels.resize(base, 30, 33), picture(40, 48), np.dstack([base] * 3), picture(3, 3), noisy(60), noisy(20)]
    rows = [(i, i % 2, pixels.encode_png(x), "s" if i in (0, 2) else f"s{i}") for i, x in enumerate(shown)]
    rows += [(20, 0, b"x", "q"), (21, 1, None, None), (22, 1, pixels.encode_png(base), None), (23, 1, pixels.encode_png(base), None)]
    known = [(4, 2), (1, 3)]
    table = spark.createDataFrame(rows, "id int, file int, blob binary, sha256 string").withColumn("h", F.lit("mine")).withColumn("p", F.lit(1))
    got = jobs.similarity_job(table, part=["file"], order=["id"], ident="id", k=5, known=spark.createDataFrame(known, "id_a int, id_b int"))
    assert got.columns == jobs.OUT
    have = {(r.id_a, r.id_b): r for r in got.collect()}
    want = plain_job(rows, known, 5)
    assert set(have) == set(want) and len({w[0] for w in want.values()}) >= 4
    for pair, (label, phase, reason, p, s) in want.items():
        r = have[pair]
        assert (r.label, r.decision_phase, r.reason) == (label, phase, reason)
        assert r.phash == (None if p is None else pytest.approx(p)) and r.ssim == (None if s is None else pytest.approx(s))
    assert jobs.similarity_job(table.limit(0), part=["file"], order=["id"], ident="id").collect() == []


def test_descriptor_scores(spark):
    a, b = (RANDOM.integers(0, 256, (n, 32), dtype=np.uint8) for n in (40, 50))
    b[:30] = a[:30]
    rows = spark.createDataFrame([(a.tobytes(), b.tobytes()), (a.tobytes(), None)], "a binary, b binary")
    points, matches = similarity.feature_thresholds(F.lit(200))
    got = rows.select(images.descriptor_scores(F.col("a"), F.col("b"), points, matches, 32).alias("s"), images.descriptor_matches(F.col("a"), F.col("b"), 32).alias("m")).collect()
    assert tuple(got[0].s) == pytest.approx((pixels.mutual_score(a, b, 20, 10), pixels.clear_score(a, b, 20, 10))) and got[0].s.orb == 1.0
    assert tuple(got[1].s) == (0.0, 0.0) and got[1].m.n is None


def test_thumbnails_and_named_functions(spark):
    rows = spark.createDataFrame([("a.pdf", 3, pixels.encode_png(picture(300, 200, 3))), ("b.pdf", 1, b"x")], "file string, page int, blob binary")
    (only,) = jobs.thumbnails(rows, filename=F.col("file"), page=F.col("page"), packed=F.lit(2001)).collect()
    assert only.name == "a_p3_2_1.png" and pixels.decode_png(only.thumbnail).shape == (128, 85, 3)
    named.register(spark)
    marks = np.zeros((6, 6), np.uint8)
    marks[1:3, 1:4] = marks[5, 5] = 255
    spark.createDataFrame([(pixels.encode_png(marks),), (None,)], "blob binary").createOrReplaceTempView("named_pictures")
    boxes = spark.sql("SELECT r.* FROM named_pictures, LATERAL image_regions(blob) r").collect()
    assert sorted(map(tuple, boxes)) == [(1, 1, 3, 2, 6), (5, 5, 1, 1, 1)]
    row = spark.sql("SELECT indel_ratio('abc', 'abd') i, hash_similarity(7L, 0L) h, hash_similarity(NULL, 0L) n, page_of_rank(25, 24) p, clamp_share(1.5D) c").first()
    assert tuple(row) == (pytest.approx(2 / 3), 1 - 3 / 64, 0.0, 2, 1.0)


def test_image_files(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(pixels.encode_png(picture(5, 4, 3)))
    (tmp_path / "b.png").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(pixels.encode_png(picture(5, 4, 3)))
    (only,) = readers.image_files(spark, str(tmp_path)).collect()
    assert only.path.endswith("a.PNG") and (only.width, only.height, len(only.data)) == (4, 5, 60)


def test_counters_and_times(spark):
    rows = spark.range(10).withColumn("parent", F.when(F.col("id") > 0, F.col("id") % 3))
    assert {tuple(r) for r in relational.child_counts(rows, "parent", above=2, below=4).collect()} == {(0, 3), (1, 3), (2, 3)}
    assert tuple(relational.run_counters(rows.limit(0), done=F.col("id") > 1).first()) == (0,)
    seen = Observation("run")
    relational.observed(rows, seen, done=F.col("id") > 1, left=F.col("parent").isNull()).collect()
    assert seen.get == {"done": 8, "left": 1}
    row = spark.range(1).select(tx.now().alias("a"), tx.now_seconds().alias("b"), F.unix_timestamp(tx.now()).alias("c")).first()
    assert row.b == row.c


def test_saved_model(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"{word} {word} text{i % 3}", word) for i, word in enumerate(["rook", "queen", "invoice"] * 6)], "id int, text string, label string")
    model, _ = doctypes.train(rows, model="logistic")
    doctypes.save(model, str(tmp_path / "m"))
    asked = spark.createDataFrame([(1, "rook rook"), (2, "invoice"), (3, " "), (4, None)], "id int, text string")
    got = doctypes.predict_types(doctypes.load(str(tmp_path / "m")), asked, "id").collect()
    assert {(r.id, r.doc_type) for r in got} == {(1, "rook"), (2, "invoice")}


def test_totals_come_as_numbers(spark):
    """The sum of the grey levels leaves Python, not the levels."""
    image = picture(30, 20, 3)
    row = spark.createDataFrame([(pixels.encode_png(image),), (b"x",)], "blob binary").select(images.grey_totals("blob").alias("t")).collect()
    assert tuple(row[0].t) == (image.shape[1], image.shape[0], int(pixels.grey(image).sum(dtype="int64")))
    assert row[1].t.width is None and row[1].t.total is None


def test_crops_send_no_arrays(spark, tmp_path):
    from docquarry.plans import catalogue

    spark.createDataFrame([(9, "a", [0.1] * 64)], "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    query = catalogue.QUERIES["image_crops"](spark, str(tmp_path))
    assert "grey_levels" not in query._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in query.collect()] == [(9, 55, 54, 100 * 20 + 255 * (55 * 54 - 20))]
