"""Hand-computed values of single operators."""

import pytest
from pyspark.sql import functions as F

from docquarry import schemas
from docquarry.functions import chess, persons, similarity
from docquarry.functions import text as tx
from docquarry.operators import decisions, dml, doctypes, fen, lines, relational, windows
from docquarry.plans import catalogue
from docquarry.sources import backends, readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "indel", "dice", "jaccard", "jw"),
    [
        ("kitten", "sitting", 0.615385, 0.615385, 0.0, 0.746032),
        ("night", "nacht", 0.6, 0.6, 0.0, 0.76),
        ("MARTHA", "MARHTA", 0.833333, 1.0, 0.0, 0.961111),
        ("aab", "abb", 0.666667, 0.666667, 0.0, 0.8),
        ("the quick brown fox", "the quick brown dog", 0.894737, 0.894737, 0.6, 0.957895),
    ],
)
def test_pair_scores(spark, a, b, indel, dice, jaccard, jw):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    row = df.select(similarity.indel_ratio("a", "b"), similarity.char_dice(F.col("a"), F.col("b")), similarity.token_jaccard(F.col("a"), F.col("b")), similarity.jaro_winkler("a", "b")).first()
    assert [round(x, 6) for x in row] == [indel, dice, jaccard, jw]


def test_tfidf_cosine(spark):
    texts = ["the quick brown fox jumps", "the quick brown fox leaps", "an entirely different line"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_id long, norm string")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 0)], "rep_a long, rep_b long")
    got = {(r.rep_a, r.rep_b): round(r.tfidf_cosine, 6) for r in lines.cosine(pairs, lines.tfidf(rows)).collect()}
    assert got == {(0, 1): 0.669356, (0, 2): 0.0, (0, 0): 1.0}


@pytest.mark.parametrize(("raw", "want"), [("  Straße\tİSTANBUL ", "strasse istanbul"), ("ﬁle  ＡＢＣ", "file abc")])
def test_normalize_text(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(tx.normalize_text("t")).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [("Prof. Dr. AHMET İNCE.", "ahmet ince"), ("  «Garry   Kasparov»,", "garry kasparov"), ("Dr. Ali", "ali")])
def test_normalize_name(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert list(df.select(tx.normalize_name(F.col("t")), tx.normalize_name_exact("t")).first()) == [want, want]


@pytest.mark.parametrize(("raw", "want"), [("Magnus Carlsen", True), ("White King", False), ("Boğaziçi Üniversitesi", False), ("PDF SQL", False), ("Black 93", False), ("Dr. Ali", False), ("J Smith", False), ("", False)])
def test_valid_person(spark, raw, want):
    assert one(spark, persons.is_valid_person(F.lit(raw))) is want


@pytest.mark.parametrize(("raw", "want"), [("ab", True), ("Chess 101", False), ("#@~^ab", True), ("a#b~c@", True)])
def test_garbage(spark, raw, want):
    assert one(spark, tx.is_garbage(F.lit(raw))) is want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 4. Ba4 Nf6 5. O-O Be7", (5, 10, 2, 20.0, 1, 0.6667)),
        ("1. e4 e5", (1, 2, 1, 4.9, 0, 0.0)),
        ("hello", (0, 0, 0, 0.0, 0, 0.0)),
    ],
)
def test_game_notation(spark, raw, want):
    assert tuple(one(spark, chess.notation_signal(F.lit(raw)))) == want


def test_notation_line(spark):
    assert one(spark, chess.notation_line(F.lit("1.e4 e5"))) == "1. e4 e5"


def test_fen(spark):
    start = list("rnbqkbnr" + "p" * 8) + [""] * 32 + list("P" * 8 + "RNBQKBNR")
    diagonal = ["K" if i % 9 == 0 else "" for i in range(64)]
    assert one(spark, fen.encode(F.array(*map(F.lit, start)))) == "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR"
    assert one(spark, fen.encode(F.array(*map(F.lit, diagonal)))) == "K7/1K6/2K5/3K4/4K3/5K2/6K1/7K"


@pytest.mark.parametrize(
    ("same", "p", "s", "o", "k", "want"),
    [
        (True, None, None, None, None, ("EXACT_DUPLICATE", 1, "sha256")),
        (False, 0.8, None, None, None, ("NOT_SIMILAR", 2, "phash_low")),
        (False, 0.85, 0.92, None, None, ("NEAR_DUPLICATE", 3, "phash+ssim")),
        (False, 0.95, 0.49, None, None, ("NOT_SIMILAR", 3, "ssim_too_low_for_override")),
        (False, 0.9, 0.5, 0.1, 0.1, ("SIMILAR_THEME", 4, "phash_override_low_ssim")),
        (False, 0.9, 0.8, 0.15, 0.1, ("SIMILAR_THEME", 4, "phash_override+orb")),
        (False, 0.89, 0.84, None, None, ("NOT_SIMILAR", 3, "phash+ssim_low")),
        (False, 0.86, 0.85, 0.1, 0.15, ("NEAR_DUPLICATE", 4, "ssim+akaze")),
        (False, 0.86, 0.9, 0.1, 0.1, ("SIMILAR", 4, "ssim_high_feature_low")),
        (False, 0.86, 0.89, 0.0, 0.0, ("NOT_SIMILAR", 4, "ssim_feature_low")),
    ],
)
def test_decide_pair(spark, same, p, s, o, k, want):
    number = lambda x: F.lit(x).cast("double")
    assert tuple(one(spark, decisions.decide_pair(F.lit(same), number(p), number(s), number(o), number(k)))[:3]) == want


def test_choose_label_golden(spark):
    # image, person, score, logo, score, person area, logo area, label, confidence
    rows = [(1, 1, 0.8414, 0, 0.2915, 0.6712, 0.0338, "person", 0.8414), (2, 1, 0.8838, 0, 0.2288, 0.1589, 0.1793, "unknown", 0.0), (3, 0, 0.0, 1, 0.65, 0.0, 0.4816, "unknown", 0.0), (9, 0, 0.0, 1, 0.71, 0.0, 0.4667, "logo", 0.71), (38, 0, 0.0, 1, 0.95, 0.0, 0.1023, "logo", 0.95), (182, 1, 0.4675, 0, 0.1859, 0.9797, 0.4386, "unknown", 0.0), (188, 0, 0.0, 1, 0.7, 0.0, 0.9726, "logo", 0.7)]
    df = spark.createDataFrame([r[:7] for r in rows], "i int, person int, ps double, logo int, ls double, pa double, la double")
    zero = F.lit(0)
    got = df.select("i", decisions.choose_label(F.col("person"), F.col("ps"), F.col("logo"), F.col("ls"), zero, F.lit(0.0), F.col("pa"), F.col("la"), zero).alias("x"), F.col("la")).collect()
    assert {r.i: tuple(r.x) for r in got} == {r[0]: r[7:] for r in rows}


def test_blocking_and_windows(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 29), (2, 1, "a" * 30), (3, 2, "a" * 39)], "line_id long, file_id long, norm string")
    assert [tuple(r) for r in lines.blocked_pairs(rows).collect()] == [(2, 3)]
    assert lines.blocked_pairs(rows, other_file=False).count() == 0
    many = spark.range(100).withColumn("f", F.lit(1))
    assert windows.window_pairs(many, ["f"], [], "id").count() == 485


def test_gap_clusters(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 5, 11, 20, 26, 40)], "p int, v int")
    assert sorted(r["median"] for r in windows.gap_clusters(df, ["p"], "v", 6).collect()) == [5, 23, 40]


@pytest.mark.parametrize(("total", "want"), [(0, (1, 0, 1)), (50, (3, 48, 3))])
def test_paging(spark, total, want):
    assert tuple(spark.range(1).select(*relational.paging(F.lit(total), F.lit(9), 24)).first()) == want


def test_line_numbers_count_dropped_lines(spark):
    text = "short\n" + "x" * 20 + "\r\n" + "y" * 301 + "\n  spaced   out\ttext of a line  "
    got = lines.text_lines(spark.createDataFrame([(7, text)], "doc_id long, text string")).select("line_no", "text").collect()
    assert [tuple(r) for r in got] == [(2, "x" * 20), (4, "spaced out text of a line")]


def test_table_changes_can_be_repeated(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    source = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (3, "e", 2)], "k int, v string, n int")
    once = dml.insert_if_absent(target, source, ["k"], ["n"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, dml.insert_if_absent(once, source, ["k"], ["n"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    last = dml.upsert_last(target, source, ["k"], [F.col("n")])
    assert sorted(map(tuple, last.collect())) == [(1, "a"), (2, "c"), (3, "e")]
    again = dml.replace_partition(target, source.select("k", "v"), "k")
    assert sorted(map(tuple, dml.replace_partition(again, source.select("k", "v"), "k").collect())) == sorted(map(tuple, again.collect()))


def test_global_numbers(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("v")).repartition(7)
    got = dml.numbered_globally(df, ["v"], "n").collect()
    assert all(r.n == r.v + 1 for r in got) and len(got) == 1000


def test_split_policy():
    assert [decisions.split_policy(*x) for x in ((2, 2), (10, 1), (3, 3), (10, 2), (100, 2))] == [0, 0, 0, 2, 20]


def test_ssim_of_equal_and_negative():
    import numpy as np

    a = np.arange(256).reshape(16, 16)
    assert similarity.ssim(a, a) == pytest.approx(1.0)
    assert similarity.ssim(a, 255 - a) == pytest.approx(1.0)
    assert similarity.ssim(a[:5], a[:5]) == 0.0


def test_missing_backend(spark):
    with pytest.raises(backends.BackendMissing):
        backends.apply(spark.range(1), "ocr", "id long")


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"abc")
    (tmp_path / "in" / "b.txt").write_bytes(b"no")
    assert [r.filename for r in readers.documents(spark, str(tmp_path / "in")).collect()] == ["a.pdf"]
    (tmp_path / "rows.csv").write_text('text,label\n"two\nlines",x\n  ,y\n')
    assert [tuple(r) for r in readers.text_label_csv(spark, str(tmp_path / "rows.csv")).collect()] == [("two\nlines", "x")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.text_label_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "classes.json").write_text('{"Black_Bishop": 0, "White_King": 8}')
    assert sorted(map(tuple, readers.class_names(spark, str(tmp_path / "classes.json")).collect())) == [(0, "Black_Bishop"), (8, "White_King")]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "file_id int, text string")
    writers.replace_files(df, str(tmp_path / "t"))
    writers.replace_files(df.where("file_id = 2").withColumn("text", F.lit("c")), str(tmp_path / "t"))
    assert sorted((r.file_id, r.text) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "c")]


def test_stream_adds_only_new(spark, tmp_path):
    from docquarry.streaming.ingest import ingest

    source, table, state = (str(tmp_path / x) for x in ("source", "table", "state"))
    for part in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(part, "k int, v string").coalesce(1).write.mode("append").parquet(source)
        ingest(spark, source, "k int, v string", table, state, ["k"], ["v"]).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_schemas(spark):
    empty = spark.createDataFrame([], "image_id long, width int")
    assert set(schemas.schema("image_features").names) <= set(schemas.migrate(empty, "image_features").columns)
    assert "label" in schemas.missing_columns(empty, "image_similarity")


def test_entry_point_without_llm():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "text_similarity_avg" in entry.queries()


def test_document_types_know_all_terms_of_whole_texts(spark, tmp_path):
    """More terms than 65,536, and labels told by what stands after 100,000 characters."""
    own = [" ".join(f"w{i}x{j}" for j in range(900)) for i in range(60)]
    assert sum(len(set(x.split())) * 2 - 1 for x in own) > 1 << 16
    pad = "same " * 20_001
    rows = [(pad + own[i] + (" alpha" if i % 2 else " beta") * 5, "a" if i % 2 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string")
    fitted = doctypes.pipeline("logistic").fit(df.withColumnRenamed("lang", "label"))
    assert len(fitted.stages[3].vocabulary) > 1 << 16
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["doc_classifier"](spark, str(tmp_path)).collect()
    names = {r.prediction: r.label for r in sorted(got, key=lambda r: r.n)}
    assert len(got) == len(names) == 2 and set(names.values()) == {"a", "b"}


def test_opening_moves_with_captures_and_ranks(spark):
    """Moves that the start position allows, with a stray capture mark, rank or file; others are none."""
    from docquarry.functions import chess

    legal = ["e4", "exe4", "e2xe4", "2e4", "xe4", "a3+", "Nxf3", "Ngxf3", "Nf3#", "N1c3", "Nb1xa3"]
    other = ["dxe4", "d2e4", "e5", "Nd2", "Ngxc3", "Nbxf3", "e24", "O-O", "Bc4"]
    df = spark.createDataFrame([(x,) for x in legal + other], "move string")
    assert {r.move for r in df.where(chess.opens_a_game(F.col("move"))).collect()} == set(legal)


def test_garbage_strips_all_white_space(spark):
    from docquarry.functions import text as tx

    rows = [("\nab\n", True), ("  ab　", True), ("\tabc\x1f", False), ("a_|b", True), ("a b c", False), (None, True), ("", True)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert df.where(tx.is_garbage(F.col("t")) != F.col("want")).count() == 0


def test_lines_meet(spark):
    from docquarry.functions import geometry

    lit = lambda *x: tuple(F.lit(float(v)) for v in x)
    row = spark.range(1).select(
        geometry.intersection(lit(0, 0, 4, 4), lit(0, 4, 4, 0)).alias("p"),
        geometry.intersection(lit(0, 0, 1, 1), lit(0, 1, 1, 2)).alias("q"),
        geometry.angle(*lit(0, 0, -1, 1)).alias("a"),
        geometry.angle(*lit(3, 0, 0, 0)).alias("b"),
        geometry.length(*lit(0, 0, 3, 4)).alias("n"),
        geometry.corners(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((9, 8), (1, 9), (0, 0), (8, 1))))).alias("c"),
    ).first()
    assert (row.p.x, row.p.y) == (2.0, 2.0) and row.q.x != row.q.x and (row.a, row.b, row.n) == (135.0, 0.0, 5.0)
    assert [tuple(row.c[k]) for k in ("top_left", "top_right", "bottom_right", "bottom_left")] == [(0, 0), (8, 1), (9, 8), (1, 9)]
