"""Pairs of lines in tiles: blocks of several chunks, against the functions of single pairs."""

import itertools
import random
from collections import Counter

import pytest

from docquarry.functions import similarity
from docquarry.operators import lines
from docquarry.plans import catalogue


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Lines of one block, some of them in many documents: norm by line_id, and the folder of the documents."""
    draw = random.Random(5)
    kinds = ["ab" + "".join(draw.choices("abc dé", k=draw.randint(66, 76))) + "x" for _ in range(23)]
    kinds = [k for k in dict.fromkeys(" ".join(k.split()) for k in kinds)]
    rows = [(i, kinds[i] if i < len(kinds) else kinds[i % 3]) for i in range(len(kinds) + 17)]
    path = str(tmp_path_factory.mktemp("tiles"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return {i * 10**9 + 10**6 + 1: t for i, t in rows}, path


def candidates(rows):
    near = lambda a, b: len(a) // 10 == len(b) // 10 and a[:2] == b[:2]
    return [(i, j) for i, j in itertools.combinations(sorted(rows), 2) if near(rows[i], rows[j])]


def dice(a, b):
    return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


def jaccard(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y)


PLAIN = {"char_dice_pairs": dice, "indel_ratio_pairs": similarity.indel, "jaro_winkler_pairs": similarity.winkler, "token_jaccard_pairs": jaccard}


@pytest.mark.parametrize("name", PLAIN)
def test_scores_of_several_chunks(spark, texts, monkeypatch, name):
    """A block is dealt to tiles of two chunks at most; no single task has all its pairs."""
    monkeypatch.setattr(lines, "CHUNK", 4)
    rows, path = texts
    reps = {}
    for i in sorted(rows):
        reps.setdefault(rows[i], i)
    norm = {i: t for t, i in reps.items()}
    got = catalogue.QUERIES[name](spark, path).collect()
    assert {tuple(r)[:2]: r[2] for r in got} == {(i, j): pytest.approx(PLAIN[name](norm[i], norm[j]), abs=1e-6) for i, j in candidates(norm)}
    assert len(got) == len(candidates(norm)) > 100


def test_cosine_of_several_chunks(spark, texts, monkeypatch):
    """Pairs are never shuffled with their terms: the same values as by a join on terms."""
    monkeypatch.setattr(lines, "CHUNK", 4)
    rows, path = texts
    df = spark.createDataFrame(list(rows.items()), "line_id long, norm string")
    norm = {r.rep: r.norm for r in lines.distinct_texts(df).collect()}
    pairs = spark.createDataFrame(candidates(norm), "rep_a long, rep_b long")
    want = {(r.rep_a, r.rep_b): pytest.approx(r.tfidf_cosine, abs=1e-6) for r in lines.cosine(pairs, lines.tfidf(df)).collect()}
    query = catalogue.QUERIES["tfidf_cosine_pairs"](spark, path)
    assert {(r.rep_a, r.rep_b): r.tfidf_cosine for r in query.collect()} == want
    assert "Join" not in query._jdf.queryExecution().optimizedPlan().toString()


def test_similarity_of_several_chunks(spark, texts, monkeypatch):
    """Every pair of lines once, those of one text too."""
    monkeypatch.setattr(lines, "CHUNK", 4)
    rows, path = texts
    got = {(r.line_id_a, r.line_id_b): r for r in catalogue.QUERIES["text_similarity_avg"](spark, path).collect()}
    assert set(got) == set(candidates(rows))
    for (i, j), r in got.items():
        a, b = (rows[k] for k in sorted((i, j), key=lambda k: min(x for x in rows if rows[x] == rows[k])))
        assert [r.lev_ratio, r.jaro, r.dice, r.jaccard_tokens] == pytest.approx([similarity.indel(a, b), similarity.winkler(a, b), dice(a, b), jaccard(a, b)], abs=1e-6)
        assert a != b or r.tfidf_cosine == 1


def test_blocked_pairs_of_several_chunks(spark, texts, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK", 4)
    rows, path = texts
    got = catalogue.QUERIES["blocked_pairs"](spark, path).collect()
    assert sorted(map(tuple, got)) == candidates(rows)


def test_terms_move_twice(spark):
    """Weights are normalised in one window over a text's terms: one join with the document frequencies, one with the total."""
    rows = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "b c")], "line_id long, norm string")
    found = lines.tfidf(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    sums = Counter()
    for r in found.collect():
        sums[r.rep] += r.weight**2
    assert sums == {1: pytest.approx(1), 2: pytest.approx(1)}
