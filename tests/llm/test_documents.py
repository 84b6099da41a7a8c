"""Operators on documents against their plain versions, with odd rows, clashing names and empty tables."""

import math
import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from docquarry.llm import decontaminate, fertility, jaccard_join, lm_score, mixing, pii, substring_index, suffix_dedup, token_counts

TOKENIZERS = pytest.importorskip("public_tokenizers")
NULL_ID = (None, "a text without an id, of more than a few words so that all rules see it")


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


@pytest.fixture(scope="module")
def with_null(spark, docs):
    extra = spark.createDataFrame([NULL_ID], "doc_id long, text string")
    return docs.unionByName(extra, allowMissingColumns=True)


def test_token_counts(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = TOKENIZERS.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    special = [(100, "<|endoftext|>a, <|ENDOFTEXT|> b<|startoftext|>"), (101, "don't I'LL 'S x,y. 1,2. a\u0301 \u0301b"), (102, None)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(special, "doc_id long, text string"))
    got = by_id(token_counts.token_counts(df, path, limit=100), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = {}
    for i, t in [*rows, *special]:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[i] = (len((t or "").encode()), n, n > 100)
    assert got == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_counts_of_a_piece_model(docs, rows):
    import sentencepiece

    path = TOKENIZERS.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(token_counts.token_counts(docs, path), "doc_id", "n_tokens")
    assert got == {i: (len(model.encode(t or "")),) for i, t in rows}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_cut_texts(monkeypatch, rows, name):
    """Texts in many pieces have the tokens of the whole, for all vocabularies."""
    import numpy as np

    monkeypatch.setattr(token_counts, "PIECE_BYTES", 40)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 300)
    path = TOKENIZERS.path(name)
    encode, _, cuts = token_counts._encoder(path)
    assert cuts == {"w": "words", "b": "before", "p": "without"}[name[0]]
    texts = [t or "" for _, t in rows] + ["a  b 1 2 x\u00a0y <|endoftext|> z  " * 30, "don't we'll I'm o'clock 3rd x1 y2 ... a " * 30, "no\nspace\tbetween " * 20, "\u00e9 a b\u0301 c " * 40]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    assert token_counts.block_counts(path, data, off).tolist() == encode(texts)


def test_quality_base_counts(docs, rows, empty):
    path = TOKENIZERS.path("piece_bpe_32k.model")
    got = by_id(fertility.quality(docs, path), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.base_counts(t) for i, t in rows}
    kept = fertility.keep_good(docs, path)
    assert kept.columns == docs.columns
    verdict = by_id(fertility.quality(docs, path), "doc_id", "kept")
    assert {r.doc_id for r in kept.collect()} == {i for i, (k,) in verdict.items() if k}
    assert fertility.quality(empty, path).count() == 0 and fertility.keep_good(empty, path).count() == 0


def test_quality_bands_reject_noise(spark):
    path = TOKENIZERS.path("piece_bpe_32k.model")
    noise = " ".join("\u0e01\u0e02" * 3 for _ in range(40))
    plain = "It was a bright cold day in April, and the clocks were striking thirteen while people went home. " * 1
    df = spark.createDataFrame([(1, noise, "en"), (2, plain, "en")], "doc_id long, text string, lang string")
    got = by_id(fertility.quality(df, path), "doc_id", "in_band")
    assert got == {1: (False,), 2: (True,)}


def test_quality_bands_reject_planted_junk(spark):
    """Gibberish, base64, mojibake, symbols and another script go; prose, a table of it and short identifiers within it stay."""
    import base64
    import random

    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(4, 10)))
    cyrillic = "это был яркий холодный апрельский день часы пробили тринадцать люди шли домой после долгой работы".split()
    prose = {
        "en": "It was a bright cold day in April, and the clocks were striking thirteen while people went home to read the news.",
        "fr": "La petite ville était calme ce matin, et les enfants allaient à l'école pendant que leurs parents ouvraient les magasins.",
        "de": "Am frühen Morgen gingen die Kinder in die Schule, während ihre Eltern die kleinen Läden der alten Stadt öffneten.",
        "es": "La pequeña ciudad estaba tranquila esta mañana, y los niños iban a la escuela mientras sus padres abrían las tiendas.",
    }
    junk = []
    for lang in prose:
        junk += [(lang, " ".join(word("bcdfghjklmnpqrstvwxz") for _ in range(60))), (lang, " ".join(base64.b64encode(rng.randbytes(45)).decode() for _ in range(12)))]
        junk += [(lang, " ".join(word("#*$%&|<>{}[]^~@!") for _ in range(60))), (lang, " ".join(rng.choice(cyrillic) for _ in range(60)))]
        junk.append((lang, " ".join(word("éèàùçêôîœëï").encode().decode("latin1") for _ in range(60))))
    junk += [(lang, " ".join(word("abcdefghijklmnopqrstuvwxyz") for _ in range(200))) for lang in ("en", "de")]
    good = list(prose.items()) + [("en", prose["en"].replace(" ", " | ")), ("en", prose["en"] + " Call +1 (551) 555-0826 or 10.20.30.40.")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate([*good, *junk])], "doc_id long, lang string, text string")
    got = by_id(fertility.quality(df, TOKENIZERS.path("piece_bpe_32k.model")), "doc_id", "in_band")
    assert [got[i][0] for i in range(len(got))] == [True] * len(good) + [False] * len(junk)


def test_near_duplicates(docs, rows, empty):
    got = by_id(jaccard_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert got == brute.near(rows)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_cut_passages(spark, docs, empty):
    """What is hit goes, contaminated documents go, clashing columns stay."""
    item = " ".join(f"q{i}" for i in range(30))
    other = " ".join(f"own{i}" for i in range(800))
    text = f"{other} {item.upper()}, {other} é; q0 q1. {item} end"
    df = spark.createDataFrame([(1, text, "h"), (2, item, "h"), (3, other, None), (4, None, None), (5, "", None)], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([("a", item), ("b", None), ("c", "")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.keep_clean(df, bench).collect()}
    assert sorted(got) == [1, 3, 4, 5] and got[1].hits == "h"
    assert got[1].text == f"{other} , {other} é; q0 q1.  end" and (got[3].text, got[4].text, got[5].text) == (other, None, "")
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontaminate.keep_clean(empty, bench).count() == 0


def test_repeating_pieces_and_shared_letters(monkeypatch):
    """Periodic items, pieces of many items and letters that stand for several words give the hits of their windows."""
    import random

    rng = random.Random(3)
    for letters in (1_000_000, 3):
        monkeypatch.setattr(decontaminate, "_LETTERS", letters)
        items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.choice([1, 5, 7, 12, 13, 14, 20, 40])))) for i in range(12)]
        docs = [(i, " ".join(rng.choice("abcd") for _ in range(60)) + " " + rng.choice(items)[1]) for i in range(60)]
        machine = decontaminate.Machine(items)
        want = brute.hits(docs, items)
        for i, text in docs:
            n, runs = machine.scan(text.encode())
            hit = {w for a, b, _ in runs for w in range(a, b)}
            assert (n, len(hit), len({k for _, _, k in runs})) == want[i][:3]


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Groups that meet in chunks, one partner at a time, lose no link."""
    import random

    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "NEAREST", 1)
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", 12)
    rng = random.Random(5)
    seeds = [[f"s{k}w{i}" for i in range(70)] for k in range(3)]
    rows = []
    for i in range(120):
        w = list(seeds[i % 3])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(70)] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join([*w, *seeds[0][:20]] if i % 2 else w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert by_id(jaccard_join.near_duplicates(df), "doc_id", "n_shingles", "component_id") == brute.near(rows)


def test_near_duplicates_keep_one(spark, docs, rows, with_null):
    twice = with_null.unionByName(docs.where("doc_id = 8"))
    kept = jaccard_join.keep_firsts(twice)
    assert kept.columns == docs.columns
    want = sorted(i for i, (_, c) in brute.near(rows).items() if i == c)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert kept.where("doc_id is null").count() == 1


def test_signatures_share_one(spark):
    """Random pairs at the threshold share a signature, at all sizes."""
    import numpy as np

    rng = np.random.default_rng(7)
    for size in [*range(1, 40), 100, 333, 1000]:
        for _ in range(5):
            both = max(1, -(-8 * size // 10))
            a_only = (size - both + 1) // 2
            b_only = both * 10 // 8 - both - a_only
            values = rng.integers(0, 1 << 63, both + a_only + max(0, b_only), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a = np.sort(values[: both + a_only])
            b = np.sort(np.r_[values[:both], values[both + a_only :]])
            assert 10 * both >= 8 * len(values)
            sig, which = jaccard_join.signatures(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
            assert set(sig[which == 0].tolist()) & set(sig[which == 1].tolist()), size


def test_repeated_windows(with_null, rows, empty):
    got = by_id(substring_index.dedup_substrings(with_null, batches=1), "doc_id", "n_words", "n_removed", "kept_sha256")
    null = got.pop(None)
    assert null == (len(brute.words(NULL_ID[1])), 0, brute.sha(" ".join(brute.words(NULL_ID[1]))))
    assert got == brute.repeated_windows(sorted(rows))
    assert by_id(substring_index.dedup_substrings(with_null, batches=3), "doc_id", "n_words", "n_removed", "kept_sha256") == got | {None: null}
    assert substring_index.dedup_substrings(empty).count() == 0


def test_index_over_many_batches_is_compacted(spark, docs, rows):
    index = substring_index.FingerprintIndex(spark, fanout=1, block_bytes=4000)
    got = {}
    ordered = sorted(i for i, _ in rows)
    for k in range(4):
        part = docs.where(F.col("doc_id").isin(ordered[k::4]))
        got |= by_id(index.add(part).withColumn("s", F.sha2("kept", 256)), "id", "n_words", "n_removed", "s")
        index.compact()
    assert [level for level, _ in index.runs] == [2]
    texts = dict(rows)
    want = brute.repeated_windows([(i, texts[i]) for k in range(4) for i in ordered[k::4]])
    assert got == {i: w for i, w in want.items() if texts[i]}
    index.drop()


def test_repeated_windows_are_found_through_compacted_runs(spark, monkeypatch):
    """By default the last batch reads runs that were merged, and misses repeats without them."""
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(24)]
    rows = [(i, f"own{i} {passages[i]} {passages[i // 2]} end{i}") for i in range(24)] + [(i, " ".join([f"late{i}", *passages])) for i in (24, 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substring_index, "BROADCAST_HOLDERS", 0)
    add, compact, seen = substring_index.FingerprintIndex.add, substring_index.FingerprintIndex.compact, []

    def watched(self, *args, **options):
        seen.append([level for level, _ in self.runs])
        return add(self, *args, **options)

    def forgetful(self):
        compact(self)
        self.runs = [run for run in self.runs if run[0] == 0]

    monkeypatch.setattr(substring_index.FingerprintIndex, "add", watched)
    want = brute.repeated_windows(rows)
    assert by_id(substring_index.dedup_substrings(df), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert seen[-1] == [1]
    monkeypatch.setattr(substring_index.FingerprintIndex, "compact", forgetful)
    lost = by_id(substring_index.dedup_substrings(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert {i for i in want if lost[i] != want[i]} & {24, 25}


def test_repeated_bytes(with_null, rows, empty):
    got = by_id(suffix_dedup.dedup_bytes(with_null), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got.pop(None) == (len(NULL_ID[1]), 0, 0, brute.sha(NULL_ID[1]))
    assert got == brute.repeated_bytes(rows)
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_repeated_bytes_of_long_periodic_texts(spark):
    """Segments of more than 65,535 windows, and of more windows than 16 bits of frame hold, beside others of their shards."""
    plain = [" ".join(f"p{k}w{j * 7 % 31}" for j in range(40)) for k in range(20)]
    texts = ["And " * 50, "And " * 17_500, "own words And " + "And " * 150_000, "-" * 70_000, "=" * 300 + "-" * 80_000]
    texts += [f"{k} begins {p} ends" for k, p in enumerate(plain)] + [f"other {k}: {p} and {plain[-1 - k]}" for k, p in enumerate(plain)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert by_id(suffix_dedup.dedup_bytes(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeated_bytes(rows)


def test_decontamination(spark, docs, rows, empty, monkeypatch):
    items = [(1, " ".join(f"Word{i}" for i in range(5, 25))), (2, "three FOUR, five!"), (3, ""), (4, None), (10, "three four five"), (5, "日本語"), (None, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.hits(rows, [x for x in items if x[0] is not None])
    columns = ("doc_id", F.col("_hits.n_words"), decontaminate.n_hit("_hits"), F.size("_hits.items"), F.sha2(F.array_join("_hits.items", ","), 256), decontaminate.contaminated("_hits"))
    plain = docs.select("doc_id", "text")
    got = by_id(decontaminate.hit_words(plain, bench).withColumnRenamed("hits", "_hits"), *columns)
    assert got == want
    # items in many small automata give the same
    monkeypatch.setattr(decontaminate, "BLOCK_ITEM_BYTES", 20)
    assert by_id(decontaminate.hit_words(plain, bench).withColumnRenamed("hits", "_hits"), *columns) == want
    assert decontaminate.hit_words(plain, bench.where("false")).where("size(hits.items) > 0").count() == 0
    assert decontaminate.hit_words(empty.select("doc_id", "text"), bench).count() == 0


def test_decontamination_spans():
    text = "An OLD, Word5 word6 here"
    machine = decontaminate.Machine([("1", "old word5")])
    _, hits = machine.scan(text.encode())
    assert [text[a:b] for a, b in decontaminate.original_spans(text, hits)] == ["OLD, Word5"]


def test_pii(spark, docs, rows, empty):
    got = {r.doc_id: r for r in pii.find_pii(docs, keep=["doc_id"]).select("doc_id", pii.digest(F.col("base")).alias("base"), F.size("found").alias("found")).collect()}
    assert {i: r.base for i, r in got.items()} == {i: ",".join(brute.base_spans(t)) for i, t in rows}
    assert pii.find_pii(empty, keep=["doc_id"]).count() == 0


def test_pii_patterns_find_unseen_identifiers(spark):
    seeds = [(i, f"please phone: +4930{i}555{i}66 today") for i in range(10, 16)]
    more = [(50, "please phone: 030 5551 2345 today"), (51, "the year 2020 1999 1987 was good"), (52, None)]
    df = spark.createDataFrame([*seeds, *more], "doc_id long, text string")
    found = {r.doc_id: [x.kind for x in r.found] for r in pii.find_pii(df).collect()}
    assert found[50] == ["phone"] and found[51] == [] and found[52] == []
    red = by_id(pii.redact_pii(df), "doc_id", "text")
    assert red[50] == ("please phone: <phone> today",) and red[10] == ("please phone: <phone> today",) and red[52] == (None,)


def test_mixing(spark, docs, empty):
    weights = {"a": 2.0, "b": 1.0}
    got = mixing.mix_sources(docs.drop("copy"), weights)
    assert got.where("source is null").count() == 0
    assert [r.shuffle_key for r in got.collect()] == sorted(r.shuffle_key for r in got.collect())
    assert mixing.mix_sources(docs).columns == [*(c if c != "copy" else "copy_in" for c in docs.columns), "copy", "shuffle_key"]
    assert mixing.mix_sources(empty).count() == 0
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix_sources(many).groupBy("source").count().collect()}
    assert abs(n["small"] - 20_000) < 700 and abs(n["large"] - 20_000) < 700
    counts = {r["n"]: r["count"] for r in mixing.mix_sources(many).where("source = 'small'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").count().collect()}
    assert max(counts) >= 10  # a Poisson mean of 5 has its tail


def test_mixing_large_rate(spark):
    df = spark.createDataFrame([(i, "one" if i else "rare") for i in range(400)], "doc_id long, source string")
    n = mixing.mix_sources(df).where("source = 'rare'").count()
    assert 140 <= n <= 260


def plain_backoff(rows, order):
    """Scores with each document's own counts taken off, n-gram by n-gram."""
    texts = {i: (text or "").split() for i, text in rows}
    count = lambda words: Counter(tuple(words[i : i + m]) for m in range(1, order + 1) for i in range(len(words) - m + 1))
    own = {i: count(w) for i, w in texts.items()}
    total, n = sum(own.values(), Counter()), sum(map(len, texts.values()))
    out = {}
    for i, words in texts.items():
        left, rest, score, kinds = total - own[i], max(1, n - len(words)), 0.0, Counter()
        for at in range(len(words)):
            share, longest = 1.0, min(order, at + 1)
            for m in range(longest, 0, -1):
                gram = tuple(words[at + 1 - m : at + 1])
                if left[gram]:
                    share *= left[gram] / (left[gram[:-1]] if m > 1 else rest)
                    break
                share *= lm_score.BACKOFF
            else:
                m, share = 0, share / rest
            kinds[m] += 1
            score += math.log10(share)
        out[i] = (len(words), [kinds[m] for m in range(order + 1)], score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_of_any_order(spark, order):
    words = random.Random(5)
    rows = [(i, " ".join(words.choice("a b c d e".split()) for _ in range(words.choice([0, 1, 2, 3, 40])))) for i in range(60)] + [(60, None), (61, "zz"), (62, "a b zz zz a b c")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("mine")).withColumn("n_words", F.lit("mine"))
    got = {r.doc_id: r for r in lm_score.backoff_scores(table, order=order).collect()}
    names = ["n_unseen", "n_unigram", "n_bigram", "n_3gram", "n_4gram"][: order + 1]
    want = plain_backoff(rows, order)
    assert set(got) == set(want)
    for i, (n, kinds, score) in want.items():
        assert (got[i].n_words, [got[i][c] for c in names]) == (n, kinds)
        assert got[i].score == pytest.approx(score, abs=1e-8)
        assert got[i].mean_score == (pytest.approx(score / n) if n else None)


def test_scores_need_an_order(docs):
    with pytest.raises(ValueError):
        lm_score.backoff_scores(docs, order=0)


def test_index_is_opened_again(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(30))
    batches = [spark.createDataFrame([(b * 10 + i, f"{passage} own{b}{i} " if i == 0 else f"only{b}{i} text") for i in range(3)], "doc_id long, text string") for b in range(5)]
    path, seen = str(tmp_path / "index"), None
    for number, batch in enumerate(batches):
        index = substring_index.FingerprintIndex(spark, path, history=seen, fanout=1, block_bytes=1000)
        got = {r.id: r.n_removed for r in index.add(batch).collect()}
        index.compact()
        assert got[number * 10] == (30 if number else 0) and sum(got.values()) == got[number * 10]
        seen = batch if seen is None else seen.unionByName(batch)
    assert max(level for level, _ in index.runs) >= 2
    assert len([f for f in (tmp_path / "index").iterdir() if f.name.startswith("manifest-")]) == 1
    assert {f.name for f in (tmp_path / "index").iterdir() if f.name.startswith("run-")} == {folder.rsplit("/", 1)[1] for _, folder in index.runs}
    with pytest.raises(ValueError):
        substring_index.FingerprintIndex(spark, path)
    index.drop()
    assert not (tmp_path / "index").exists()


def test_scores_fall_on_what_nobody_else_says(spark, docs, empty):
    got = {r.doc_id: r for r in lm_score.backoff_scores(docs).collect()}
    assert got[10].n_words == got[11].n_words == got[12].n_words == 0 and got[11].mean_score is None
    assert got[3].n_bigram > 250  # a copy vouches for it
    assert got[14].n_unseen == 1 and got[14].n_bigram == 0
    assert lm_score.backoff_scores(empty).count() == 0


def test_pii_among_clashing_columns(spark, docs, empty):
    odd = docs.select("doc_id", "text", *(F.lit(n).alias(n) for n in ("base", "loose", "found", "row", "_row", "_key", "t", "digit", "at", "email", "c0", "c1")))
    got = {r.doc_id: r for r in pii.redact_pii(odd).collect()}
    assert pii.redact_pii(odd).columns == odd.columns
    assert all(r.base == "base" and r.c0 == "c0" and r.row == "row" for r in got.values())
    assert got[20].text.startswith("mail me at <email> or call <phone> now") and got[11].text is None and got[10].text == ""
    assert pii.find_pii(odd, keep=["doc_id", "base"]).columns == ["doc_id", "base", "base", "found"]
    assert pii.redact_pii(empty).count() == 0


def test_pii_of_a_very_long_text(spark):
    """40,000 matches in seconds: the work does not grow with their square."""
    import time

    text = " ".join(f"tel +49 30 {i:06d}5" + (" é" if i % 3 else "") for i in range(40_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = pii.find_pii(df, keep=["doc_id"]).select(pii.digest(F.col("base")).alias("d")).first().d
    assert got == ",".join(brute.base_spans(text))
    assert "+49" not in pii.redact_pii(df).first().text and time.time() - began < 60


def test_pii_method_spans(spark):
    """New spans against a plain version of the graph."""
    import random

    rng = random.Random(11)
    number = lambda: " ".join(str(rng.randrange(100, 9999)) for _ in range(3))
    heads = ["please call", "fax no", "my phone:", "order id", "room", "ring (me)"]
    rows = []
    for i in range(160):
        head = rng.choice(heads)
        plus = "+" if rng.random() < (0.8 if head in heads[:3] else 0.1) else ""
        rows.append((i, f"Text {i}: {head} {plus}{number()} {rng.choice(['today', 'soon', 'or'])} and {rng.choice(heads)} {number()}."))
    rows += [(900, None), (901, ""), (902, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: sorted((x.s, x.e, x.kind) for x in r.found) for r in pii.find_pii(df).collect()}
    want = brute.found_spans(rows, pii.LOOSE, pii.ROUNDS, pii.ACCEPT, pii.LEAST_SEEDS)
    assert got == want and 0 < sum(map(len, want.values())) < 2 * len(rows)


def test_mixing_among_clashing_columns_and_ties(spark, docs):
    odd = docs.select("doc_id", "source", "text", *(F.lit(n).alias(n) for n in ("_parts", "_n", "_source", "_cumulative", "parts", "n", "cumulative", "weight", "n_docs", "c0", "shuffle_key")))
    twice = odd.unionByName(odd.withColumn("text", F.lit("another text of the same id")))
    once = mixing.mix_sources(twice).collect()
    assert mixing.mix_sources(odd).columns == [*odd.columns[:-1], "shuffle_key_in", "copy", "shuffle_key"]
    assert once == mixing.mix_sources(twice.repartition(5)).collect() and once[0]._parts == "_parts"
