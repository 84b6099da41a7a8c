"""Registered queries: SQL where there is some, plain versions elsewhere, and the pipeline's stages."""

import brute
import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def queries():
    import __spark_entry__ as entry

    return entry.queries()


@pytest.mark.parametrize("name", ["op3_lm_score", "op4_jaccard_join", "op5_substring_index", "op8_mixing"])
def test_sql(spark, queries, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = queries[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[c] for c in columns)) for r in rows)


def test_pii(spark, queries, documents):
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in queries["op2_pii"](spark, SF).collect()}
    for i, text in documents:
        spans = brute.base_spans(text)
        kinds = [x.split(":")[0] for x in spans]
        assert got[i] == (*(kinds.count(k) for k in ("email", "ip", "card", "phone")), brute.sha(",".join(spans)))


def test_bytes(spark, queries, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries["op6_suffix_dedup"](spark, SF).collect()}
    assert got == brute.repeated_bytes(documents)


def test_decontamination(spark, queries, documents):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries["op7_decontaminate"](spark, SF).collect()}
    assert got == brute.hits(documents, items)


def test_quality(spark, queries, documents):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in queries["op9_fertility"](spark, SF).collect()}
    assert got == {i: brute.base_counts(t) for i, t in documents}


def test_token_counts(spark, queries, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in queries["op10_token_counts"](spark, SF).collect()}
    counts = [len(x) for x in tok.encode_batch([t for _, t in documents], add_special_tokens=False)]
    assert got == {i: (n, n > 2048) for (i, _), n in zip(documents, counts)}


def test_urls(spark, queries):
    got = queries["op1_url_filter"](spark, SF).collect()
    urls = dict(duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall())
    rules = [("example.org/en/1", "block"), ("example.org/es/", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow")]
    assert len(got) == len(urls)
    for r in got:
        rest = urls[r.page_id].split("://", 1)[1]
        host = rest.split("?")[0].split("#")[0].split("/")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        hit = next(((k, v) for k, v in rules if (f".{host}").endswith("." + k.split("/")[0]) and path.startswith("/" + k.split("/", 1)[1])), (None, None))
        assert (r.host, r.path, r.rule) == (host, path, hit[0])
        assert hit[1] in (None, r.verdict)


def test_pipeline_stages(spark):
    """Each stage against its plain version on what its predecessor kept."""
    import corpus_pipeline
    from docquarry.llm import checkpoints

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = checkpoints.table(stage(spark, docs, SF))
        seen[name] = (before, docs.collect())
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda rows: sorted(r.doc_id for r in rows)
    before, after = seen["quality"]
    assert ids(after) == ids(r for r in before if not brute.base_counts(r.text)[5])
    before, after = seen["near_duplicates"]
    assert ids(after) == sorted(i for i, (_, c) in brute.near([(r.doc_id, r.text) for r in before]).items() if i == c)
    before, after = seen["decontamination"]
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    hits = brute.hits([(r.doc_id, r.text) for r in before], items)
    assert ids(after) == sorted(i for i, h in hits.items() if not h[4])
    assert not [i for i, h in brute.hits([(r.doc_id, r.text) for r in after], items).items() if h[1]]
    clean = {r.doc_id: r.text for r in before if not hits[r.doc_id][1]}
    assert {r.doc_id: r.text for r in after if r.doc_id in clean} == clean
    before, after = seen["pii"]
    assert ids(after) == ids(before)
    assert not [r for r in after if brute.base_spans(r.text)]
    clean = {r.doc_id: r.text for r in before if not brute.base_spans(r.text)}
    assert {r.doc_id: r.text for r in after if r.doc_id in clean} == clean
    before, after = seen["mixing"]
    assert set(ids(after)) <= set(ids(before)) and {r.copy for r in after} >= {1}
