"""Suffix arrays, packing and the link graph."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import components, suffix_dedup, url_filter
from docquarry.llm import textblocks as tb


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400) | st.text("ab", max_size=300).map(str.encode))
def test_suffix_array_and_prefixes(raw):
    s = np.frombuffer(raw, np.uint8)
    n = len(s)
    want = sorted(range(n), key=lambda i: raw[i:])
    got = suffix_dedup.suffix_array(s)
    assert got.tolist() == want

    def common(a, b):
        k = 0
        while k < 50 and a + k < n and b + k < n and raw[a + k] == raw[b + k]:
            k += 1
        return k

    if n:
        assert suffix_dedup.common_prefixes(s, got, 50).tolist() == [0, *(common(a, b) for a, b in zip(want, want[1:]))]


def test_pieces_of_a_shard_are_merged(monkeypatch):
    """One anchor's segments, cut into many pieces, still find each other."""
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 120)
    strings = [b"%02d" % (i % 5) + b"q" * 60 for i in range(40)]
    n = len(strings)
    payloads = [suffix_dedup._closed(np.full(1, 7, np.uint64), np.array([i]), np.array([13]), x) for i, x in enumerate(strings)]
    table = pa.table({"bucket": pa.array([0] * n, pa.int32()), "block": pa.array(range(n), pa.int32()), "payload": pa.array(payloads, pa.binary())})
    out = suffix_dedup._shard((pa.scalar(0),), table).to_pylist()
    assert all(r["payload"][:1] == b"\x80" for r in out)  # a bit for the block's one segment, then those of its windows
    flags = {r["block"]: np.unpackbits(np.frombuffer(r["payload"][1:], np.uint8))[:13].tolist() for r in out}
    # document 0 is the first of all; the first of another kind keeps what starts with its digits
    assert 0 not in flags
    assert flags[1] == flags[4] == [0, 0] + [1] * 11
    assert all(flags[i] == [1] * 13 for i in range(5, n))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing_round_trip(values):
    x = np.sort(np.array(values, np.uint64))
    assert tb.unpack(tb.pack(x)).tolist() == x.tolist()


@given(st.lists(st.text(alphabet="ab \t\nü", max_size=12) | st.none(), max_size=8))
def test_words_are_the_bytes_between_spaces(texts):
    data, off = tb.text_buffers(pa.array(texts, pa.string()))
    starts, ends, doc = tb.word_spans(data, off, tb.SPACE)
    raw = data.tobytes()
    got = [[] for _ in texts]
    for a, b, d in zip(starts, ends, doc):
        got[d].append(raw[a:b])
    assert got == [(t or "").encode().split() for t in texts]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (11, 10), (12, 11), (12, 10), (7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (10, 10), (11, 10), (12, 10)]


def test_url_rules(spark):
    urls = [("https://A.example.ORG/es/1?x=/y", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/15", "example.org", "/en/15", "example.org/en/1", "block"), ("http://x.org/", "x.org", "/", "org/", "allow"), ("http://x.org", "x.org", "", None, "allow"), ("http://notorg/", "notorg", "/", None, "allow"), ("x://b.com/fr/#/de/", "b.com", "/fr/", "com/fr/", "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("://", "", "", None, "allow")]
    df = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = url_filter.judge_pages(df, url_filter.RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [u[1:] for u in urls]
    assert url_filter.judge_pages(df.where("false"), url_filter.RULES).count() == 0


def test_link_graph(spark):
    """Distrust flows back from blocked hosts to those that link to them, trust forward from allowed ones."""
    pages = [(1, "http://good.org/a", '<a href="http://friend.net/x">'), (2, "http://bad.com/de/", ""), (3, "http://farm.net/en", "<a href='https://bad.com/de/'> <a href=//bad.com/q>"), (4, "http://friend.net/", ""), (5, "http://lone.net/", '<a href="/own">')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    edges = {(r.src, r.dst): r.weight for r in url_filter.host_edges(df, "url", "html").collect()}
    assert edges == {("good.org", "friend.net"): 1.0, ("farm.net", "bad.com"): 1.0}
    got = {r.page_id: r for r in url_filter.judge_pages(df, url_filter.RULES).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    assert got[4].trust == pytest.approx(0.85 * 0.15) and got[3].distrust == pytest.approx(0.85 * 0.15)


def test_verdicts_do_not_depend_on_who_else_links(spark):
    """A host that only links to a blocked one is blocked, be it one of 1 or of 1,000; one that does so among 39 other links is not."""
    link = lambda host: f'<a href="http://{host}/">x</a>'
    for farms in (1, 13, 1000):
        pages = [("http://bad.com/de/1", "")] + [(f"http://farm{i}.net/", link("bad.com")) for i in range(farms)]
        pages += [("http://mixed.net/", link("bad.com") + "".join(link(f"plain{i}.net") for i in range(39))), ("http://second.net/", link("farm0.net"))]
        df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
        got = {r.host: r.verdict for r in url_filter.judge_pages(df, url_filter.RULES).collect()}
        assert {v for h, v in got.items() if h.startswith("farm")} == {"block"}
        assert (got["bad.com"], got["mixed.net"], got["second.net"]) == ("block", "allow", "block")


def test_propagation_against_dense_iteration(spark):
    rng = np.random.default_rng(3)
    n = 12
    m = (rng.random((n, n)) < 0.3).astype(float) * rng.integers(1, 4, (n, n))
    np.fill_diagonal(m, 0)
    edges = spark.createDataFrame([(str(i), str(j), float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "src string, dst string, weight double")
    good, bad = rng.random(n), rng.random(n)
    seeds = spark.createDataFrame([(str(i), float(good[i]), float(bad[i])) for i in range(n)], "host string, allowed double, blocked double")

    def run(matrix, seed):
        share = np.divide(matrix, matrix.sum(1, keepdims=True), out=np.zeros_like(matrix), where=matrix.sum(1, keepdims=True) > 0)
        r = s = 0.15 * seed
        for _ in range(5):
            r = s + 0.85 * share.T @ r
        return r

    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(edges, seeds, rounds=5).collect()}
    trust, distrust = run(m, good), run(m.T, bad)
    for i in range(n):
        assert got[str(i)] == pytest.approx((trust[i], distrust[i]))
