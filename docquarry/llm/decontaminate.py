"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Items and documents are normalised alike (A-Z lower-cased, words of letters,
digits and non-ASCII characters).  The letters of the automaton are words.  Its
patterns are pieces of 7 item words, of which every window of 13 has one in full
(a shorter item is its own window and piece); a piece that a document has is
followed in both directions, so that memory grows with the items, not with their
windows.  Each document is scanned once, and hits are mapped back to words and to
code-point spans of the original text.

The automaton lives in each Python worker and its items are broadcast, so their
size is checked: beyond ``BLOCK_ITEM_BYTES`` of item text the documents pass one
block of items after another, each pass written to the checkpoint folder, and the
hits add up to the same result.

Defined cases: null texts have no words; null, empty or wordless items have no
windows and hit nothing; items with a null id are left out; repeated items count
once by id; repeated document rows each get their result; an empty benchmark
leaves every document clean; columns other than the named ones are carried along
unread, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import checkpoints
from docquarry.llm import textblocks as tb

WINDOW = 13
#: Item bytes in one automaton (about 30 bytes of memory for each).
BLOCK_ITEM_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(0x20 if tb.NON_ALNUM[b] else b for b in tb.LOWER.tolist())
_built: dict[str, object] = {}
#: Letters of the automaton: with more words than that one stands for several, and runs are told by their words.
_LETTERS = 1_000_000


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


class Machine:
    """One automaton over all items, whose letters are words.

    Its patterns are the items' pieces of ``piece`` words, one after another: any window
    has one of them in full, so a document word run that equals a window is found from a
    piece and told by going on in both directions.  Its size is that of the items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        import ahocorasick

        self.window, piece = window, (window + 1) // 2
        self.letter: dict[bytes, str] = {}
        self.words = [words_of((text or "").encode()) for _, text in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for number, words in enumerate(self.words):
            text = "".join([self.letter.setdefault(w, chr(1 + len(self.letter) % _LETTERS)) for w in words])
            if 0 < len(text) < window:
                found.setdefault(text, []).append((number, 0))
            for at in range(0, len(text) - piece + 1 if len(text) >= window else 0, piece):
                found.setdefault(text[at : at + piece], []).append((number, at))
        self.tree = ahocorasick.Automaton()
        for key, places in found.items():
            self.tree.add_word(key, (len(key), places))
        if found:
            self.tree.make_automaton()
        self.empty = not found

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """(number of words, runs of words equal to windows as (first word, end word, item number)) of a text."""
        words = words_of(raw)
        if self.empty or not words:
            return len(words), []
        letter = self.letter.get
        text = "".join([letter(w, "\0") for w in words])
        hits, done = [], {}
        for end, (size, places) in self.tree.iter(text):
            first = end - size + 1
            for number, at in places:
                item, shift = self.words[number], first - at
                # a run goes on along one diagonal, and is followed once
                if done.get((number, shift), 0) > first or words[first : end + 1] != item[at : at + size]:
                    continue
                a, b = first, end + 1
                while a > max(0, shift) and words[a - 1] == item[a - 1 - shift]:
                    a -= 1
                while b < min(len(words), len(item) + shift) and words[b] == item[b - shift]:
                    b += 1
                done[number, shift] = b
                if b - a >= min(self.window, len(item)):
                    hits.append((a, b, number))
        return len(words), hits


def _machine(token: str, items, window: int) -> Machine:
    if token not in _built:
        _built.clear()
        _built[token] = Machine(items, window)
    return _built[token]


def original_spans(text: str, hits) -> list[tuple[int, int]]:
    """Code-point spans, merged where they overlap, of word hits in the text as it was."""
    places = [m.span() for m in _WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    out: list[tuple[int, int]] = []
    for a, b in sorted({(places[f][0], places[e - 1][1]) for f, e, _ in hits}):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, item_id: str, text_col: str) -> list[list[tuple[str, str]]]:
    """The items, dealt into blocks of a checked size.

    The benchmark is a list of test questions that a person chose; it is read by
    the driver in a stream of blocks, never joined to the corpus."""
    rows = benchmark.select(benchmark[item_id].cast("string").alias("i"), benchmark[text_col].cast("string").alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t")
    out: list[list[tuple[str, str]]] = [[]]
    size = 0
    for r in rows.toLocalIterator():
        if size and size + len(r.t) > BLOCK_ITEM_BYTES:
            out.append([])
            size = 0
        out[-1].append((r.i, r.t))
        size += len(r.t)
    return out


def _hit_words(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id: str, item_text: str, window: int) -> DataFrame:
    """docs' columns by position (c0, c1, ...) with ``hits``: names of the caller may clash or repeat."""
    kind = "struct<n_words:long,places:array<struct<first:long,end:long>>,spans:array<struct<start:long,end:long>>,items:array<string>>"
    blocks = item_blocks(benchmark, item_id, item_text)
    spark = docs.sparkSession
    names = docs.columns
    df = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = f"c{names.index(text_col)}"
    df = df.withColumn("hits", F.lit(None).cast(kind))
    schema = df.schema
    for at, items in enumerate(blocks):
        shared = spark.sparkContext.broadcast(items)
        token = hashlib.sha256(repr((items, window)).encode()).hexdigest()
        df = df.mapInArrow(_scanner(shared, token, window, text), schema)
        if at + 1 < len(blocks):
            df = checkpoints.cut(df)
    return df


def hit_words(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs' columns with a struct ``hits``: n_words, places (first and end word, merged), spans (code points), items."""
    return _hit_words(docs, benchmark, text_col, item_id, item_text, window).toDF(*docs.columns, "hits")


def _scanner(shared, token: str, window: int, text: str):
    def run(batches):
        items = shared.value
        machine = _machine(token, items, window)
        kind = None
        for block in tb.iter_blocks(batches, text, BLOCK_BYTES):
            kind = kind or block.schema.field("hits").type
            old = block["hits"].to_pylist() if block["hits"].null_count < block.num_rows else [None] * block.num_rows
            new = []
            for value, before in zip(block[text], old):
                raw = (value.as_py() or "").encode()
                n, hits = machine.scan(raw)
                ids = {items[k][0] for _, _, k in hits}
                places = [(f, e) for f, e, _ in hits]
                spans = original_spans(raw.decode(), hits) if hits else []
                if before:
                    ids |= set(before["items"])
                    places += [(p["first"], p["end"]) for p in before["places"]]
                    spans += [(p["start"], p["end"]) for p in before["spans"]]
                new.append({"n_words": n, "places": [{"first": a, "end": b} for a, b in _merged(places)], "spans": [{"start": a, "end": b} for a, b in _merged(spans)], "items": sorted(ids)})
            at = block.schema.get_field_index("hits")
            yield from block.set_column(at, block.schema.field("hits"), pa.array(new, kind)).combine_chunks().to_batches()

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_hit(hits: str = "hits") -> Column:
    """Words hit: the places are merged, so their lengths add up."""
    return F.aggregate(F.col(f"{hits}.places"), F.lit(0).cast("long"), lambda s, p: s + p["end"] - p["first"])


def contaminated(hits: str = "hits") -> Column:
    """At least a twentieth of the words hit."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(f"{hits}.n_words"))


def without(text: Column, spans: Column) -> Column:
    """text less its spans (in order and apart)."""
    stop = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.length(text).cast("long")))
    start = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x["end"]))
    return F.array_join(F.zip_with(start, stop, lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))), "")


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; what is hit in them is cut out of their text."""
    names = docs.columns
    got = _hit_words(docs, benchmark, text_col, item_id, item_text, window).where(~contaminated())
    at = F.col(f"c{names.index(text_col)}")
    got = got.withColumn(f"c{names.index(text_col)}", F.when(F.size("hits.spans") > 0, without(at, F.col("hits.spans"))).otherwise(at))
    return got.drop("hits").toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all benchmark items in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = hit_words(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_CUT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_CUT} AS w FROM documents),
b AS (SELECT item_id, {_CUT} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT j) AS hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS k, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(k, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
