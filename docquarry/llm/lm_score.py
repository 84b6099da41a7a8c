"""LM scoring: stupid-backoff scores from count tables partitioned by hash.

The model is an n-gram model over words (runs of non-space, unchanged), counted over
all documents; its order, the longest n-gram, is a parameter (the query takes 2).  A
document is scored by what the other documents say: its own counts are taken off
first, so that it does not vouch for itself.  With c the counts left, N the words left
and a = 0.4, a word w after the words v scores

    S(w | v) = c(v w) / c(v)  if c(v w) > 0,  else  a * S(w | v without its first word),
    S(w) = c(w) / N  if c(w) > 0,  else  a / N,

with v the order - 1 words before, or as many as the document has.  A document's score
is the sum of the base-10 logarithms.

The tables are kept as packed arrays: each block of documents sends its distinct
n-grams with their counts to the hash buckets once, so that a frequent n-gram is
one entry for each block; a bucket adds up and answers each block's entries in
their order; the block joins the totals to its documents' exploded n-grams and sums
for each document.  An n-gram is known by 56 bits of its hash and its bucket.

Defined cases: a null or empty text has no words, score 0 and a null mean; rows
with a null id are scored as empty; rows that repeat an id are documents of their
own; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import checkpoints, winnow
from docquarry.llm import textblocks as tb
from docquarry.llm.textblocks import U

BACKOFF = 0.4
BLOCK_BYTES = 4 << 20
_LOW = U((1 << 56) - 1)
_ROW = "bucket int, block int, payload binary"


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, those from 255 on in full behind them."""
    big = counts[counts >= 255].astype("<u8").tobytes()
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + big


def _unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", -1, n)
    return out


def _grams(table: pa.Table, order: int):
    """(documents' word counts, document of words, levels) of a sorted block.

    A level m holds the places of the words that have m words before them and the keys
    of the n-grams that end there."""
    data, off = tb.text_buffers(table["text"])
    starts, ends, doc = tb.word_spans(data, off, tb.SPACE)
    word = tb.span_hash(tb.prefix_sums(tb.BYTE_VALUES[data]), starts, ends)
    levels = [(np.arange(len(doc)), word)]
    for m in range(1, order):
        at, keys = levels[-1]
        longer = np.flatnonzero(doc[m:] == doc[:-m]) + m
        before = keys[_places(at, longer - 1)]
        levels.append((longer, tb.mix(tb.mix(before + U(0x632BE59BD9B4E019)) ^ word[longer])))
    return np.bincount(doc, minlength=len(off) - 1), doc, levels


def _places(at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted places stand among those of a level; all are there."""
    whole = len(at) == 0 or at[-1] == len(at) - 1
    return wanted if whole else np.searchsorted(at, wanted)


def _ranked(levels, n: int):
    """(bucket and low bits of the distinct keys, in order; number of each n-gram's key by level; counts)."""
    keys = np.concatenate([k for _, k in levels])
    distinct, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    bucket = winnow.bucket_of(distinct, n)  # ascends with the key
    order = np.lexsort((distinct & _LOW, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    numbers = np.split(place[which], np.cumsum([len(k) for _, k in levels])[:-1])
    return bucket[order], (distinct & _LOW)[order], numbers, counts[order]


def _count_rows(n: int, order: int):
    def run(key, table):
        *_, levels = _grams(winnow.sorted_block(table), order)
        bucket, low, _, counts = _ranked(levels, n)
        cuts = np.searchsorted(bucket, np.arange(n + 1))
        rows = []
        for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if y > x:
                packed = tb.pack(low[x:y])
                rows.append((b, key[0].as_py(), int(y - x).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + _pack_counts(counts[x:y])))
        return _rows(rows)

    return run


def _rows(rows) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "block", "payload"])


def _totals(key, table):
    """Each block's entries with their counts over all blocks."""
    got = []
    for r in table.to_pylist():
        raw = r["payload"]
        n, size = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
        got.append((r["block"], tb.unpack(raw[8 : 8 + size]), _unpack_counts(raw[8 + size :], n)))
    keys, which = np.unique(np.concatenate([k for _, k, _ in got]), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([c for _, _, c in got]), minlength=len(keys)).astype(np.int64)
    rows, at = [], 0
    for block, k, _ in got:
        rows.append((key[0].as_py(), block, len(k).to_bytes(4, "little") + _pack_counts(total[which[at : at + len(k)]])))
        at += len(k)
    return _rows(rows)


def _own(doc: np.ndarray, number: np.ndarray, most: int) -> np.ndarray:
    """How often each entry's own document has its n-gram."""
    _, which, counts = np.unique(doc * most + number, return_inverse=True, return_counts=True)
    return counts[which]


def _scores(n: int, order: int):
    def run(key, docs, answers):
        docs = winnow.sorted_block(docs)
        words, doc, levels = _grams(docs, order)
        _, _, numbers, _ = _ranked(levels, n)
        rows = sorted(((r["bucket"], r["payload"]) for r in answers.to_pylist()), key=lambda x: x[0])
        total = np.concatenate([_unpack_counts(raw[4:], int.from_bytes(raw[:4], "little")) for _, raw in rows]) if rows else np.zeros(0, np.int64)
        most = len(total) + 1
        left = [total[k] - _own(doc[at], k, most) if len(k) else np.zeros(0, np.int64) for (at, _), k in zip(levels, numbers)]
        value, length = np.zeros(len(doc)), np.zeros(len(doc), np.int64)
        for m in range(order - 1, 0, -1):
            at, open_ = levels[m][0], length[levels[m][0]] == 0
            hit, miss = open_ & (left[m] > 0), open_ & (left[m] <= 0)
            context = left[m - 1][_places(levels[m - 1][0], at[hit] - 1)]
            value[at[hit]] += np.log10(left[m][hit]) - np.log10(context)
            value[at[miss]] += np.log10(BACKOFF)
            length[at[hit]] = m + 1
        one = (length == 0) & (left[0] > 0)
        value[one] += np.log10(left[0][one])
        length[one] = 1
        value[length == 0] += np.log10(BACKOFF)
        add = lambda x: np.bincount(doc, weights=x, minlength=len(words))
        by_length = [pa.array(add(length == m).astype(np.int64)) for m in range(order + 1)]
        return pa.table([docs["id"], pa.array(words.astype(np.int64)), *by_length, pa.array(add(value))], names=["id", "n_words", *_kinds(order), "part"])

    return run


def _kinds(order: int) -> list[str]:
    """Names of the counts of words by the length of the n-gram that scored them, from none on."""
    return ["n_unseen", "n_unigram", "n_bigram", *(f"n_{m}gram" for m in range(3, order + 1))][: order + 1]


def backoff_scores(docs: DataFrame, *, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, counts of words by the case that scored them (n_unseen, n_unigram, n_bigram, n_3gram, ...), score and mean_score.

    order: the longest n-gram, 1 or more."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = winnow.rows_of(docs, id_col, text_col)
    batch = winnow.dealt(rows, winnow.count_blocks(rows, BLOCK_BYTES))
    answers = batch.groupBy("block").applyInArrow(_count_rows(n, order), _ROW).groupBy("bucket").applyInArrow(_totals, _ROW)
    counts = ["n_words", *_kinds(order)]
    shape = f"id long, {', '.join(f'{c} long' for c in counts)}, part double"
    got = checkpoints.cut(batch.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(n, order), shape))
    all_words = got.agg(F.sum("n_words")).first()[0] or 0
    # the words left can be none only where the document is all there is
    rest = F.greatest(F.lit(all_words) - F.col("n_words"), F.lit(1))
    score = F.col("part") - (F.col("n_unigram") + F.col("n_unseen")) * F.log10(rest)
    ident = docs[id_col].cast("long")
    zero = F.lit(0).cast("long")
    empty = docs.where(ident.isNull() | docs[text_col].isNull() | (docs[text_col].cast("string") == ""))
    empty = empty.select(ident.alias("id"), *(zero.alias(c) for c in counts), F.lit(0.0).alias("score"))
    out = got.select("id", *counts, score.alias("score")).unionByName(empty)
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words"))).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    got = backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_bigram", "n_unigram", "n_unseen", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS b, unnest(range(1, len(w) + 1)) AS i, w FROM w),
g AS (SELECT doc_id, i, b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM t),
c1 AS (SELECT b, count(*) AS n FROM g GROUP BY b),
o1 AS (SELECT doc_id, b, count(*) AS n FROM g GROUP BY doc_id, b),
c2 AS (SELECT a, b, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b),
o2 AS (SELECT doc_id, a, b, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY doc_id, a, b),
n AS (SELECT count(*) AS n FROM g),
m AS (SELECT doc_id, len(w) AS n FROM w),
x AS (SELECT g.doc_id, g.i, c1.n - o1.n AS l1, coalesce(c2.n - o2.n, 0) AS l2, ca.n - oa.n AS la, (SELECT n FROM n) - m.n AS rest
FROM g JOIN m ON m.doc_id = g.doc_id JOIN c1 ON c1.b = g.b JOIN o1 ON o1.doc_id = g.doc_id AND o1.b = g.b
LEFT JOIN c2 ON c2.a = g.a AND c2.b = g.b LEFT JOIN o2 ON o2.doc_id = g.doc_id AND o2.a = g.a AND o2.b = g.b
LEFT JOIN c1 ca ON ca.b = g.a LEFT JOIN o1 oa ON oa.doc_id = g.doc_id AND oa.b = g.a),
s AS (SELECT doc_id, l2 > 0 AS two, l2 <= 0 AND l1 > 0 AS one, l2 <= 0 AND l1 <= 0 AS none,
CASE WHEN l2 > 0 THEN log10(l2) - log10(la) ELSE (CASE WHEN l1 > 0 THEN log10(l1) ELSE log10(0.4::DOUBLE) END) + (CASE WHEN i > 1 THEN log10(0.4::DOUBLE) ELSE 0 END) - log10(rest) END AS v FROM x)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, count(*) FILTER (two)::BIGINT AS n_bigram, count(*) FILTER (one)::BIGINT AS n_unigram, count(*) FILTER (none)::BIGINT AS n_unseen,
round(coalesce(sum(v), 0), 4) AS score, CASE WHEN len(w.w) > 0 THEN round(sum(v) / len(w.w), 6) END AS mean_score
FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id, w.w
"""
