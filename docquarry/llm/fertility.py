"""Quality rules: tokeniser fertility with rejection bands per language or script.

A public vocabulary with byte fallback encodes each word of a document (the
distinct words of a block once).  Three figures follow: characters per token,
the share of byte-fallback tokens, and the entropy of the document's tokens as
a share of the most it could be.  A document outside the band of its language,
or of its script if the language has none, is rejected, as is one whose letters
are mostly of another script than its language's.  The base rules (too
few words, too many words in repeated five-word windows) are counted in the
same pass.  There is no shuffle.

Defined cases: a null or empty text has no words and fails the base rules; a
null or unknown language takes its script's band; fewer than ``MIN_TOKENS``
tokens give no verdict by entropy; repeated rows and null ids are judged like
any other row; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import textblocks as tb

BLOCK_BYTES = 2 << 20
REMEMBERED = 150_000
#: Tokens from which the entropy of a document says something.
MIN_TOKENS = 64


class Band(NamedTuple):
    """Bounds, inclusive: least and most characters per token, most byte-fallback share, least entropy share."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: Bands by language code, and by script for the rest.  The languages' least bounds are
#: from the rows of sf0.1 labelled quality 1 that pass the base rules and have
#: MIN_TOKENS: of what one row in 200 of its language undercuts, 0.92 of the
#: characters per token and 0.8 of the entropy.  No such row falls back to bytes or
#: nears the most characters (its invented words are shorter than real ones).  The
#: bands of scripts have no clean rows to go by.
BANDS = {
    "en": Band(1.85, 12.0, 0.10, 0.44),
    "fr": Band(1.59, 12.0, 0.10, 0.40),
    "de": Band(1.90, 12.0, 0.10, 0.43),
    "es": Band(1.65, 12.0, 0.10, 0.42),
    "latin": Band(1.0, 14.0, 0.40, 0.25),
    "greek": Band(0.6, 6.0, 0.50, 0.25),
    "cyrillic": Band(0.9, 8.0, 0.40, 0.25),
    "semitic": Band(0.6, 5.0, 0.60, 0.25),
    "indic": Band(0.3, 5.0, 0.95, 0.20),
    "cjk": Band(0.3, 4.0, 0.95, 0.20),
    "other": Band(0.25, 14.0, 0.98, 0.15),
}
#: Script of the languages that have a band.
LANGUAGE_SCRIPT = {"en": "latin", "fr": "latin", "de": "latin", "es": "latin"}
_SCRIPTS = ["latin", "greek", "cyrillic", "semitic", "indic", "cjk", "other"]
#: Script of a lead byte: index into _SCRIPTS, -1 for bytes that say nothing.
_LEAD = np.full(256, -1, np.int8)
_LEAD[0x41:0x5B] = _LEAD[0x61:0x7B] = 0
_LEAD[0xC3:0xCB] = 0
_LEAD[0xCE:0xD0] = 1
_LEAD[0xD0:0xD4] = 2
_LEAD[0xD6:0xDC] = 3
_LEAD[0xE0] = 4
_LEAD[0xE3:0xEE] = 5
_LEAD[0xF0:0xF5] = 6

_SYMBOLS = tb._lut(*b"#*$%&|<>")
_loaded: dict[str, tuple] = {}


def _model(path: str):
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        _loaded[path] = (model, is_byte, {})
    return _loaded[path]


def repeated_words(values: np.ndarray, doc: np.ndarray, k: int = 5) -> np.ndarray:
    """Flags of the words that lie in a k-word window found twice or more in its document."""
    h = tb.window_hash(values, k)
    at = np.flatnonzero(doc[: len(h)] == doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)
    key = tb.mix(h[at] ^ tb.mix(doc[at].astype(tb.U) + tb.U(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return tb.cover(at[twice], k, len(values))


def _dup_lines(data, off, sums, starts) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    lines, ends, doc = tb.word_spans(data, off, tb._lut(0x0A))
    if len(lines) == 0:
        return np.zeros(len(off) - 1, np.int64)
    filled = np.searchsorted(starts, ends) > np.searchsorted(starts, lines)
    lines, ends, doc = lines[filled], ends[filled], doc[filled]
    key = tb.mix(tb.span_hash(sums, lines, ends) ^ tb.mix(doc.astype(tb.U) + tb.U(1)))
    _, first = np.unique(key, return_index=True)
    n = len(off) - 1
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)


def _fertility(path, raw, starts, ends, first, which, doc, n):
    """(tokens, byte-fallback tokens, entropy in bits) of each document."""
    model, is_byte, known = _model(path)
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    if len(known) > REMEMBERED:
        known.clear()
    new = [w for w in words if w not in known]
    for i in range(0, len(new), 4096):
        part = new[i : i + 4096]
        known.update((w, array("H", x).tobytes()) for w, x in zip(part, model.encode([w.decode() for w in part], num_threads=1)))
    coded = [known[w] for w in words]
    sizes = np.array([len(x) for x in coded], np.int64) // 2
    flat = np.frombuffer(b"".join(coded), np.uint16)
    begin = np.cumsum(sizes) - sizes
    # each document's distinct words with their counts, then those words' tokens
    pair, times = np.unique(doc * len(words) + which, return_counts=True)
    pdoc, pword = pair // max(1, len(words)), pair % max(1, len(words))
    reps = sizes[pword]
    place = np.repeat(begin[pword] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
    ids, tdoc, weight = flat[place].astype(np.int64), np.repeat(pdoc, reps), np.repeat(times, reps)
    tokens = np.bincount(tdoc, weights=weight, minlength=n)
    fell = np.bincount(tdoc, weights=weight * is_byte[ids], minlength=n)
    key = tdoc * len(is_byte) + ids
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    c = np.add.reduceat(weight, edge).astype(float) if len(edge) else np.zeros(0)
    d = key[edge] // len(is_byte) if len(edge) else np.zeros(0, np.int64)
    share = c / np.maximum(tokens[d], 1)
    return tokens, fell, np.bincount(d, weights=-share * np.log2(np.maximum(share, 1e-300)), minlength=n)


def _band_rows(lang: list, data, off, bands) -> np.ndarray:
    """The band of each document, as rows of four bounds."""
    out = [bands.get(x) for x in lang]
    for i in (i for i, band in enumerate(out) if band is None):
        lead = _LEAD[data[off[i] : off[i + 1]]]
        out[i] = bands[_SCRIPTS[int(np.argmax(np.bincount(lead[lead >= 0], minlength=len(_SCRIPTS))))]]
    return np.array(out, float).reshape(-1, 4)


def _other_script(lang: list, data, off) -> np.ndarray:
    """Documents whose letters are mostly of another script than their language's."""
    scripts = np.array([_SCRIPTS.index(LANGUAGE_SCRIPT[x]) if x in LANGUAGE_SCRIPT else -1 for x in lang], np.int64)
    lead = _LEAD[data]
    letters, out = tb.per_doc(lead >= 0, off), np.zeros(len(lang), bool)
    for script in set(scripts[scripts >= 0].tolist()):
        out |= (scripts == script) & (2 * tb.per_doc(lead == script, off) < letters)
    return out


def quality(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bands: dict[str, Band] = BANDS) -> DataFrame:
    """Per row: base counts, base_failed, fertility figures and kept; other columns of docs are not carried."""
    out = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, in_band boolean"

    def run(batches):
        for block in tb.iter_blocks(batches, "text", BLOCK_BYTES):
            yield pa.record_batch([block["id"].combine_chunks(), *map(pa.array, measure(block["text"], block["lang"].to_pylist(), path, bands))], names=["id", *(x.split()[0] for x in out.split(", "))])

    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), lang.alias("lang"))
    got = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {out}")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return got.withColumnRenamed("id", id_col).withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("in_band"))


def measure(texts, lang: list, path: str, bands: dict[str, Band] = BANDS) -> list[np.ndarray]:
    """The figures of one block of texts, in the order of :func:`quality`'s columns."""
    data, off = tb.text_buffers(texts)
    n = len(off) - 1
    starts, ends, doc = tb.word_spans(data, off, tb.SPACE)
    n_words = np.bincount(doc, minlength=n)
    word_chars = tb.per_doc(((data & 0xC0) != 0x80) & ~tb.SPACE[data], off)
    symbols = tb.per_doc(_SYMBOLS[data], off)
    sums = tb.prefix_sums(tb.BYTE_VALUES[data])
    values = tb.span_hash(sums, starts, ends)
    repeats = np.bincount(doc[repeated_words(values, doc)], minlength=n)
    _, first, which = np.unique(values, return_index=True, return_inverse=True)
    tokens, fell, entropy = _fertility(path, data.tobytes(), starts, ends, first, which, doc, n)
    most = np.maximum(tokens, 1)
    chars, share = word_chars / most, fell / most
    relative = entropy / np.log2(np.clip(tokens, 2, 1 << 15))
    band = _band_rows(lang, data, off, bands)
    inside = (tokens > 0) & (chars >= band[:, 0]) & (chars <= band[:, 1]) & (share <= band[:, 2]) & ((tokens < MIN_TOKENS) | (relative >= band[:, 3]))
    inside &= ~_other_script(lang, data, off)
    return [n_words.astype(np.int64), word_chars, symbols, _dup_lines(data, off, sums, starts).astype(np.int64), repeats.astype(np.int64), tokens.astype(np.int64), chars, share, relative, inside]


def keep_good(docs: DataFrame, path: str, *, text_col: str = "text", lang_col: str = "lang", bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows of docs that pass the base rules and their band, with all their columns, in one pass."""
    names = docs.columns
    text = f"c{names.index(text_col)}"
    lang = f"c{names.index(lang_col)}" if lang_col in names else None

    def run(batches):
        for block in tb.iter_blocks(batches, text, BLOCK_BYTES):
            got = measure(block[text], block[lang].to_pylist() if lang else [None] * block.num_rows, path, bands)
            n_words, repeats, inside = got[0], got[4], got[9]
            yield from block.filter(pa.array((n_words >= 10) & (100 * repeats <= 20 * n_words) & inside)).combine_chunks().to_batches()

    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return rows.mapInArrow(run, rows.schema).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document under the 32k piece vocabulary."""
    import public_tokenizers

    got = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", F.round("chars_per_token", 6).alias("chars_per_token"), F.round("byte_share", 6).alias("byte_share"), F.round("token_entropy", 6).alias("token_entropy"))
