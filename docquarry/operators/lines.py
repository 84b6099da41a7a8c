"""Lines of documents, their blocking pairs, TF-IDF and the text-similarity job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import grids
from docquarry.functions.text import LINE_BREAK, collapse, normalize_fast, normalize_text, with_bigrams, word_tokens
from docquarry.plans import materialize

LEAST, MOST = 20, 300
BUCKET_WIDTH, PREFIX, TOLERANCE = 10, 2, 10
#: Lines of one chunk of a block, and pairs that a task has on average.
CHUNK, TASK_PAIRS = 2048, 4_000_000


def text_lines(docs: DataFrame, *, file_id: str = "doc_id", text: str = "text", page_no: str | None = None) -> DataFrame:
    """line_id, file_id, page_no, line_no, text, length of the lines of LEAST to MOST characters.

    Line numbers count dropped lines too, so a line keeps its number whatever is kept."""
    each = docs.select(docs[file_id].cast("long").alias("file_id"), (F.col(page_no) if page_no else F.lit(1)).cast("int").alias("page_no"), F.posexplode(F.split(docs[text], LINE_BREAK, -1)).alias("at", "raw"))
    lines = each.select("file_id", "page_no", (F.col("at") + 1).cast("int").alias("line_no"), collapse(F.col("raw")).alias("text"))
    lines = lines.withColumn("length", F.length("text")).where(F.col("length").between(LEAST, MOST))
    ident = F.col("file_id") * 1_000_000_000 + F.col("page_no") * 1_000_000 + F.col("line_no")
    return lines.select(ident.alias("line_id"), "file_id", "page_no", "line_no", "text", "length")


def normalized(lines: DataFrame, *, exact: bool = False) -> DataFrame:
    """Lines within the stored length bounds with their normalised text ``norm``; blank ones go."""
    norm = normalize_text("text") if exact else normalize_fast(F.col("text"))
    return lines.where(F.col("length").between(LEAST, MOST)).withColumn("norm", norm).where("norm <> ''")


def blocking_key(df: DataFrame, norm: str = "norm") -> DataFrame:
    """df with the bucket of normalised length and the prefix that candidates must share."""
    n = F.length(norm)
    return df.withColumn("len", n).withColumn("bucket", F.floor(n / BUCKET_WIDTH)).withColumn("prefix", F.left(F.col(norm), F.lit(PREFIX)))


def chunked(rows: DataFrame, order: list[str], size: Column) -> tuple[DataFrame, int]:
    """Rows with their chunk (size adds up to CHUNK, in the given order) and the chunks of their block, computed once; the tasks that all pairs are worth.

    Blocks that have no pair go.  All pairs of two chunks, or of one, are a tile: a block
    of any size is dealt to many tasks, and each row goes to as many tiles as its block has chunks."""
    block = Window.partitionBy("bucket", "prefix")
    rows = rows.withColumn("block", F.sum(size).over(block)).where("block > 1")
    rows = rows.withColumn("chunk", F.floor((F.sum(size).over(block.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - 1) / CHUNK).cast("int"))
    rows = materialize.cut(rows.withColumn("chunks", (F.floor((F.col("block") - 1) / CHUNK) + 1).cast("int")))
    pairs = rows.agg(F.sum(size * (F.col("block") - 1) / 2)).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.drop("block"), max(least, min(20_000, int(pairs // TASK_PAIRS)))


def blocked_pairs(lines: DataFrame, *, tolerance: int = TOLERANCE, same_file: bool = True, other_file: bool = True) -> DataFrame:
    """line_id_a < line_id_b of all candidate pairs: same bucket and prefix, lengths within the tolerance.

    An equi-join on tiles of a block; within a tile few ids take turns, which columns compress well."""
    keyed, tasks = chunked(blocking_key(lines).select("line_id", "file_id", "len", "bucket", "prefix"), ["line_id"], F.lit(1))
    tile = ["bucket", "prefix", "lo", "hi"]

    def side(x: str, lo: Column, hi: Column) -> DataFrame:
        named = keyed.select("bucket", "prefix", lo.alias("lo"), hi.alias("hi"), *(F.col(c).alias(f"{c}_{x}") for c in ("line_id", "file_id", "len")))
        return named.repartition(tasks, *tile)

    own = F.col("chunk")
    a = side("a", own, F.explode(F.sequence(own, F.col("chunks") - 1)))
    b = side("b", F.explode(F.sequence(F.lit(0), own)), own)
    pairs = a.hint("merge").join(b, tile).where("line_id_a < line_id_b").where(F.abs(F.col("len_a") - F.col("len_b")) <= tolerance)
    if not same_file:
        pairs = pairs.where("file_id_a <> file_id_b")
    if not other_file:
        pairs = pairs.where("file_id_a = file_id_b")
    return pairs.select("line_id_a", "line_id_b")


def distinct_texts(lines: DataFrame) -> DataFrame:
    """rep (least line_id), norm: one row for each different normalised text."""
    return lines.groupBy("norm").agg(F.min("line_id").alias("rep"))


def scored(texts: DataFrame, *names: str) -> DataFrame:
    """id_a < id_b and the named scores of all candidate pairs of ids of texts: rep, norm, ids, again (the TF-IDF cosine of equal texts), and terms and weights for that score.

    Tiles are scored as grids, each pair of different texts in a tile once, however many ids have them."""
    more = [c for c in ("terms", "weights") if c in texts.columns]
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / CHUNK).cast("int")), lambda i: F.slice("ids", i * CHUNK + 1, CHUNK))
    keyed = blocking_key(texts).drop("len").select("bucket", "prefix", "rep", "norm", "again", *more, F.posexplode(parts).alias("part", "ids"))
    rows, tasks = chunked(keyed, ["rep", "part"], F.size("ids"))
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = other.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("other", "chunks")
    tile = ["bucket", "prefix", "lo", "hi"]
    return tiles.repartition(tasks, *tile).groupBy(*tile).applyInArrow(grids.scorer(names), f"id_a long, id_b long, {', '.join(f'{c} double' for c in names)}")


def distinct_scores(lines: DataFrame, name: str) -> DataFrame:
    """rep_a < rep_b and a score of candidate pairs of different texts, each once however many lines have them."""
    texts = distinct_texts(lines)
    if name == "tfidf_cosine":
        lines = materialize.cut(lines.select("line_id", "norm"))
        texts = distinct_texts(lines).join(term_lists(lines), "rep", "left")
    one = texts.withColumns({"ids": F.array("rep"), "again": F.lit(1.0)})
    return scored(one, name).withColumnsRenamed({"id_a": "rep_a", "id_b": "rep_b"})


def tfidf(lines: DataFrame) -> DataFrame:
    """rep, term, weight: L2-normalised TF-IDF of words and word pairs, idf = ln((1 + n) / (1 + df)) + 1 over all lines.

    Texts are dealt by rep, so that terms are counted where they are; terms move twice,
    to their document frequency and back to their text."""
    texts = lines.groupBy("norm").agg(F.min("line_id").alias("rep"), F.count(F.lit(1)).alias("times"))
    total = texts.agg(F.sum("times").alias("n"))
    terms = texts.repartition("rep").select("rep", "times", F.explode(with_bigrams(word_tokens(F.col("norm")))).alias("term"))
    tf = terms.groupBy("rep", "times", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.sum("times").alias("df"))
    raw = tf.join(df, "term").crossJoin(F.broadcast(total)).select("rep", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("rep")))
    return raw.select("rep", "term", (F.col("w") / size).alias("weight"))


def term_lists(lines: DataFrame) -> DataFrame:
    """rep, terms, weights: :func:`tfidf` as one row for each text."""
    return tfidf(lines).groupBy("rep").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))


def cosine(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """rep_a, rep_b, tfidf_cosine of the pairs; 0 without a common term."""
    a = weights.select(F.col("rep").alias("rep_a"), "term", F.col("weight").alias("wa"))
    b = weights.select(F.col("rep").alias("rep_b"), "term", F.col("weight").alias("wb"))
    common = pairs.select("rep_a", "rep_b").join(a, "rep_a").join(b, ["rep_b", "term"]).groupBy("rep_a", "rep_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("c"))
    return pairs.select("rep_a", "rep_b").join(common, ["rep_a", "rep_b"], "left").select("rep_a", "rep_b", F.coalesce("c", F.lit(0.0)).alias("tfidf_cosine"))


def similarity_job(lines: DataFrame) -> DataFrame:
    """All candidate pairs of lines with the five scores, their mean and an unset threshold flag.

    Lines are normalised once and written.  Pairs of different texts are scored on texts that
    bring their weights and lines along."""
    lines = materialize.cut(normalized(lines).select("line_id", "norm"))
    has_word = F.when(F.col("norm").rlike(r"[\p{L}\p{N}_]"), 1.0).otherwise(0.0)
    texts = lines.groupBy("norm").agg(F.min("line_id").alias("rep"), F.collect_list("line_id").alias("ids")).withColumn("again", has_word)
    names = list(grids.SCORES)
    found = scored(texts.join(term_lists(lines), "rep", "left"), *names).withColumnsRenamed({"id_a": "line_id_a", "id_b": "line_id_b"})
    mean = sum((F.col(c) for c in names), F.lit(0.0)) / 5
    return found.withColumn("avg_score", mean).withColumn("passed_threshold", F.lit(None).cast("int"))
