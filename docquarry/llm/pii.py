r"""PII: base patterns, and bootstrapped contextual extraction of unseen identifiers.

Everything is DataFrame operations.  One pass over the texts takes the spans of
the base patterns and, from looser typed slots, candidate identifiers; each comes
with the words around it.  Base spans are the seeds.  They induce lexical patterns:
a kind with one word before, two words before, or one word on either side.  A
bipartite graph of patterns and identifier values is then scored for a few rounds: a
pattern's confidence is the mean score of what it introduces, a value's score is the
noisy-or of its patterns' confidences, and seeds stay at 1.  Candidates whose score
reaches ``ACCEPT`` through patterns with ``LEAST_SEEDS`` different seed values are new
spans.  Base spans always stay.

Patterns and values are aggregated before they are joined, so that a frequent
word or value costs one row for each task.  Places are sums of the lengths of
matches and gaps, taken in chunks, and texts are cut through slabs, so that the work
on a text grows little faster than its length and matches (see :func:`running`).

Defined cases: a null or empty text has no spans; a span at the start of a text,
right after another match of its kind, or after something that is no word, has no
pattern; spans count code points, end exclusive; a candidate that touches a base span
is dropped; rows that repeat an id and a text each get their spans; an empty table
gives an empty result; columns of any name are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import checkpoints

KINDS = ("email", "ip", "card", "phone")
#: The base patterns; possessive loops wherever the next character cannot be in the loop.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser shapes of what a context may reveal: spelled-out addresses, and runs of 7 to 19 digits.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,18}+(?![0-9])",
    "phone": r"\(?[0-9][\x20()./0-9-]{5,20}[0-9](?![0-9])",
}
ROUNDS = 3
ACCEPT = 0.6
LEAST_SEEDS = 3
_CONTEXT = 64
_SPAN = "struct<s:int,e:int,m:string,g:string,h:string>"
_MENTION = "struct<s:int,e:int,kind:string,value:string,patterns:array<string>,seed:boolean>"
#: Values that are summed up before their sums are.
_CHUNK = 256
#: Code points of a slab, and of a slab of slabs.
_SLAB, _SLABS = 1024, 1024 * 256


def _chunks(items: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda i: F.slice(items, i * size + 1, F.lit(size)))


def _sums(items: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc, x):
        at = acc["at"] + x
        return F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out"))

    return F.aggregate(items, start, step, lambda acc: acc["out"])


def running(items: Column) -> Column:
    """Running sums of an array of integers that is not empty.

    An array that is appended to is copied each time, so chunks are summed up on their own."""
    inner = F.transform(_chunks(items, _CHUNK), _sums)
    ends = _sums(F.transform(inner, lambda x: F.element_at(x, -1)))
    before = F.concat(F.array(F.lit(0)), ends)
    return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda x, at: F.transform(x, lambda y: y + at)))


def _located(text: Column, pattern: str) -> Column:
    """Matches as (start, end, text, what stands before, what follows): the lengths of gaps and matches add up to places."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)

    def placed(both):
        m, g, h = both["m"], both["g"], both["h"]
        ends = running(F.zip_with(m, g, lambda x, y: F.length(x) + F.length(y)))
        near = F.arrays_zip(ends.alias("e"), m.alias("m"), g.alias("g"), h.alias("h"))
        one = lambda x: F.struct((x["e"] - F.length(x["m"])).alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(_CONTEXT)).alias("g"), F.left(x["h"], F.lit(_CONTEXT)).alias("h"))
        return F.transform(near, one)

    # found and gaps are taken once: in an array of one element
    both = F.array(F.struct(found.alias("m"), gaps.alias("g")))
    both = F.transform(both, lambda x: F.struct(x["m"].alias("m"), F.slice(x["g"], 1, F.size(x["m"])).alias("g"), F.slice(x["g"], 2, F.size(x["m"])).alias("h")))
    return F.flatten(F.transform(F.filter(both, lambda x: F.size(x["m"]) > 0), placed))


def slabs(text: Column) -> Column:
    """text in pieces of ``_SLAB`` code points: a place in a piece is found without walking there from the text's start."""
    cut = lambda t, size: F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / size).cast("int")), lambda i: F.substring(t, i * size + 1, F.lit(size)))
    return F.flatten(F.transform(cut(text, _SLABS), lambda t: F.filter(cut(t, _SLAB), lambda x: x != "")))


def piece(pieces: Column, start: Column, stop: Column) -> Column:
    """What stands in [start, stop) of a text cut into slabs."""
    first = F.floor(start / _SLAB).cast("int")
    count = F.floor((stop - 1) / _SLAB).cast("int") - first + 1
    inside = F.substring(F.array_join(F.slice(pieces, first + 1, F.greatest(count, F.lit(0))), ""), start - first * _SLAB + 1, stop - start)
    return F.when(stop > start, inside).otherwise("")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.try_to_number(p, F.lit("999")), F.lit(0)) <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str, guard: Column, valid=None) -> Column:
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    spans = F.when(guard, _located(text, pattern)).otherwise(none)
    return F.filter(spans, lambda x: valid(x["m"])) if valid else spans


_BEFORE = r"(?:([\p{L}\p{N}_]+)[^\p{L}\p{N}\s]*\s+)?([\p{L}\p{N}_]+)[^\p{L}\p{N}\s]*[\s:=|]+[(\[]*$"
_AFTER = r"^[)\]]*[\s,.;:]*([\p{L}\p{N}_]+)"


def _with_context(spans: Column, kind: str, seed: bool) -> Column:
    """Spans with their kind, normalised value and patterns (none where no word stands before)."""

    def one(x):
        value = F.lower(x["m"]) if kind == "email" else _digits(x["m"])
        two, word = (F.lower(F.regexp_extract(x["g"], _BEFORE, i)) for i in (1, 2))
        after = F.lower(F.regexp_extract(x["h"], _AFTER, 1))
        seen = F.array(
            F.when(word != "", F.concat(word, F.lit(" *"))),
            F.when((word != "") & (two != ""), F.concat_ws(" ", two, word, F.lit("*"))),
            F.when((word != "") & (after != ""), F.concat_ws(" ", word, F.lit("*"), after)),
        )
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), value.alias("value"), F.array_compact(seen).alias("patterns"), F.lit(seed).alias("seed"))

    return F.transform(spans, one)


def reached(ends: Column) -> Column:
    """Running maxima of an array of integers that is not empty, in chunks like :func:`running`."""

    def most(items):
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

        def step(acc, x):
            at = F.greatest(acc["at"], x)
            return F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out"))

        return F.aggregate(items, start, step, lambda acc: acc["out"])

    inner = F.transform(_chunks(ends, _CHUNK), most)
    before = F.concat(F.array(F.lit(0)), most(F.transform(inner, lambda x: F.element_at(x, -1))))
    return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda x, at: F.transform(x, lambda y: F.greatest(y, at))))


_FAR = (1 << 31) - 1


def _apart(loose: Column, base: Column) -> Column:
    """The spans of loose that touch none of base: no base span that began before ends later, none begins before it ends."""
    none = F.lit(None).cast(_MENTION)
    placed = lambda spans, order, whole: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), whole(x).alias("x")))

    def apart(every):
        ends = reached(F.transform(every, lambda y: F.when(y["o"] == 0, y["e"]).otherwise(0)))
        starts = F.reverse(reached(F.transform(F.reverse(every), lambda y: F.when(y["o"] == 0, _FAR - y["s"]).otherwise(0))))
        both = F.arrays_zip(every.alias("y"), ends.alias("end"), starts.alias("start"))
        free = F.filter(both, lambda z: (z["y"]["o"] == 1) & (z["end"] <= z["y"]["s"]) & (_FAR - z["start"] >= z["y"]["e"]))
        return F.transform(free, lambda z: z["y"]["x"])

    every = F.array_sort(F.concat(placed(base, 0, lambda x: none), placed(loose, 1, lambda x: x)))
    return F.when((F.size(base) == 0) | (F.size(loose) == 0), loose).otherwise(F.flatten(F.transform(F.array(every), apart)))


def extract(docs: DataFrame, text_col: str) -> DataFrame:
    """docs' columns by position (c0, c1, ...) with ``base`` (spans by kind, then start) and ``loose`` (candidates off the base spans)."""
    names = docs.columns
    df = docs.toDF(*(f"c{i}" for i in range(len(names))))
    df = df.withColumn("t", F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit("")))
    t = F.col("t")
    df = df.withColumn("digit", t.rlike("[0-9]")).withColumn("at", F.contains(t, F.lit("@")))
    guards = {"email": F.col("at"), "ip": F.col("digit") & F.contains(t, F.lit(".")), "card": F.col("digit"), "phone": F.col("digit") & F.contains(t, F.lit("+"))}
    for kind in KINDS:
        df = df.withColumn(kind, _spans(t, kind, PATTERNS[kind], guards[kind], (lambda m, k=kind: _valid(k, m)) if kind != "email" else None))
    df = df.withColumn("base", F.concat(*(_with_context(F.col(kind), kind, True) for kind in KINDS)))
    loose_guards = {"email": F.contains(F.lower(t), F.lit("at)")) | F.contains(F.lower(t), F.lit("at]")), "card": F.col("digit"), "phone": F.col("digit")}
    loose = F.concat(*(_with_context(_spans(t, kind, LOOSE[kind], loose_guards[kind]), kind, False) for kind in LOOSE))
    df = df.withColumn("loose", F.filter(loose, lambda x: F.size(x["patterns"]) > 0))
    return df.withColumn("loose", _apart(F.col("loose"), F.col("base"))).drop("t", "digit", "at", *KINDS)


def score_values(mentions: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """kind, value, score of the candidate values among mentions (kind, value, patterns, seed)."""
    each = mentions.select("kind", "value", "seed", F.explode("patterns").alias("pattern"))
    edges = each.groupBy("kind", "pattern", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    seeds = mentions.groupBy("kind", "value").agg(F.max("seed").alias("seed"))
    edges = edges.join(seeds, ["kind", "value"])
    known = edges.groupBy("kind", "pattern").agg(F.sum(F.col("seed").cast("int")).alias("seeds")).where(F.col("seeds") >= LEAST_SEEDS)
    edges = checkpoints.cut(edges.join(known.select("kind", "pattern"), ["kind", "pattern"]))
    scores = edges.select("kind", "value", F.col("seed").cast("double").alias("score")).distinct()
    for _ in range(rounds):
        patterns = edges.join(scores, ["kind", "value"]).groupBy("kind", "pattern").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("confidence"))
        miss = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12))))
        scores = edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "value").agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(miss)).alias("score"))
        scores = checkpoints.cut(scores)
    return scores


#: Rows with newly found spans up to which they are broadcast (a few hundred bytes each).
BROADCAST_ROWS = 20_000


def _with_found(rows: DataFrame) -> DataFrame:
    """rows (row, base, loose, ...), computed before, with ``found``: the candidates that the patterns accept."""
    each = rows.where("size(base) + size(loose) > 0").select("row", F.explode(F.concat("base", "loose")).alias("x")).select("row", "x.*")
    scores = score_values(each.select("kind", "value", "patterns", "seed")).where(F.col("score") >= ACCEPT)
    new = each.where(~F.col("seed")).join(scores, ["kind", "value"]).select("row", F.struct("s", "e", "kind", "value", "patterns", "seed").alias("x"))
    new = checkpoints.cut(new.groupBy("row").agg(F.array_distinct(F.array_sort(F.collect_list("x"))).alias("found")))
    out = rows.join(F.broadcast(new) if new.count() <= BROADCAST_ROWS else new, "row", "left")
    return out.withColumn("found", F.coalesce("found", F.expr(f"cast(array() as array<{_MENTION}>)")))


def find_pii(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the text by default) with ``base`` and ``found``: arrays of spans (s, e, kind, ...)."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    held = [f"c{docs.columns.index(c)}" for c in keep]
    rows = extract(docs, text_col).select(*held, "base", "loose").withColumn("row", F.monotonically_increasing_id())
    return _with_found(checkpoints.cut(rows)).select(*held, "base", "found").toDF(*keep, "base", "found")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    """By kind as listed, then start, then end."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(rank(x).alias("r"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return keyed


def redact(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets; overlapping spans become the first of them."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def rebuilt(x):
        parts, spans = x["parts"], x["spans"]
        # how far the spans before a span reach: where it begins there, it belongs to them
        reach = F.concat(F.array(F.lit(0)), reached(F.transform(spans, lambda y: y["e"])))
        between = lambda y, at: F.when(y["s"] < at, "").otherwise(F.concat(piece(parts, at, y["s"]), F.lit("<"), y["kind"], F.lit(">")))
        done = F.array_join(F.zip_with(spans, F.slice(reach, 1, F.size(spans)), between), "")
        return F.concat(done, piece(parts, F.element_at(reach, -1), x["length"]))

    once = F.array(F.struct(slabs(text).alias("parts"), ordered.alias("spans"), F.length(text).alias("length")))
    return F.element_at(F.transform(once, rebuilt), 1)


def redact_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with all base and newly found spans replaced by their kinds; a null text stays null.

    The rows are written once with their spans, so that the texts are searched once."""
    names = docs.columns
    at = f"c{names.index(text_col)}"
    rows = extract(docs, text_col).withColumn("row", F.monotonically_increasing_id())
    out = _with_found(checkpoints.table(rows))
    spans = F.concat("base", "found")
    text = F.when(F.size(spans) > 0, redact(F.col(at).cast("string"), spans)).otherwise(F.col(at))
    held = [f"c{i}" for i in range(len(names))]
    return out.select(*(text.alias(c) if c == at else F.col(c) for c in held)).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in all documents."""
    got = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *map(n, KINDS), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(in_order(F.concat("base", "found"))).alias("spans"))
