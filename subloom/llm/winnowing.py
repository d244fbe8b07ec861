"""Document fingerprints by winnowing, with DataFrame functions only.

Every window of ``W`` consecutive ``K``-grams of code points selects its least
hash, the rightmost of equal ones; the selected (hash, position) pairs are the
fingerprint.  Two texts that share ``K + W - 1`` code points in a row share a
selected hash.

A gram's hash and place are packed in one long, hash first and places falling,
so that the least of a window is the rightmost of its least hashes.  Window
minima come from log2(W) element-wise minima of shifted arrays.  A text is cut
into overlapping segments, so its arrays stay small whatever its length.  With
every pair goes the first window that selects it: the fingerprint of a joined
text is then that of both parts and of the windows across the joint.

Defined results.  Null text is empty; an empty text's fingerprint has no pairs,
and two of them are alike (1.0).  A text shorter than a window has one window,
one shorter than a gram is one gram.  Equal texts have equal fingerprints.
The next document is the next row by ``doc_id`` (nulls first) and hash of text,
its like where a row is repeated; after the last row comes the first, and a
single row is its own next.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, plain

K, W = 8, 16
#: Code points in a row that are sure to be detected.
GUARANTEE = K + W - 1
SEGMENT = 1 << 14
#: Bytes of text, on average, for each task.
SHARE = 8 << 20
#: Bits of a packed long for a place (no string of the JVM is longer) and for the hash.
_PLACE, _HASH = 31, 32
_LAST = (1 << _PLACE) - 1


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _minima(packed: Column) -> Column:
    """At each place the least of the ``W`` values from there on."""
    if W & (W - 1):
        raise ValueError("W must be a power of two")

    def half(values: Column, shift: int) -> Column:
        if shift == W:
            return values
        least = F.zip_with(values, F.slice(values, 1 + shift, F.greatest(F.size(values), F.lit(1))), lambda a, b: F.least(a, b))
        return _let(least, lambda v: half(v, 2 * shift))

    return half(packed, 1)


def _segment(text: Column, at: Column, whole: bool) -> Column:
    """Structs (v: packed hash and place, w: first window) of a segment's windows; ``whole``: too few characters make one window."""
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{K}}}))."), F.lit(1))
    if whole:
        grams = F.when(F.char_length(text).between(1, K - 1), F.array(text)).otherwise(grams)

    def select(g: Column) -> Column:
        packed = F.transform(g, lambda x, i: F.shiftleft(F.xxhash64(x).bitwiseAND(F.lit((1 << _HASH) - 1)), _PLACE) + (F.lit(_LAST) - (at + i)))
        count = F.size(g) - F.lit(W - 1)
        if whole:
            count = F.when((count < 1) & (F.size(g) > 0), F.lit(1)).otherwise(count)
        return _let(F.slice(_let(packed, _minima), 1, F.greatest(count, F.lit(0))), changes)

    def changes(m: Column) -> Column:
        runs = F.transform(m, lambda x, i: F.when((i == 0) | (x != F.get(m, i - 1)), F.struct(x.alias("v"), (at + i).cast("long").alias("w"))))
        return F.filter(runs, lambda x: x.isNotNull())

    return _let(grams, select)


def winnow(text: Column) -> Column:
    """The fingerprint of a text as array<struct<v, w>>, by place."""
    reach = SEGMENT + GUARANTEE - 1
    parts = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{reach}}})).{{1,{SEGMENT}}}"), F.lit(1))
    long = F.flatten(F.transform(parts, lambda s, i: _segment(s, i.cast("long") * SEGMENT, whole=False)))
    # neighbouring segments may both select a gram near their joint; the first window is the earlier one's
    joined = _let(long, lambda p: F.filter(p, lambda x, i: (i == 0) | (x["v"] != F.get(p, i - 1)["v"])))
    return F.when(F.char_length(text) <= reach, _segment(text, F.lit(0).cast("long"), whole=True)).otherwise(joined)


def places(print_: Column) -> Column:
    """array<struct<hash, position>>: the fingerprint in its own terms."""
    return F.transform(print_, lambda x: F.struct(F.shiftrightunsigned(x["v"], _PLACE).alias("hash"), (F.lit(_LAST) - x["v"].bitwiseAND(F.lit(_LAST))).alias("position")))


def digest(print_: Column) -> Column:
    return F.sha2(F.array_join(F.transform(print_, lambda x: F.hex(x["v"])), ","), 256)


def _hashes(print_: Column) -> Column:
    return F.array_distinct(F.transform(print_, lambda x: F.shiftrightunsigned(x["v"], _PLACE)))


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes: twice those of both over those of each."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, places (array of hash and position), fingerprint (digest)."""
    base = plain(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return base.withColumn("p", winnow(F.col("text"))).select("doc_id", places(F.col("p")).alias("places"), digest(F.col("p")).alias("fingerprint"))


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the ascending cuts are less than a value: first among every so many, then between two of those."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if not groups:
        return F.lit(0)
    within = lambda given: F.size(F.filter(given, lambda c: c < value))
    coarse = within(F.lit([g[-1] for g in groups]))
    fine = within(F.coalesce(F.get(F.lit(groups), coarse), F.array().cast("array<bigint>")))
    return F.least(coarse * step, F.lit(len(cuts))) + fine


def _parts(rows: DataFrame, n: int) -> Column:
    """A number that ascends with (doc_id, h), nulls first, of which each value has about as many rows.

    An id that many rows carry (null is one) takes several numbers, by hash.
    """
    share = [(i + 1) / n for i in range(n - 1)] or [0.5]
    found = rows.agg(F.percentile_approx("doc_id", share, min(10 * n, 100_000)).alias("cuts"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    cuts: dict[int, int] = {}
    for c in found["cuts"] or []:
        if c is not None:
            cuts[c] = cuts.get(c, 0) + 1
    often = {c: m for c, m in cuts.items() if m > 1}
    none = found["nulls"] * n // max(1, found["n"]) + 1
    most = max([none, *often.values()]) + 1
    high = F.shiftright(F.col("h"), 32) + (1 << 31)  # the hash's upper half, ascending with it
    by_hash = lambda m: F.shiftright(high * m, 32)
    times = F.try_element_at(F.create_map(*[F.lit(x) for c in often.items() for x in c]), F.col("doc_id")) if often else F.lit(None).cast("int")
    own = F.when(F.col("doc_id").isNull(), by_hash(F.lit(none))).when(times.isNotNull(), 1 + by_hash(times)).otherwise(F.lit(0))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(1 + _below(list(cuts), F.col("doc_id"))).cast("long") * most + own


def _with_next(base: DataFrame) -> DataFrame:
    """``base`` (doc_id, text) with fingerprint and the next row's text and fingerprint; whole texts are shuffled once."""
    spark = base.sparkSession
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(spark.sparkContext.defaultParallelism, min(-(-size // SHARE), 25_000))  # tasks; more, smaller parts even them out
    rows = base.select("doc_id", "text", F.xxhash64("text").alias("h"))
    again = None
    repeated = materialise(rows.groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), (F.col("count") - 1).alias("more")), "winnowing-repeated")
    if not repeated.isEmpty():  # of rows that are repeated one is followed by the next document, the others by their like
        same = rows.doc_id.eqNullSafe(repeated.d) & (rows.h == repeated.g)
        one = rows.join(repeated, same).dropDuplicates(["doc_id", "h"])
        again = one.withColumn("p", winnow(F.col("text"))).select("doc_id", "text", "p", F.explode(F.sequence(F.lit(1).cast("long"), "more"))).drop("col")
        again = again.withColumns({"next_text": F.col("text"), "next_p": F.col("p")})
        rows = rows.join(repeated, same, "left_anti").unionByName(one.select("doc_id", "text", "h"))
    least = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = rows.withColumn("part", _parts(rows, 4 * n))
    # the first row of each part follows the last one of the part before: a copy goes there
    heads = sorted(rows.groupBy("part").agg(F.min(F.struct(least.alias("d"), "h")).alias("x")).select("part", "x.d", "x.h").collect())  # a row a part
    if not heads:
        return rows.select("doc_id", "text", F.lit("").alias("next_text")).withColumn("p", winnow(F.col("text"))).withColumn("next_p", F.col("p"))
    ahead = [(d, h, heads[i - 1][0]) for i, (_, d, h) in enumerate(heads)]
    ghosts = spark.createDataFrame(ahead, "d long, g long, part long")
    copies = rows.drop("part").join(F.broadcast(ghosts), (least == ghosts.d) & (rows.h == ghosts.g)).select("doc_id", "text", "h", "part").dropDuplicates(["part"])
    all_rows = rows.withColumn("ghost", F.lit(False)).unionByName(copies.withColumn("ghost", F.lit(True))).repartition(n, "part")
    printed = all_rows.withColumn("p", winnow(F.col("text")))
    w = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.col("h"))
    out = printed.withColumn("next_text", F.lead("text").over(w)).withColumn("next_p", F.lead("p").over(w))
    out = out.where("not ghost").select("doc_id", "text", "p", "next_text", "next_p")
    return out if again is None else out.unionByName(again.select(out.columns))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter (floor of n_chars / 4 code points)
    replaced by as many of the first code points of the next document.
    """
    base = plain(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, m, kept, lent = F.col("n"), F.col("m"), F.col("kept"), F.col("lent")
    df = _with_next(base).withColumn("n", F.char_length("text").cast("long")).withColumn("m", F.floor(n / 4)).withColumn("kept", n - m)
    df = df.withColumn("tail", F.substring("next_text", F.lit(1), m.cast("int"))).withColumn("lent", F.char_length("tail").cast("long"))
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), kept.cast("int")), F.col("tail")))
    from_ = F.greatest(kept - (GUARANTEE - 1), F.lit(0))
    df = df.withColumn("from_", from_).withColumn("joint", F.substring("edited", (F.col("from_") + 1).cast("int"), (kept - F.col("from_") + GUARANTEE - 1).cast("int")))
    moved = lambda x: F.struct((x["v"] - kept).alias("v"), (x["w"] + kept).alias("w"))  # noqa: E731  places fall in v
    before = F.filter("p", lambda x: x["w"] <= kept - GUARANTEE)
    across = _segment(F.col("joint"), F.col("from_"), whole=False)
    after = F.transform(F.filter("next_p", lambda x: x["w"] <= lent - GUARANTEE), moved)
    pieces = F.concat(before, across, after)
    merged = _let(pieces, lambda p: F.filter(p, lambda x, i: (i == 0) | (x["v"] != F.get(p, i - 1)["v"])))
    short = (kept + lent) < GUARANTEE
    edited_p = F.when(m == 0, F.col("p")).when(short, _segment(F.col("edited"), F.lit(0).cast("long"), whole=True)).otherwise(merged)
    df = df.withColumn("edited_p", edited_p)
    df = df.withColumn("a", _hashes(F.col("p"))).withColumn("b", _hashes(F.col("edited_p"))).withColumn("c", _hashes(F.col("next_p")))
    return df.select(
        "doc_id",
        n.alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("p")).alias("fingerprint"),
        digest(F.col("edited_p")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
