"""Document fingerprints: Order MinHash, from DataFrame operations alone.

A text's k-mers are runs of K tokens; each is numbered by its occurrences, so that repeats
count. The hash of (k-mer, occurrence) is the one random order of all k-mers; its leading bits
deal them over BINS bins, and of each bin the two smallest are selected (in a text with many
k-mers, binning one order takes the place of BINS independent orders, at a BINSth of the cost).
What a bin lacks of two k-mers it takes from the whole text, by an order of its own: short texts
have nearly independent orders, and as each bin goes by what it holds, not by the text's size, texts
of somewhat different sizes agree. The selected k-mers of a bin are put back into the order of the
text and the tuple is hashed: moving or changing parts of a text changes tuples as its edit distance
grows. A signature lists (bin, tuple hash); the likeness of two texts is the share of bins with
equal tuples.

Tokens are words between white space, cut after WORD_CHARS characters; in scripts that are written
without spaces each character is a token. The rule looks at characters alone, so that parts of a
text have the same tokens whatever stands around them.

A k-mer's hash is sorted together with its position, in one long, so all steps are sorts and scans of
arrays of longs within a row. Position and hash have the same number of bits in every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import id_and_text

#: Tokens of a k-mer; bins (a power of two) and its bits.
K, BINS, BIN_BITS = 3, 64, 6

#: Characters of a token at most, and those that are tokens of their own.
WORD_CHARS = 16
ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
SPACE = r" \t\n\r\f\x0B"

#: Bits of a position; a string of at most 2 GB has no more than 2 ** 30 tokens (those of one byte
#: are parted by white space). The hash has the other 34.
POSITION_BITS = 30

#: Documents of a bucket of neighbours, on average, and the number of quantiles of ids.
NEIGHBOURS, QUANTILES = 512, 256


def tokens(text: Column) -> Column:
    """The tokens of a text column; an empty one has one empty token."""
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    each = F.regexp_extract_all(text, F.lit(f"[{ALONE}]|[^{ALONE}{SPACE}]{{1,{WORD_CHARS}}}"), F.lit(0))
    # Where no word is to be cut, both say the same, and the first is quicker.
    found = F.when(text.rlike(f"[{ALONE}]|[^{SPACE}]{{{WORD_CHARS + 1}}}"), each).otherwise(words)
    return F.when(text.rlike(f"[^{SPACE}]"), found).otherwise(F.array(F.lit("")))


def with_signature(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with a column of that name: the signature of column text, an array of longs.

    A null text is like an empty one, whose only token is empty. Every array that a lambda reads
    is a column of an earlier step, so that none is computed once per element.
    """
    keep = rows.columns
    t, h, s, first, more, all_ = (f"_{name}_{x}" for x in ("t", "h", "s", "first", "more", "all"))
    again, every, single, empty, full = (f"_{name}_{x}" for x in ("again", "every", "single", "empty", "full"))

    def hash_of(x: Column) -> Column:
        return F.shiftright(x, POSITION_BITS)

    def position(x: Column) -> Column:
        return x.bitwiseAND((1 << POSITION_BITS) - 1)

    def packed(value: Column, at: Column) -> Column:
        return F.shiftleft(hash_of(value), POSITION_BITS).bitwiseOR(at)

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, 64 - BIN_BITS)

    def two_of_bin(array: str) -> Column:
        return F.filter(array, lambda x, i: (i < 2) | (bin_of(F.get(F.col(array), i - 2)) != bin_of(x)))

    def starts(x: Column, i: Column) -> Column:
        return (i == 0) | (hash_of(F.get(F.col(s), i - 1)) != hash_of(x))

    out = rows.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.select(*keep, F.transform(tokens(F.col(t)), lambda x: F.xxhash64(x)).alias(h))
    size = F.greatest(F.size(h) - (K - 1), F.lit(1))
    kmers = F.transform(h, lambda x, i: packed(F.xxhash64(x, *[F.get(F.col(h), i + j) for j in range(1, K)]), i.cast("long")))
    out = out.withColumn(s, F.sort_array(F.slice(kmers, 1, size)))
    # First occurrences, which have their k-mer's own hash, and the two smallest of each bin.
    out = out.withColumn(first, F.filter(s, starts))
    begin = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: starts(F.get(F.col(s), i), i))
    out = out.withColumn(more, F.when(F.size(first) < F.size(s), begin))
    at = lambda r: F.get(F.col(more), r)
    length = lambda r: F.coalesce(at(r + 1), F.size(s)) - at(r)
    later = F.flatten(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(more) - 1), lambda r: length(r) > 1),
        lambda r: F.transform(F.sequence(F.lit(1), length(r) - 1), lambda o: packed(
            F.xxhash64(hash_of(F.get(F.col(s), at(r))), o), position(F.get(F.col(s), at(r) + o)))),
    ))
    out = out.withColumn(again, F.when(F.col(more).isNotNull(), later))
    few = F.filter(first, lambda x, i: (i < 2) | (bin_of(F.get(F.col(first), i - 2)) != bin_of(x)))
    out = out.withColumn(all_, F.when(F.col(more).isNull(), few).otherwise(F.sort_array(F.concat(few, again))))
    out = out.withColumn(all_, F.when(F.col(more).isNull(), F.col(all_)).otherwise(two_of_bin(all_)))

    def bin_at(i: Column) -> Column:
        return F.coalesce(bin_of(F.get(F.col(all_), i)), F.lit(BINS).cast("long"))

    def entry(b: Column, x: Column, y: Column) -> Column:
        swapped = position(y) < position(x)
        value = F.when(y.isNull(), F.xxhash64(hash_of(x))).when(swapped, F.xxhash64(hash_of(y), hash_of(x))).otherwise(F.xxhash64(hash_of(x), hash_of(y)))
        return F.shiftleft(b + BINS // 2, 32).bitwiseOR(value.bitwiseAND(0xFFFFFFFF))

    def of_two(x: Column, i: Column) -> Column:
        return F.when((bin_at(i - 1) != bin_of(x)) & (bin_at(i + 1) == bin_of(x)), entry(bin_of(x), x, F.get(F.col(all_), i + 1)))

    # All k-mers, where some bin lacks one; and the bins that lack one or two.
    lacks = F.size(all_) < 2 * BINS
    out = out.withColumn(every, F.when(lacks & F.col(more).isNull(), F.col(first)).when(lacks, F.concat(first, again)))
    out = out.withColumn(full, F.filter(F.transform(all_, of_two), lambda x: x.isNotNull()))
    out = out.withColumn(single, F.when(lacks, F.filter(all_, lambda x, i: (bin_at(i - 1) != bin_of(x)) & (bin_at(i + 1) != bin_of(x)))))
    bins = F.sequence(F.lit(-BINS // 2).cast("long"), F.lit(BINS // 2 - 1).cast("long"))
    out = out.withColumn(empty, F.when(lacks, F.array_except(bins, F.transform(all_, bin_of))))

    def place(b: Column, x: Column, i: Column) -> Column:
        """The k-mer's place in the bin's own order, together with its index."""
        return packed(F.xxhash64(hash_of(x), b), i.cast("long"))

    def kmer(key: Column) -> Column:
        return F.get(F.col(every), position(key).cast("int"))

    def other(x: Column) -> Column:
        return F.array_min(F.transform(every, lambda y, i: F.when(y != x, place(bin_of(x), y, i))))

    def smallest(b: Column) -> Column:
        return F.slice(F.sort_array(F.transform(every, lambda y, i: place(b, y, i))), 1, 2)

    out = out.withColumn(single, F.transform(single, lambda x: F.struct(x.alias("x"), other(x).alias("y"))))
    out = out.withColumn(empty, F.transform(empty, lambda b: F.struct(b.alias("b"), smallest(b).alias("two"))))
    ones = F.transform(single, lambda z: entry(bin_of(z["x"]), z["x"], kmer(z["y"])))
    twos = F.transform(empty, lambda z: entry(z["b"], kmer(F.get(z["two"], 0)), kmer(F.get(z["two"], 1))))
    filled = F.sort_array(F.concat(F.col(full), ones, twos))
    return out.select(*keep, F.when(F.col(every).isNull(), F.col(full)).otherwise(filled).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of bins with equal tuples (0 to 1)."""
    same = F.size(F.array_intersect(a, b))
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return same.cast("double") / bins


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.hex(x)), ".")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and signature of every whole text; repeated rows agree, other columns are ignored."""
    return with_signature(id_and_text(docs, id_col, text_col), "text", "signature").select("doc_id", "signature")


def _buckets(rows: DataFrame) -> tuple[Column, Column]:
    """Two numbers by which rows (doc_id, _hash) lie in buckets of neighbours, in the order of both.

    The first is the interval between two quantiles of the ids, or -1 of null ones. Within it
    ids are cut into equal widths; an id that fills an interval is cut by the hash of the text.
    """
    ids = rows.select("doc_id")
    shares = [k / QUANTILES for k in range(QUANTILES + 1)]
    bounds, n = ids.agg(F.percentile_approx("doc_id", shares, 20 * QUANTILES), F.count("*")).first()
    bounds = bounds or [0, 0]
    parts = max(1, n // (QUANTILES * NEIGHBOURS))
    starts = bounds[:-1]
    at = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in starts]), lambda b: b <= F.col("doc_id"))) - 1
    at = F.when(F.col("doc_id").isNull(), -1).otherwise(F.greatest(at, F.lit(0)))
    low, high = (F.get(F.array(*[F.lit(b).cast("long") for b in x]), F.col("_at")) for x in (starts, bounds[1:]))
    inside = F.floor((F.col("doc_id").cast("double") - low.cast("double")) / F.greatest((high.cast("double") - low.cast("double")) / parts, F.lit(1.0)))
    bits = max(1, (4 * parts).bit_length())
    by_hash = F.shiftright(F.col("_hash"), 64 - bits) + (1 << (bits - 1))
    crowded = [k for k, b in enumerate(starts) if b in starts[:k] or b == bounds[k + 1]]
    full = F.col("doc_id").isNull() | (F.col("_at").isin(*crowded) & (F.col("doc_id") == low))
    # Ids that follow a crowded one in its interval come after all of its buckets.
    return at, F.when(full, by_hash).otherwise(inside + F.when(F.col("_at").isin(*crowded), 1 << bits).otherwise(0)).cast("long")


def with_next(rows: DataFrame, values: list[str]) -> DataFrame:
    """rows (doc_id, text, ...) with next_ columns: values of the next row, and of the first
    after the last.

    Rows follow each other by doc_id (nulls first), equal ids by their texts' hashes and texts. They
    are dealt over buckets of about NEIGHBOURS neighbours, so no task orders the table. The last row
    of a bucket gets the first one of the next bucket that is not empty.
    """
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    ids = rows.select("doc_id", "_hash")
    at, inside = _buckets(ids)
    bucket = ["_at", "_in"]
    used = ids.withColumn("_at", at).withColumn("_in", inside).groupBy(*bucket).count()
    # The first bucket of each interval: QUANTILES + 1 rows at most.
    firsts = sorted((r["_at"], r["_in"]) for r in used.groupBy("_at").agg(F.min("_in").alias("_in")).collect())
    rows = rows.withColumn("_at", at).withColumn("_in", inside)
    order = Window.partitionBy(*bucket).orderBy("doc_id", "_hash", "text")
    after = {a: b for (a, _), b in zip(firsts, [*firsts[1:], *firsts[:1]], strict=True)}
    jump = F.coalesce(*[F.when(F.col("_at") == a, F.struct(F.lit(x).alias("_at"), F.lit(y).cast("long").alias("_in"))) for a, (x, y) in after.items()], F.lit(None).cast("struct<_at:int,_in:bigint>"))
    near = F.lead("_in").over(Window.partitionBy("_at").orderBy("_in"))
    follow = used.select(*bucket, F.when(near.isNotNull(), F.struct("_at", near.alias("_in"))).otherwise(jump).alias("_after"))
    heads = rows.withColumn("_before", F.lag(F.lit(1)).over(order)).where("_before IS NULL")
    heads = heads.select(F.struct(*bucket).alias("_after"), F.struct(*values).alias("_head"))
    heads = follow.join(heads, "_after").drop("_after")
    # Plain columns only, here and above: then both windows read one and the same shuffle.
    inner = rows.withColumns({"_more": F.lead(F.lit(1)).over(order), **{f"next_{v}": F.lead(v).over(order) for v in values}})
    out = inner.join(heads, bucket, "left")
    nexts = {f"next_{v}": F.when(F.col("_more").isNotNull(), F.col(f"next_{v}")).otherwise(F.col("_head")[v]) for v in values}
    return out.withColumns(nexts).drop(*bucket, "_hash", "_more", "_head")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the
    first of the next document (or all, if it has fewer). A null text is an empty one; of a
    single document the next one is itself; repeated rows and ties follow each other, rows without
    doc_id come first; texts are taken whole, whatever their length; other columns are ignored and
    no rows give none.
    """
    rows = with_signature(id_and_text(docs), "text", "sig")
    rows = with_next(rows, ["text", "sig"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sig", "next_sig", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_signature(rows, "edited", "edited_sig")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
