"""Benchmark decontamination by spaced-seed hashing, from DataFrame operations alone.

A fixed mask says which neighbouring tokens are hashed; the others may differ. Test and training
texts are hashed at every position under every mask and joined on the hash. Around each hit both
texts are laid beside each other over the item's whole length, and the stretch with most equal
tokens is taken of those in which a share of SHARE is equal. A substituted word thus costs one
token, not the match.

No stretch that passes is without a hit. A stretch of 32 tokens or more has a half that passes too
(16 tokens or more, three quarters equal), so those of up to 31 are all there is to hit, and the
tests go through all of them; items of fewer than LONG tokens have masks of their own.

The test side is broadcast while its seeds, which are counted first, number at most
BROADCAST_SEEDS (some 20 MB, with the items); beyond that the join shuffles by seed, without texts,
and the tokens of documents and items are joined with the pairs that it finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import id_and_text

#: Token offsets that each mask reads, for items of LONG tokens or more. Where a hit has an equal
#: token before it, the run of equal tokens that this is in begins with a hit too: that of the first
#: mask, here and in short_masks().
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4))
LONG = 16

#: The share of equal tokens that a stretch takes; fewer equal tokens than LEAST never do, unless
#: three quarters of the item are no more.
SHARE, LEAST = 0.75, 12

BROADCAST_SEEDS = 200_000


def _tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits of a text, in lower case."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def short_masks(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks for an item of n tokens, fewer than LONG: of ceil(SHARE * n) equal ones some mask hits three."""
    if n < 3:
        return (tuple(range(n)),)
    return ((0, 1, 2), *(((0, 1, 3),) if n in (4, 5, 8) else ()), *(((0, 2, 3),) if n == 4 else ()))


def _mask_seeds(tokens: str, m: int, mask: tuple[int, ...]) -> Column:
    """A seed for each token that the mask can begin at; null where it leaves the text."""

    def seed(x: Column, i: Column) -> Column:
        rest = [F.get(F.col(tokens), i + o) for o in mask[1:]]
        return F.when(i + mask[-1] < F.size(tokens), F.xxhash64(F.lit(m), x, *rest))

    return F.transform(tokens, seed)


def _seeded(rows: DataFrame, tokens: str, masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """rows once for each seed, with columns seed and at, the position of its first token."""
    keep = rows.columns
    all_seeds = F.concat(*[_mask_seeds(tokens, m, mask) for m, mask in masks])
    # The outer form keeps Spark from testing the array beforehand, which would compute it twice.
    out = rows.withColumn("_seeds", all_seeds).select(*keep, F.posexplode_outer("_seeds").alias("_at", "seed")).where("seed IS NOT NULL")
    return out.withColumn("at", F.pmod(F.col("_at"), F.size(tokens))).drop("_at")


def _best_stretch(hits: DataFrame) -> DataFrame:
    """hits (item, tokens, shift, ...) with best: n_equal, share and -first_token of the stretch.

    A stretch begins with the first and ends with the last token of runs of equal ones, so only
    those are tried. Every array that a lambda reads is a column of an earlier step.
    """
    keep = [c for c in hits.columns if c not in ("item", "tokens")]
    # The item's tokens from lo to hi stand beside the document's from lo + shift to hi + shift.
    lo = F.greatest(F.lit(0), -F.col("shift"))
    size = F.least(F.size("item"), F.size("tokens") - F.col("shift")) - lo
    out = hits.withColumn("_a", F.slice("item", lo + 1, size)).withColumn("_b", F.slice("tokens", lo + F.col("shift") + 1, size))
    places = F.transform(F.zip_with("_a", "_b", lambda x, y: x == y), lambda same, i: F.when(same, i))
    out = out.withColumn("_q", F.filter(places, lambda i: i.isNotNull()))  # places of equal tokens
    out = out.select(*keep, (lo + F.col("shift")).alias("_from"), F.when(F.size("_q") >= F.col("least"), F.col("_q")).alias("_q"))
    numbers = F.transform("_q", lambda q, k: F.struct(k.alias("k"), q.alias("q")))
    out = out.withColumn("_n", numbers)
    out = out.withColumns({
        "_starts": F.filter("_n", lambda x: (x["k"] == 0) | (F.get(F.col("_q"), x["k"] - 1) != x["q"] - 1)),
        "_ends": F.filter("_n", lambda x: (x["k"] == F.size("_q") - 1) | (F.get(F.col("_q"), x["k"] + 1) != x["q"] + 1)),
    })

    def stretch(start: Column, end: Column) -> Column:
        equal = (end["k"] - start["k"] + 1).cast("long")
        share = equal / (end["q"] - start["q"] + 1)
        return F.struct(equal.alias("n_equal"), share.alias("share"), (-(F.col("_from") + start["q"])).alias("back"))

    def fits(start: Column, end: Column) -> Column:
        return (start["k"] <= end["k"]) & (end["k"] - start["k"] + 1 >= SHARE * (end["q"] - start["q"] + 1))

    # Of an end's stretches the longest; its own run fits at least.
    longest = F.transform("_ends", lambda end: F.struct(F.get(F.filter("_starts", lambda start: fits(start, end)), 0).alias("start"), end.alias("end")))
    out = out.withColumns({"_first": F.get(F.col("_starts"), 0), "_last": F.get(F.col("_ends"), F.size("_ends") - 1)})
    whole = F.array(F.struct(F.col("_first").alias("start"), F.col("_last").alias("end")))
    out = out.withColumn("_found", F.when(F.col("_q").isNotNull(), F.when(fits(F.col("_first"), F.col("_last")), whole).otherwise(longest)))
    best = F.array_max(F.transform("_found", lambda x: stretch(x["start"], x["end"])))
    return out.withColumn("best", best).select(*keep, "best")


def _held(docs: DataFrame, benchmark: DataFrame, item_col: str) -> DataFrame:
    """doc_id, doc_key (a hash of the text), item_id and best of every row of docs that holds an item."""
    items = id_and_text(benchmark, item_col).select(F.col("doc_id").alias("item_id"), _tokens(F.col("text")).alias("item"))
    items = items.where(F.size("item") > 0).dropDuplicates(["item_id", "item"]).withColumn("item_key", F.xxhash64("item_id", "item"))
    lengths = items.where(F.size("item") < LONG).select(F.size("item").alias("n")).distinct().collect()  # fewer than LONG rows
    masks_of = {r["n"]: short_masks(r["n"]) for r in lengths}
    masks = [*enumerate(dict.fromkeys([*MASKS, *(m for n in sorted(masks_of) for m in masks_of[n])]))]
    base = _seeded(items.where(F.size("item") >= LONG), "item", masks[: len(MASKS)])
    for n, own in masks_of.items():
        base = base.unionByName(_seeded(items.where(F.size("item") == n), "item", [(m, mask) for m, mask in masks if mask in own]))
    base = base.select("seed", "item_key", F.col("at").alias("item_at"), F.get(F.col("item"), F.col("at") - 1).alias("before"))
    rows = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("doc_key"), _tokens(F.col("text")).alias("tokens"))
    hits = _seeded(rows, "tokens", masks)
    # Of a run of equal tokens the first hit is enough, for all have the same shift.
    first = ~F.coalesce(F.col("before") == F.get(F.col("tokens"), F.col("at") - 1), F.lit(False))
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    if base.count() <= BROADCAST_SEEDS:
        # Nothing moves before a hit is found, so what it is compared with is the document itself.
        hits = hits.join(F.broadcast(base), "seed").where(first).select("doc_id", "doc_key", "tokens", "item_key", shift)
        hits = hits.join(F.broadcast(items), "item_key")
    else:
        # A seed that many documents have meets each item of it once for each different text.
        hits = hits.select("doc_key", "seed", "at", F.get(F.col("tokens"), F.col("at") - 1).alias("doc_before")).join(base, "seed")
        first = ~F.coalesce(F.col("before") == F.col("doc_before"), F.lit(False))
        hits = hits.where(first).select("doc_key", "item_key", shift).distinct()
        hits = hits.join(items, "item_key").join(rows, "doc_key")
    hits = hits.select("doc_id", "doc_key", "item_id", "item", "tokens", "shift", F.least(F.lit(LEAST), F.ceil(F.size("item") * SHARE)).alias("least"))
    hits = _best_stretch(hits)
    # The test follows the aggregation, for as a join condition it would be applied to each token.
    passes = F.col("best")["n_equal"] >= F.col("least")
    return hits.groupBy("doc_id", "doc_key", "item_id").agg(F.max(F.when(passes, F.col("best"))).alias("best")).where("best IS NOT NULL")


def leaks(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_equal, share and first_token of every document that holds an item.

    One row for each pair: of its stretches that pass, the one with most equal tokens (then the
    largest share, then the earliest). Null and empty texts hold nothing, items without tokens
    are held by nothing; an item of one or two tokens is held by every document that has them.
    Texts are compared whole, whatever their length. Repeated documents or items do not repeat a
    pair, rows without doc_id are one document here; other columns, also of equal names in both
    tables, are ignored; an empty table on either side gives no rows.
    """
    found = _held(docs, benchmark, item_col).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return found.select("doc_id", "item_id", "best.n_equal", "best.share", (-F.col("best.back")).alias("first_token"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id") -> DataFrame:
    """Rows of docs that hold no item, with their columns as they were.

    Rows are judged one by one: of those without doc_id, or with the same one, only those go whose
    own text holds an item. Null and empty texts stay, repeated rows stay or go together, and an empty
    benchmark removes nothing.
    """
    held = _held(docs, benchmark, item_col).select(F.col("doc_id").alias("_held"), F.col("doc_key").alias("_held_text")).distinct()
    own = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(held, docs["doc_id"].cast("long").eqNullSafe(F.col("_held")) & (own == F.col("_held_text")), "left_anti")
