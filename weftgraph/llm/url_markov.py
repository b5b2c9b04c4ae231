"""URL filters: rules, and a character language-model ratio for what no rule decides.

Two variable-order Markov models, of accepted and of rejected URLs, give each character a
probability after the ORDER characters before it, smoothed by Witten and Bell's interpolation
down to a uniform distribution. A URL is accepted if the difference of its log-likelihoods,
divided by its length, reaches a threshold that is calibrated on labelled URLs which the
models did not see. Everything is DataFrame operations.

Grams are counted by themselves, so a model grows with the texts it has seen. Counting combines on
the map side. For scoring, each distinct gram gets its value by joins on grams and contexts, a key of
which meets no more rows than there are different characters. Characters are then joined with these
values: by broadcast while the values, which are counted first, number at most BROADCAST_GRAMS, so
that only a URL's partial sums are shuffled; beyond that by gram, without the grams that make up more
than one in HEAVY characters, which are fewer than HEAVY and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import stash

#: Characters of context; sign before a URL's start.
ORDER, START = 3, "^"

#: Grams whose values are broadcast (some 20 MB); a share of characters that makes a gram a heavy one.
BROADCAST_GRAMS, HEAVY = 200_000, 1000

#: Of labelled URLs, one in CALIBRATE calibrates; bins of the threshold's histogram.
CALIBRATE, BINS = 5, 400

#: Characters that the uniform distribution is over.
ALPHABET = 256.0

#: The rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or lacks '://'."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none does."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, begin in reversed(ranked):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(begin)
        name = F.when(fits, F.lit(at + begin)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _grams(url: Column) -> Column:
    """The grams of a URL with ORDER characters of context, one for each character; null if empty."""
    padded = F.concat(F.lit(START * ORDER), url)
    grams = F.transform(F.sequence(F.lit(1), F.length(url)), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))
    return F.when(F.length(url) > 0, grams)


def _last(gram: str, order: int) -> Column:
    """The gram's last character with that many of context."""
    return F.substring(gram, -(order + 1), order + 1)


def fit(labelled: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per order two tables: log ratios of grams (g, v), and of the back-off weights of contexts
    (ctx, v).

    labelled has url and accepted (boolean). A class without URLs is uniform.
    """
    one = F.col("accepted").cast("long")
    counts = labelled.select("accepted", F.explode(_grams(F.col("url"))).alias("gram"))
    counts = stash(counts.groupBy("gram").agg(F.sum(one).alias("n1"), F.sum(1 - one).alias("n0")), "url-counts")
    lower, out = None, []
    for order in range(ORDER + 1):
        grams = counts.groupBy(_last("gram", order).alias("g")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        grams = grams.withColumns({"ctx": F.substring("g", 1, order), "lower": F.substring("g", 2, order)})
        sums = [f(c) for c in ("n1", "n0") for f in (lambda c: F.sum(c).alias(f"c{c}"), lambda c: F.sum((F.col(c) > 0).cast("int")).alias(f"t{c}"))]
        contexts = grams.groupBy("ctx").agg(*sums)

        def back(c: str) -> Column:
            """The share of a context's probability that goes to the shorter one."""
            seen = F.col(f"c{c}") + F.col(f"t{c}")
            return F.when(seen > 0, F.col(f"t{c}") / seen).otherwise(F.lit(1.0))

        joined = grams.join(contexts, "ctx")
        if lower is None:
            joined = joined.withColumns({"l1": F.lit(1 / ALPHABET), "l0": F.lit(1 / ALPHABET)})
        else:
            joined = joined.join(lower, "lower")
        for c in ("n1", "n0"):
            seen = F.col(f"c{c}") + F.col(f"t{c}")
            own_share = F.when(seen > 0, F.col(c) / seen).otherwise(F.lit(0.0))
            joined = joined.withColumn(f"p{c[1]}", own_share + back(c) * F.col(f"l{c[1]}"))
        probabilities = stash(joined.select("g", "p1", "p0"), f"url-order{order}")
        ratio = probabilities.select("g", F.log(F.col("p1") / F.col("p0")).alias("v"))
        weight = contexts.select("ctx", F.log(back("n1") / back("n0")).alias("v"))
        out.append((ratio, stash(weight, f"url-weight{order}")))
        lower = probabilities.select(F.col("g").alias("lower"), F.col("p1").alias("l1"), F.col("p0").alias("l0"))
    return out


def _values(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """_gram, n and v: the log ratio that the model gives to each of the grams (_gram, n)."""
    lower = None
    for order, (ratios, weights) in enumerate(model):
        if order < ORDER:
            rows = grams.select(_last("_gram", order).alias("g")).distinct()
        else:
            rows = grams.withColumn("g", F.col("_gram"))
        rows = rows.withColumns({"ctx": F.substring("g", 1, order), "lower": F.substring("g", 2, order)})
        rows = rows.join(ratios.withColumnRenamed("v", "_r"), "g", "left").join(weights.withColumnRenamed("v", "_w"), "ctx", "left")
        rows = rows.withColumn("_l", F.lit(0.0)) if lower is None else rows.join(lower, "lower")
        rows = rows.withColumn("v", F.coalesce("_r", F.coalesce("_w", F.lit(0.0)) + F.col("_l")))
        lower = rows.select(F.col("g").alias("lower"), F.col("v").alias("_l"))
    return rows.select("_gram", "n", "v")


def with_score(rows: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """rows (a column url, and keys of which _row tells them apart) with score.

    That is the length-normalised difference of the log-likelihoods, 0 for an empty URL. It is
    summed in millionths, so that no order of summing changes it.
    """
    keys = rows.columns
    grams = rows.select(F.explode(_grams(F.col("url"))).alias("_gram")).groupBy("_gram").agg(F.count("*").alias("n"))
    values = stash(_values(stash(grams, "url-grams"), model), "url-values")
    summed = F.sum(F.round(F.coalesce("v", F.lit(0.0)) * 1e6).cast("long")).alias("_sum")
    if values.count() <= BROADCAST_GRAMS:
        out = rows.withColumn("_gram", F.explode_outer(_grams(F.col("url"))))
        out = out.join(F.broadcast(values.select("_gram", "v")), "_gram", "left").groupBy(*keys).agg(summed)
    else:
        total = values.agg(F.sum("n")).first()[0]
        heavy = values.where(F.col("n") * HEAVY > total).select("_gram", "v")  # fewer than HEAVY rows
        light = values.where(F.col("n") * HEAVY <= total).select("_gram", "v")
        chars = rows.select("_row", F.explode(_grams(F.col("url"))).alias("_gram"))
        near = chars.join(F.broadcast(heavy), "_gram")
        far = chars.join(F.broadcast(heavy.select("_gram")), "_gram", "left_anti").join(light, "_gram")
        out = rows.join(near.unionByName(far).groupBy("_row").agg(summed), "_row", "left")
    score = F.coalesce("_sum", F.lit(0)) / 1e6 / F.greatest(F.length("url"), F.lit(1))
    return out.select(*keys, score.alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the threshold with the best sum of both classes' accuracies.

    scored has score and accepted. Scores are laid in BINS bins, so the tables here have a fixed
    size. Without labelled rows the threshold is 0.
    """
    low, high = -4.0, 4.0
    place = F.least(F.greatest(F.floor((F.col("score") - low) / (high - low) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    one = F.col("accepted").cast("long")
    bins = scored.groupBy(place.alias("bin")).agg(F.sum(one).alias("n1"), F.sum(1 - one).alias("n0"))
    table = bins.agg(F.collect_list(F.struct("bin", "n1", "n0")).alias("b"))  # at most BINS entries
    n1 = F.greatest(F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x["n1"]), F.lit(1))
    n0 = F.greatest(F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x["n0"]), F.lit(1))

    def gain(k: Column) -> Column:
        kept = F.aggregate(F.filter("b", lambda x: x["bin"] >= k), F.lit(0).cast("long"), lambda s, x: s + x["n1"])
        dropped = F.aggregate(F.filter("b", lambda x: x["bin"] < k), F.lit(0).cast("long"), lambda s, x: s + x["n0"])
        return kept / n1 + dropped / n0

    # Of equally good bins the middle one.
    gains = F.transform(F.sequence(F.lit(0), F.lit(BINS)), lambda k: F.struct(gain(k).alias("gain"), k.alias("bin")))
    table = table.withColumn("g", gains).withColumn("top", F.array_max(F.transform("g", lambda x: x["gain"])))
    best = F.transform(F.filter("g", lambda x: x["gain"] >= F.col("top") - 1e-12), lambda x: x["bin"])
    middle = F.get(best, F.floor(F.size(best) / 2).cast("int"))
    return table.select(F.when(F.size("b") > 0, middle * (high - low) / BINS + low).otherwise(0.0).alias("least"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page.

    URLs that a rule decides are the labelled ones: allowed is accepted, blocked is rejected.
    All others get the verdict of the model. A null URL, like one without '://', has an empty
    host and path, fits no rule and is judged by its characters (none: score 0). Rows are judged
    one by one, so ties and repeated rows agree; other columns are ignored; no rows give none.
    """
    host, path = split_url(F.col("_url"))
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("_url"))
    rows = rows.select("page_id", F.coalesce("_url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("said", verdict).withColumn("_row", F.monotonically_increasing_id())
    rows = stash(rows, "urls")
    labelled = rows.where("said IS NOT NULL").withColumn("accepted", F.col("said") == "allow")
    apart = F.pmod(F.xxhash64("url"), F.lit(CALIBRATE)) == 0
    model = fit(labelled.where(~apart))
    calibration = with_score(labelled.where(apart).select("_row", "url", "accepted"), model)
    least = stash(threshold(calibration), "url-threshold").first()["least"]
    scored = with_score(rows, model)
    said = F.when(F.col("score") >= least, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", said).alias("verdict"), "score")
