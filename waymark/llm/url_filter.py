"""Operator 2, URL filters: host rules first, then a character language-model ratio. Native.

Two smoothed variable-order Markov models over a folded alphabet of SYMBOLS signs, one of the
URLs that the rules allow and one of those they block, score every URL: the mean over its signs
of log P(sign | context, allowed) - log P(sign | context, blocked). Each probability interpolates
the orders 0 to ORDER (Witten-Bell: the weight of a shorter context is the number of distinct
signs seen after the longer one). A threshold on the mean, calibrated on held-out rule-labelled
URLs by balanced accuracy, gives the verdict.

The two models together have at most SYMBOLS ** (ORDER + 1) entries whatever the input, so one
scalar subquery carries them to the tasks; counts are aggregated over every labelled URL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import whole

#: (verdict, host, path): a rule holds for the host and its subdomains where the path starts so.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Letters keep apart; digits, and other marks by kind, fold together: 32 signs, 0 is a context's pad.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SYMBOLS, ORDER = 32, 2
#: Every HOLD_OUT-th labelled URL (by a hash of it) only calibrates the threshold.
HOLD_OUT = 5
#: Width of a bin of the calibration histogram; scores are clipped to +-CLIP, so bins are bounded.
BIN, CLIP = 0.005, 20.0


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), LETTERS.upper(), LETTERS)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))), F.lit(""))


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits (null where none does)."""
    fits = [
        (verdict, host + path, ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path))
        for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    ]
    if not fits:
        return df.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    return df.withColumns(
        {
            "rule": F.coalesce(*(F.when(ok, F.lit(name)) for _, name, ok in fits)),
            "rule_verdict": F.coalesce(*(F.when(ok, F.lit(verdict)) for verdict, _, ok in fits)),
        }
    )


def _signs(url: Column) -> Column:
    """The URL's signs as numbers 1 .. SYMBOLS - 1, after its scheme."""
    text = F.regexp_replace(F.lower(F.coalesce(_rest(url), F.lit(""))), r"[^\x00-\x7F]", "~")
    text = F.regexp_replace(text, "[0-9]", "0")
    text = F.regexp_replace(text, "[?&=#]", "=")
    text = F.regexp_replace(text, "[^a-z0/.=]", "~")
    # code points shifted so that each class has one number
    table = {c: k + 1 for k, c in enumerate(LETTERS)} | {"0": 27, "/": 28, ".": 29, "=": 30, "~": 31}
    coded = F.translate(text, "".join(table), "".join(chr(0x100 + k) for k in table.values()))
    return F.transform(F.filter(F.split(coded, ""), lambda c: c != ""), lambda c: F.ascii(c) - F.lit(0x100))


def _slots(signs: Column) -> Column:
    """For each position the number that packs its ORDER signs before (0: none) and itself."""

    def packed(own: Column) -> Column:
        before = lambda i, k: F.coalesce(F.get(own, i - F.lit(k)), F.lit(0)) * F.lit(SYMBOLS**k)
        return F.transform(own, lambda sign, i: sum((before(i, k) for k in range(1, ORDER + 1)), sign))

    return _let(signs, packed)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for each row, not once for each mention or element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ratio_model(labelled: DataFrame) -> DataFrame:
    """One row, one array: log ratio by slot (sign and ORDER signs before it).

    `labelled` has slots (array) and good (boolean). Counting explodes the labelled URLs once and
    aggregates map-side; all that follows has at most SYMBOLS ** (ORDER + 1) rows.
    """
    counts = (
        labelled.select(F.explode("slots").alias("slot"), "good")
        .groupBy("slot")
        .agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    )
    slots = F.col("slot")
    grid = labelled.sparkSession.range(SYMBOLS ** (ORDER + 1)).select(F.col("id").cast("int").alias("slot"))
    table = grid.join(counts, "slot", "left").na.fill(0).coalesce(1)  # a bounded table: windows without exchanges
    probability = {"g": F.lit(1.0 / SYMBOLS), "b": F.lit(1.0 / SYMBOLS)}
    for k in range(ORDER + 1):  # a context of k signs
        event = (slots % SYMBOLS ** (k + 1)).cast("int")
        context = F.floor(slots / SYMBOLS).cast("int") % SYMBOLS**k
        table = table.withColumns({"event": event, "context": context})
        by_event, by_context = Window.partitionBy("context", "event"), Window.partitionBy("context")
        table = table.withColumns({f"{c}{k}": F.sum(c).over(by_event) for c in "gb"})
        # distinct signs after the context: each event counts once, by its first slot
        first = F.col("slot") < SYMBOLS ** (k + 1)
        table = table.withColumns({f"{c}t{k}": F.sum(F.when(first & (F.col(f"{c}{k}") > 0), 1).otherwise(0)).over(by_context) for c in "gb"})
        table = table.withColumns({f"{c}n{k}": F.sum(c).over(by_context) for c in "gb"})
        for c in "gb":
            seen, kinds, all_ = F.col(f"{c}{k}"), F.col(f"{c}t{k}"), F.col(f"{c}n{k}")
            probability[c] = F.when(all_ > 0, (seen + kinds * probability[c]) / (all_ + kinds)).otherwise(probability[c])
        table = table.withColumns({f"{c}p{k}": probability[c] for c in "gb"})
        probability = {c: F.col(f"{c}p{k}") for c in "gb"}
    ratio = F.round(F.log(probability["g"]) - F.log(probability["b"]), 9)
    return table.groupBy().agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", ratio.alias("ratio")))), lambda x: x["ratio"]).alias("ratios")
    )


def with_score(df: DataFrame, model: DataFrame) -> DataFrame:
    """Adds score, the mean log ratio over the signs (0 without signs)."""
    df = df.withColumn("ratios", model.scalar())

    def mean_of(own: Column) -> Column:
        total = F.aggregate(own, F.lit(0.0), lambda so_far, s: so_far + F.get("ratios", s))
        return F.when(F.size(own) > 0, total / F.size(own)).otherwise(0.0)

    mean = _let(F.col("slots"), mean_of)
    return df.withColumn("score", F.round(F.greatest(F.least(mean, F.lit(CLIP)), F.lit(-CLIP)), 6)).drop("ratios")


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the lowest score that counts as allowed, by balanced accuracy (0 where a class is missing).

    It lies midway between the bins that it parts. Ties go to the bin nearest 0, then the lower. At
    most 2 * CLIP / BIN bins reach the window.
    """
    bins = scored.groupBy(F.floor(F.col("score") / BIN).cast("int").alias("bin")).agg(
        F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")
    )
    up = Window.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rated = bins.select(
        "bin",
        F.lag("bin").over(Window.orderBy("bin")).alias("lower"),
        F.sum("g").over(up).alias("kept"),
        F.coalesce(F.sum("b").over(below), F.lit(0)).alias("stopped"),
        F.sum("g").over(Window.partitionBy()).alias("all_g"),
        F.sum("b").over(Window.partitionBy()).alias("all_b"),
    ).where("all_g > 0 and all_b > 0")
    best = F.max_by(
        (F.col("bin") + F.coalesce(F.col("lower") + 1, F.col("bin"))) * F.lit(BIN / 2),
        F.struct(F.round(F.col("kept") / F.col("all_g") + F.col("stopped") / F.col("all_b"), 9), -F.abs("bin"), -F.col("bin")),
    )
    return rated.groupBy().agg(F.coalesce(best, F.lit(0.0)).alias("least"))


def judge_urls(df: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Adds host, path, rule, verdict and score to every row of `df`.

    A null URL, or one without ://, has an empty host and path, no rule, and a score over no
    signs of 0. Without labelled URLs of both kinds all scores are compared with 0, and equal
    scores allow. Repeated URLs get equal answers. Columns of `df` by the added names are
    replaced. An empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    added = ("host", "path", "rule", "verdict", "score")
    kept = [F.col(f"row.`{c}`") for c in df.columns if c not in added]
    judged = df.select(whole(df), df[url].alias("url"), host_of(df[url]).alias("host"), path_of(df[url]).alias("path"))
    url = "url"
    judged = with_rule(judged, rules)
    labelled = (
        judged.where("rule is not null")
        .select((F.col("rule_verdict") == "allow").alias("good"), _slots(_signs(F.col(url))).alias("slots"), (F.conv(F.substring(F.md5(F.col(url).cast("binary")), 1, 6), 16, 10).cast("long") % HOLD_OUT == 0).alias("held"))
    )
    model = ratio_model(labelled.where("not held"))
    least = threshold(with_score(labelled.where("held"), model))
    scored = with_score(judged.withColumn("slots", _slots(_signs(F.col(url)))), model)
    method = F.when(F.col("score") >= least.scalar(), "allow").otherwise("block")
    return scored.select(*kept, "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "score")

