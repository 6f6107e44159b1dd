"""URL filter: domain rules, and for URLs without a rule a ratio of character language models.

Two variable-order Markov models are counted over all URLs that a rule accepts or rejects.  A character is
predicted from the longest known context of up to ``ORDER`` characters, each order being smoothed with
the next shorter one (Witten-Bell).  A URL's score is the difference of the two log-likelihoods divided by
its length; it is blocked below a threshold that is calibrated on the rule-judged URLs kept out of the
counts (every ``FOLDS``-th by hash): the point between the two classes' means, weighted by spread.

Counts, contexts and the scores of distinct n-grams are tables that are joined; nothing is collected but
the one row of calibration figures.

Rows: a null URL, or one without ``://``, has empty host and path, no rule, and is modelled by its whole
text.  A URL without characters is allowed.  When a class has no counted URL there is no evidence, and
every URL without a rule is allowed; when a class has none to calibrate on, the threshold is 0.
Repeated ids are judged one by one.  Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hearthmap.llm.scratch import Scratch

ORDER = 4
FOLDS = 5
# Probability of a character before any count: one of this many.
ALPHABET = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Stands before the first character of a URL.
_EDGE = "\u0002"


@dataclass(frozen=True)
class Rule:
    """A host and a path prefix; it fits the host's subdomains as well."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict; the longest fitting rule wins.  Rules are a short list."""
    rows = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        fits &= F.col("path").startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return rows.withColumns({"rule": text, "rule_verdict": verdict})


def _grams(url: Column) -> Column:
    """Every character with up to ORDER characters before it; digits are alike."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""), "[0-9]", "0")
    chars = F.split(F.concat(F.lit(_EDGE), body), "")
    places = F.sequence(F.lit(2), F.size(chars))
    gram = lambda i: F.array_join(
        F.slice(chars, F.greatest(i - ORDER, F.lit(1)), F.least(i, F.lit(ORDER + 1))), ""
    )
    return F.when(F.length(body) > 0, F.transform(places, gram)).otherwise(F.array().cast("array<string>"))


def _orders(grams: DataFrame, *keep: str) -> DataFrame:
    """One row per n-gram and context length."""
    lengths = F.sequence(F.lit(0), F.length("gram") - 1)
    rows = grams.select("gram", *keep, F.explode(lengths).alias("order"))
    # substring from the end: the context and the character
    tail = F.expr("right(gram, order + 1)")
    return rows.withColumns({"context": F.expr("left(right(gram, order + 1), order)"), "tail": tail})


def _log_ratio(steps: Column) -> Column:
    """Log of accepted over rejected probability from (order, counts, contexts), shortest first."""
    start = F.struct(F.lit(1 / ALPHABET).alias("accepted"), F.lit(1 / ALPHABET).alias("rejected"))

    def smooth(below: Column, step: Column, kind: str) -> Column:
        n, kinds, total = step[f"n_{kind}"], step[f"kinds_{kind}"], step[f"total_{kind}"]
        return F.when(total > 0, (n + kinds * below) / (total + kinds)).otherwise(below)

    def fold(state: Column, step: Column) -> Column:
        return F.struct(
            smooth(state["accepted"], step, "accepted").alias("accepted"),
            smooth(state["rejected"], step, "rejected").alias("rejected"),
        )

    return F.aggregate(steps, start, fold, lambda s: F.log(s["accepted"]) - F.log(s["rejected"]))


def gram_scores(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, ratio) for every distinct n-gram of ``grams`` (page, gram, counted, verdict)."""
    one = lambda verdict: F.sum(F.when(F.col("counted") & (F.col("verdict") == verdict), 1).otherwise(0))
    distinct = scratch.write(
        grams.groupBy("gram").agg(one("allow").alias("n_accepted"), one("block").alias("n_rejected"))
    )
    tails = scratch.write(
        _orders(distinct.where("n_accepted + n_rejected > 0"), "n_accepted", "n_rejected")
        .groupBy("order", "context", "tail")
        .agg(F.sum("n_accepted").alias("n_accepted"), F.sum("n_rejected").alias("n_rejected"))
    )
    contexts = scratch.write(
        tails.groupBy("order", "context").agg(
            *[
                f(F.col(f"n_{kind}")).alias(f"{name}_{kind}")
                for kind in ("accepted", "rejected")
                for name, f in (("total", F.sum), ("kinds", lambda c: F.sum((c > 0).cast("long"))))
            ]
        )
    )
    rows = _orders(distinct.select("gram"))
    rows = rows.join(contexts, ["order", "context"], "left").join(
        tails.drop("order", "context"), "tail", "left"
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    figures = [zero(f"{name}_{kind}") for name in ("n", "total", "kinds") for kind in ("accepted", "rejected")]
    steps = rows.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("order", *figures))).alias("steps"))
    return scratch.write(steps.select("gram", _log_ratio(F.col("steps")).alias("ratio")))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score, threshold."""
    scratch = Scratch(pages.sparkSession)
    rows = ruled(pages.select(F.col("page_id").cast("long"), "url"), rules)
    # rows are told apart by a number of their own, as ids may repeat or be null
    rows = scratch.write(rows.withColumn("page", F.monotonically_increasing_id()))
    held_out = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    grams = scratch.write(
        rows.select(
            "page",
            F.col("rule_verdict").alias("verdict"),
            (~F.coalesce(held_out, F.lit(True))).alias("counted"),
            F.explode(_grams(F.col("url"))).alias("gram"),
        )
    )
    scores = gram_scores(grams, scratch)
    scored = scratch.write(
        grams.join(scores, "gram")
        .groupBy("page", "verdict", "counted")
        .agg(F.round(F.sum("ratio") / F.count("*"), 9).alias("score"))
    )
    limit = threshold(scored)
    judged = rows.join(scored.select("page", "score"), "page", "left")
    by_model = F.lit("allow") if limit is None else F.when(F.col("score") < limit, "block").otherwise("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", by_model).alias("verdict"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.lit(limit).cast("double").alias("threshold"),
    )


def threshold(scored: DataFrame) -> float | None:
    """Calibrated threshold; None when a class has no counted URL."""
    figures = []
    for verdict in ("allow", "block"):
        kept = F.when((F.col("verdict") == verdict) & ~F.col("counted"), F.col("score"))
        counted = F.count(F.when((F.col("verdict") == verdict) & F.col("counted"), 1))
        figures += [counted, F.avg(kept), F.coalesce(F.stddev_pop(kept), F.lit(0.0))]
    n_allow, allow, allow_spread, n_block, block, block_spread = scored.agg(
        *[f.alias(f"f{i}") for i, f in enumerate(figures)]
    ).first()
    if not n_allow or not n_block:
        return None
    if allow is None or block is None:
        return 0.0
    spread = allow_spread + block_spread
    return round((allow + block) / 2 if not spread else (allow * block_spread + block * allow_spread) / spread, 9)
