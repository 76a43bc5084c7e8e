"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Boolean column that is true for a text to reject. Cost and
rejection rate of every rule are estimated on a sample; the cascade asks the
rule with the most rejections per cost first and stops at the first that
rejects. The order changes the time and the named rule, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.shared import Work, fresh

_WS = r"[\x20\x09-\x0D]+"
_NOT_WS = r"[^\x20\x09-\x0D]"
WINDOW = 8
#: About so many rows, from all of the table, on which cost and selectivity are estimated; they only set the order.
SAMPLE_ROWS = 2000
SAMPLE_SEED = 7
#: Runs of which the median counts, and what a rule costs at least.
REPEATS, LEAST_SECONDS = 3, 1e-4


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def _repeated(windows: Column, width: int) -> Column:
    """Words in windows (given by hash, in order) that occur twice or more."""

    def covered(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == e["h"])))
        places = F.sort_array(F.transform(twice, lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("total"), F.lit(-width).alias("last"))
        step = lambda a, i: F.struct((a["total"] + F.least(F.lit(width), i - a["last"])).alias("total"), i.alias("last"))
        return F.aggregate(places, zero, step, lambda a: a["total"])

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Bound as a lambda variable so that the sorted array is made once.
    count = F.get(F.transform(F.array(ordered), covered), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), count).otherwise(0).cast("long")


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words word_chars n_symbols n_dup_lines n_lines n_repeat_words`` (long).

    Null text has no words, so all are 0. Columns of ``df`` with these names are
    replaced. Narrow, without Python; memory is bounded by one text.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
    t = F.coalesce(F.col(text), F.lit(""))
    words, lines, hashes, windows = fresh([*df.columns, *made], "_words", "_lines", "_hashes", "_windows")
    symbols = F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols")
    one = df.select(*kept, F.array_remove(F.split(t, _WS), "").alias(words), F.filter(F.split(t, "\n"), lambda x: x.rlike(_NOT_WS)).alias(lines), symbols)
    two = one.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    span = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    three = two.withColumn(windows, F.transform(span, lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(WINDOW)])))
    return three.select(
        *kept,
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        _repeated(F.col(windows), WINDOW).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Rules on the metrics and on the text; thresholds leave plain prose alone."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        Rule("base", base_failed()),
        Rule("symbols", F.col("n_symbols") * 5 > n),
        Rule("dup_lines", F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("shouting", F.regexp_count(t, F.lit(r"\p{Lu}{2,}[^\x20\x09-\x0D]*")) * 2 > n),
        Rule("exclaiming", F.regexp_count(t, F.lit(r"[!?]{2,}")) * 4 > n),
        Rule("digits", F.regexp_count(t, F.lit(r"[0-9]")) * 3 > F.col("word_chars") + 1),
    ]


def measure(sample: DataFrame, rules: list[Rule]) -> dict[str, tuple[float, float]]:
    """Seconds and share of rejected rows of each rule on ``sample``, a re-readable table.

    A rule's time is the median of :data:`REPEATS` runs less that of a job that
    only counts rows, so that starting a job is not taken for the rule's cost; it
    is at least :data:`LEAST_SECONDS`. Nothing is rejected of an empty sample.
    """
    counts = [F.count(F.lit(1)), F.count_if(F.lit(False))]

    def run(*what: Column) -> tuple[float, int, int]:
        times = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            n, hit = sample.agg(*what).first()
            times.append(time.perf_counter() - began)
        return sorted(times)[REPEATS // 2], n, hit

    run(*counts)  # the first job also pays for warming up
    launch = run(*counts)[0]
    out = {}
    for r in rules:
        seconds, n, hit = run(counts[0], F.count_if(r.rejects))
        out[r.name] = (max(LEAST_SECONDS, seconds - launch), hit / max(n, 1))
    return out


def order(rules: list[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejections per second, the most first; unmeasured rules and ties stay as given."""
    return sorted(rules, key=lambda r: -measured[r.name][1] / max(measured[r.name][0], 1e-6) if r.name in measured else 0.0)


def cascade(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rejected_by``, the first rule that rejects (null: none); later ones aren't evaluated."""
    if not rules:
        return df.withColumn("rejected_by", F.lit(None).cast("string"))
    verdict = F.when(rules[0].rejects, rules[0].name)
    for r in rules[1:]:
        verdict = verdict.when(r.rejects, r.name)
    return df.withColumn("rejected_by", verdict)


def apply_rules(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Metrics, ``rejected_by``, ``base_failed`` and ``kept`` for every row of ``df``.

    Columns of ``df`` with the names of these or of the metrics are replaced. Null,
    empty and blank texts have no words and fail the base rule; repeated rows are
    judged one by one; an empty table gives none.
    """
    df = df.drop(*(c for c in ("rejected_by", "base_failed", "kept") if c != text))
    rules = default_rules(text) if rules is None else rules
    work = Work(df.sparkSession, "rules")
    share = min(1.0, sample_rows / max(1, df.count()))
    sample = work.save(with_metrics(df.sample(share, SAMPLE_SEED), text).repartition(1), "sample")
    ordered = order(rules, measure(sample, rules))
    work.drop("sample")
    out = cascade(with_metrics(df, text), ordered).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
