import re
from collections import Counter

from pyspark.sql import functions as F

from quernstone.llm import rules

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = W.findall(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a b c", "one line\none line\n\n\nother", "x " * 50, "é# <b> | " * 9, " ".join(map(str, range(60))) * 2, "a b c d e f g h i " * 3 + "tail", "\x0b a\x0cb\rc\n", "w" * 5000 + " " + "q " * 2000]


def test_metrics_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, n_words string, _words int")
    for r in rules.with_metrics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.text
        assert r._words == 1
    assert rules.with_metrics(df.limit(0)).count() == 0


def test_on_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = rules.apply_rules(df).join(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), "doc_id", "left").collect()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert all(r.kept for r in out if r.quality == 1 and not r.base_failed)
    assert sum(r.kept for r in out if r.quality == 0) <= 1


def test_order_does_not_change_the_verdict(spark):
    df = rules.with_metrics(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    given = rules.default_rules()
    one = rules.cascade(df, given).select("doc_id", F.isnull("rejected_by")).collect()
    two = rules.cascade(df, given[::-1]).select("doc_id", F.isnull("rejected_by")).collect()
    assert one == two
    best = rules.order(given, {r.name: (1.0, 0.9 if r.name == "digits" else 0.1) for r in given})
    assert best[0].name == "digits"


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plan = rules.apply_rules(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_columns_and_no_rows(spark):
    rows = [(i, t, "a", "b", "c", 1) for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, base_failed string, rejected_by string, _words int")
    out = rules.apply_rules(df)
    got = out.collect()
    assert len(got) == len(rows) and out.columns.count("kept") == 1
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and isinstance(r.kept, bool) for r in got)
    assert rules.apply_rules(df.limit(0)).count() == 0


def test_costs_leave_out_the_start_of_a_job(spark):
    df = rules.with_metrics(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    slow = F.col("doc_id") >= 0
    for k in range(300):
        slow = slow & (F.length(F.sha2(F.concat(F.col("text"), F.lit(str(k))), 512)) >= 0)
    costs = rules.measure(df.cache(), [rules.Rule("cheap", F.col("n_words") < 0), rules.Rule("dear", slow)])
    assert costs["cheap"][1] == 0 and costs["dear"][0] > costs["cheap"][0]
