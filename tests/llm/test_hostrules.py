"""Host rules against a brute-force version, and the host verdicts on planted hosts."""
import random
import re
from collections import Counter

from helpers import documents, edge_rows, prose
from tillroll.llm import hostrules
from pyspark.sql import functions as F


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


CASES = ["a a a a", "a b c a b c a b", "x y z\nx y z\n \t\n\n \t\nx y z\r\nx y z\r", "#*$%&|<> a&b", "  \x85 \x1c \x0b\x0c", "a b\x00c a b\x00c a b\x00c", "né né né né 😀 😀", "one\n one\none ",
         "p q r " * 40, "\n".join(["same line here"] * 30)]


def judged(spark, rows, hosts=None, **more):
    docs = documents(spark, rows)
    docs = docs.withColumn("source", hosts(F.col("doc_id")) if hosts else F.lit("s"))
    return hostrules.judge(docs, **more)


def test_measures_match_brute_force(spark):
    rows = edge_rows() + [(100 + k, t) for k, t in enumerate(CASES)]
    got = judged(spark, rows).select("row.*", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 50 or 100 * want[5] > 50 * want[0])


def test_host_verdicts_shrink_small_hosts_and_follow_large_ones(spark):
    rng = random.Random(3)
    good, bad = prose(rng, 80), prose(rng, 60) + " " + "# " * 12
    rows = [(k, good) for k in range(600)] + [(1000 + k, bad if k % 10 else good) for k in range(100)] + [(2000, bad), (3000, bad), (3001, None)]
    host = lambda c: F.when(c >= 3000, F.lit(None)).when(c >= 2000, F.lit("lone")).when(c >= 1000, F.lit("junk")).otherwise(F.concat(F.lit("h"), c % 7))
    got = {r.doc_id: r for r in judged(spark, rows, host, keep=["doc_id"]).select("row.doc_id", "host", "rejected", "base_failed", "kept").collect()}
    assert len(got) == len(rows)
    assert all(got[k].rejected and not got[k].kept for k in range(1000, 1100))     # nine of ten fail: the host goes, with its good documents
    assert not got[2000].rejected and got[2000].kept                               # one document says little about a host
    assert all(got[k].kept for k in range(600))
    assert got[3000].kept and not got[3000].rejected and not got[3001].kept and got[3001].base_failed


def test_prior_follows_the_spread_of_hosts(spark):
    even = spark.createDataFrame([(f"h{k}", 100, *[20] * 5) for k in range(20)], "host string, n long, " + ", ".join(f"{r} long" for r in hostrules.RULES))
    a, b = hostrules.priors(even)["short"]
    assert abs(a / (a + b) - 0.2) < 1e-9 and a + b > 900          # hosts alike: the prior is strong
    apart = spark.createDataFrame([(f"h{k}", 100, *[90 if k % 4 == 0 else 2] * 5) for k in range(20)], even.schema)
    a, b = hostrules.priors(apart)["short"]
    assert a + b < 10                                             # hosts differ: each follows its own documents
    assert hostrules.priors(even.where("false"))["short"] == (0.0, 99.0)


def test_empty_table_hot_host_and_plan(spark):
    assert judged(spark, []).count() == 0
    rng = random.Random(4)
    rows = [(k, prose(rng, 55)) for k in range(3000)]
    out = judged(spark, rows, lambda c: F.when(c % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("h"), c)), keep=["doc_id"])
    assert out.where("host = 'hot'").count() == 1000 and out.count() == 3000
    plans = [hostrules.measure(documents(spark, rows[:5]).withColumn("source", F.lit("s"))), out]
    assert not any(x in p._jdf.queryExecution().executedPlan().toString() for p in plans for x in ("Python", "Arrow", "Pandas"))
