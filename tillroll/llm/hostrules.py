"""Quality rules with host verdicts, in DataFrame and SQL expressions only.

Every whole text is measured inside its row.  Windows of three words stand by 64-bit hashes, and a sort of
(hash, place) inside the row brings equal windows together, so the work grows as n log n with a text's words.

A host's failures of each rule are summed, and the rate is shrunk to what hosts are like: with a
Beta(a, b) prior over hosts, (k + a) / (n + a + b).  The prior is empirical: its mean is the rate over all documents, its
strength comes from the spread of the hosts' rates beyond binomial noise (method of moments).  A host with few documents so
stays near the mean.  A host is rejected if a shrunk rate is over ``LIMIT``; its documents then go with it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.joins import join_counted

from .common import RunFolder, col

LIMIT = 0.5
#: Correlation of two documents of a host: bounds, and what one host alone is given.
RHO_LEAST, RHO_MOST, RHO_ALONE = 0.001, 0.1, 0.01
# Blanks, and the characters that count as symbols.
BLANKS, SYMBOLS = r"\x20\x09-\x0D", "[#*$%&|<>]"

#: Rules by name; a document fails where the condition holds.  The first two are the base.
RULES = {
    "short": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words)",
}
BASE = ("short", "repeated")


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it in ``body`` as ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _measures(text: str = "text") -> Column:
    """Struct of a text's measures (all long)."""
    word, blank_free = _quoted(f"[^{BLANKS}]+"), _quoted(f"[^{BLANKS}]")
    windows = "if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"
    twice = "filter(s, (x, k) -> (k > 0 and s[k - 1].h = x.h) or (k < size(s) - 1 and s[k + 1].h = x.h))"
    covered = _let("p", f"sort_array(transform({twice}, x -> x.i))",
                   "aggregate(transform(p, (i, k) -> if(k < size(p) - 1, least(3, p[k + 1] - i), 3)), 0L, (a, x) -> a + x)")
    repeated = _let("h", windows, f"if(size(array_distinct(h)) = size(h), 0L, {_let('s', 'sort_array(transform(h, (x, i) -> struct(x as h, i as i)))', covered)})")
    of_words = _let("w", f"regexp_extract_all({text}, {word}, 0)",
                    f"struct(cast(size(w) as bigint) as n_words, cast(length(array_join(w, '')) as bigint) as word_chars, {repeated} as n_repeat_words)")
    of_lines = _let("l", f"filter(split({text}, '\\n', -1), x -> x rlike {blank_free})",
                    "struct(cast(size(l) as bigint) as n_lines, cast(size(l) - size(array_distinct(l)) as bigint) as n_dup_lines)")
    return F.expr(f"struct({of_words} as w, {of_lines} as l, cast(regexp_count({text}, '{SYMBOLS}') as bigint) as n_symbols)")


def measure(docs: DataFrame, text: str = "text", host: str = "source", keep=None) -> DataFrame:
    """row, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and fails (a boolean for each rule)."""
    names = docs.columns if keep is None else list(keep)
    got = docs.select(F.struct(*[col(c).alias(c) for c in names]).alias("row"), col(host).cast("string").alias("host"),
                      F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    got = got.select("row", "host", _measures().alias("m"))
    got = got.select("row", "host", "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.l.n_lines", "m.l.n_dup_lines", "m.w.n_repeat_words")
    return got.withColumn("fails", F.struct(*[F.expr(rule).alias(name) for name, rule in RULES.items()]))


def host_counts(measured: DataFrame) -> DataFrame:
    """host, n and the failures of each rule, for every host that has a name."""
    return measured.where("host is not null").groupBy("host").agg(
        F.count("*").alias("n"), *[F.sum(F.col(f"fails.{r}").cast("long")).alias(r) for r in RULES])


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Each rule's (a, b), by moments over all hosts; a row of sums reaches the driver."""
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
                      *[F.sum(r).alias(r) for r in RULES], *[F.sum(F.col(r).cast("double") * F.col(r) / F.col("n")).alias(f"{r}_kk") for r in RULES]).first()
    out = {}
    for r in RULES:
        n, k = total["n"] or 0, total[r] or 0
        mean = k / n if n else 0.0
        noise = mean * (1 - mean)
        room = noise * (n - total["nn"] / n - (total["hosts"] - 1)) if n else 0.0
        rho = RHO_ALONE if room <= 0 else (total[f"{r}_kk"] - k * k / n - noise * (total["hosts"] - 1)) / room
        strength = 1 / min(RHO_MOST, max(RHO_LEAST, rho)) - 1
        out[r] = (mean * strength, (1 - mean) * strength)
    return out


def host_verdicts(hosts: DataFrame, limit: float = LIMIT) -> DataFrame:
    """host, n, rates (a struct of the shrunk rate of each rule) and rejected."""
    shrunk = {r: (F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b)) for r, (a, b) in priors(hosts).items()}
    rates = F.struct(*[x.alias(r) for r, x in shrunk.items()])
    return hosts.select("host", "n", rates.alias("rates"), F.greatest(*shrunk.values()).alias("worst")).select("host", "n", "rates", (F.col("worst") > limit).alias("rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", limit: float = LIMIT, keep=None) -> DataFrame:
    """What ``measure`` returns, with base_failed, rejected (of the host) and kept, for every row.

    A null text counts as empty: no words, so the base fails.  Equal lines and windows are ties of their own text only; repeated
    rows each count for their host.  Rows without a host have no host verdict (rejected is false).  An empty table gives an empty one;
    the input's columns come back inside ``row``.
    """
    run = RunFolder(docs.sparkSession, "hostrules")
    rows = run.write(measure(docs, text, host, keep), "measured")
    verdicts = run.write(host_verdicts(run.write(host_counts(rows), "hosts"), limit), "verdicts")
    named = join_counted(rows.where("host is not null"), verdicts.select("host", "n", "rejected"), ["host"], "n").drop("n")
    out = named.unionByName(rows.where("host is null").withColumn("rejected", F.lit(False)))
    failed = F.expr(" or ".join(f"fails.{r}" for r in BASE))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("rejected"))
