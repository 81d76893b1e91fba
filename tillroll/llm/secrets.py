"""Secret scan in DataFrame expressions only.

Base spans come from three fixed patterns.  Spark has no function for the positions of
all matches, but the pieces between matches (``split``) and the matches
(``regexp_extract_all``) alternate, so their lengths add up to the positions.

The method adds strings that look drawn at random.  Candidates are runs of at least ``MIN_RUN`` characters of the usual encodings,
and where base spans cover a part of a run, the pieces of that length beside them; the smallest alphabet that holds a run is its encoding.  The battery:

* chi-squared: X2 = a/n * sum(c^2) - n against its mean a-1 for a uniform alphabet of a symbols;
* runs: changes between the lower and upper half of the alphabet against (n-1)/2;
* serial correlation at lag 1 of the symbols' indices, against 0 with deviation 1/sqrt(n-1).

A run that fails one test of the three (more than ``GATE`` deviations) is no secret.  For the others
the evidence against "ordinary text" is the chi-squared statistic measured against a letter
distribution of text, joined (Stouffer) with the number of changes of character class; both grow with the length.  Runs of digits
are measured against numbers that are counted, dated or padded instead: their digits' frequencies and how often neighbours differ by more than one.
The p-values are held to a false-discovery rate (Benjamini-Hochberg) in each stratum of encoding and
length band, through a histogram: what is collected are at most strata x 1 thresholds.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed

MIN_RUN = 20
#: Characters of a block that redaction cuts from.
BLOCK = 1024
GATE = 3.0
RATE = 0.01
#: p-values are told apart down to 10^-(BINS / 10).
BINS = 200
#: Sums of the squares and cubes of letter frequencies in text, and how often the class of characters changes in it.
TEXT_P2, TEXT_P3, TEXT_CHANGE = 0.067, 0.0062, 0.08
#: The same for numbers that are counted, dated or padded (a third zeros); a change is a step of more than one between neighbours.
DIGIT_P2, DIGIT_P3, DIGIT_CHANGE = 0.18, 0.049, 0.35
#: Digits that begin with a date and a time of day are no candidates (6 random keys in 100,000 begin so).
DATED = "^(19|20)[0-9][0-9](0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9][0-9]*$"

# The base patterns, in the order in which kinds are listed.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
}
ASSIGN_CHARS = 6
RUN = r"[A-Za-z0-9+/_-]{%d,}+" % MIN_RUN
_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet on: name, symbols, pattern of a whole run.
ENCODINGS = [
    ("decimal", _DIGIT, "^[0-9]+$"),
    ("hex", _DIGIT + "abcdef", "^[0-9a-f]+$"),
    ("hexup", _DIGIT + "ABCDEF", "^[0-9A-F]+$"),
    ("lower", _LOWER, "^[a-z]+$"),
    ("upper", _UPPER, "^[A-Z]+$"),
    ("base32", _UPPER + "234567", "^[A-Z2-7]+$"),
    ("lower36", _DIGIT + _LOWER, "^[0-9a-z]+$"),
    ("upper36", _DIGIT + _UPPER, "^[0-9A-Z]+$"),
    ("base62", _DIGIT + _UPPER + _LOWER, "^[0-9A-Za-z]+$"),
    ("base64", _UPPER + _LOWER + _DIGIT + "+/_-", "^.*$"),
]
BANDS = [20, 24, 32, 48, 80]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value``, computed once, under ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(array: str, value: str, join: str = "{} + {}") -> str:
    """SQL for the running ``join`` of ``value`` (of entry e) over the entries before each one, 0 before the first.

    Blocks of about the root of the number of entries are run through one by one, so that no array grows by copies of its whole self."""
    step = lambda items, v: f"""aggregate({items}, named_struct('at', 0, 'out', cast(array() as array<int>)),
        (a, e) -> named_struct('at', {join.format('a.at', v)}, 'out', concat(a.out, array(a.at))))"""  # noqa: E731
    blocks = f"transform(sequence(0, greatest(size(z) - 1, 0), w), i -> {step('slice(z, i + 1, w)', value)})"
    ran = _let("k", blocks, f"flatten(zip_with(k, {step('k', 'e.at')}.out, (own, o) -> transform(own.out, v -> {join.format('v', 'o')})))")
    return _let("z", array, _let("w", "cast(greatest(1, ceil(sqrt(size(z)))) as int)", ran))


def _spans(pattern: str, passes: str = "true", part: str = "''", text: str = "text") -> str:
    """SQL for array<struct<start, stop, part>> of the matches of ``pattern`` in ``text``.

    ``part`` is SQL for an array with an entry for each match, kept beside it.
    """
    p = _quoted(pattern)
    pieces = f"""transform(arrays_zip(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), {part}),
        x -> named_struct('n', length(x.`0`), 'gap', length(x.`1`), 'part', x.`2`))"""
    placed = f"zip_with(m, {_before('m', 'e.gap + coalesce(e.n, 0)')}, (x, at) -> named_struct('n', x.n, 'start', at + x.gap, 'part', x.part))"
    steps = _let("m", pieces, f"""transform(filter({placed}, x -> x.n is not null and {passes}),
        x -> named_struct('start', x.start, 'stop', x.start + x.n, 'part', x.part))""")
    return f"if({text} rlike {p}, {steps}, cast(array() as array<struct<start:int,stop:int,part:string>>))"


def _base() -> Column:
    """Base spans as array<struct<start, rank, stop, kind>>, ordered."""
    parts = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        group = 1 if kind == "assign" else 0
        passes = f"length(x.part) >= {ASSIGN_CHARS}" if kind == "assign" else "true"
        spans = _spans(pattern, passes, f"regexp_extract_all(text, {_quoted(pattern)}, {group})")
        parts.append(f"transform({spans}, x -> named_struct('start', x.start, 'rank', {rank}, 'stop', x.stop, 'kind', '{kind}'))")
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def _shadow(chars: str) -> str:
    """Characters of the private use area that stand for those of base spans."""
    return "".join(chr(0xE000 + ord(c)) for c in chars)


def _masked() -> Column:
    """The text with the run characters of base spans as shadows, code point by code point.

    Later kinds match shadows like the characters that they stand for, so spans of several kinds may overlap."""
    both = lambda chars: f"[{chars}{''.join(c if c == '-' else _shadow(c) for c in chars)}]"
    patterns = {"assign": BASE["assign"], "access": "".join(map(both, "AKIA")) + both("A-Z0-9") + "{16,}+", "hex": both("0-9a-f") + "{24,}+"}
    own = _DIGIT + _LOWER + _UPPER + "+/_-"
    out = f"translate(text, '{_shadow(own)}', '{chr(0xE000) * len(own)}')"
    for kind, pattern in patterns.items():
        p = _quoted(pattern)
        passes = f"length(x.`2`) >= {ASSIGN_CHARS}" if kind == "assign" else "true"
        shadowed = f"if({passes}, translate(x.`0`, '{own}', '{_shadow(own)}'), x.`0`)"
        out = _let("t", out, f"""array_join(transform(arrays_zip(regexp_extract_all(t, {p}, 0), split(t, {p}, -1), regexp_extract_all(t, {p}, {1 if kind == "assign" else 0})),
            x -> concat(x.`1`, coalesce({shadowed}, ''))), '')""")
    return F.expr(f"if(size(base) > 0, {out}, text)")


def _runs() -> Column:
    """Candidates (runs in ``masked``, the text without what base spans cover) with encoding, alphabet and characters' statistics: one lambda a step, so that nothing is computed twice."""
    name = "case " + " ".join(f"when x.part rlike '{p}' then '{n}'" for n, _, p in ENCODINGS[:-1]) + f" else '{ENCODINGS[-1][0]}' end"
    pieces = f"filter({_spans(RUN, part=f'regexp_extract_all(masked, {_quoted(RUN)}, 0)', text='masked')}, x -> x.part not rlike {_quoted(DATED)})"
    enc = f"transform({pieces}, x -> named_struct('start', x.start, 'stop', x.stop, 'run', x.part, 'enc', {name}))"
    alphabet = "case x.enc " + " ".join(f"when '{n}' then '{a}'" for n, a, _ in ENCODINGS) + " end"
    symbols = f"""transform({enc}, x -> named_struct('start', x.start, 'stop', x.stop, 'enc', x.enc, 'run', x.run, 'abc', {alphabet}, 'n', cast(length(x.run) as double)))"""
    counted = f"""transform({symbols}, x -> named_struct('start', x.start, 'stop', x.stop, 'enc', x.enc, 'n', x.n, 'a', cast(length(x.abc) as double),
        'squares', aggregate(split(x.abc, ''), 0D, (s, c) -> s + power(length(x.run) - length(replace(x.run, c, '')), 2)),
        'index', transform(split(x.run, ''), c -> cast(locate(c, x.abc) - 1 as double)),
        'digits', x.enc = 'decimal', 'plain', x.enc in ('lower', 'upper'),
        'class', transform(split(translate(x.run, '{_DIGIT}{_LOWER}{_UPPER}', '{"d" * 10}{"l" * 26}{"u" * 26}'), ''), c -> c)))"""
    tested = f"""transform({counted}, x -> named_struct('start', x.start, 'stop', x.stop, 'enc', x.enc, 'n', x.n, 'a', x.a, 'plain', x.plain,
        'p2', if(x.digits, {DIGIT_P2}D, {TEXT_P2}D), 'p3', if(x.digits, {DIGIT_P3}D, {TEXT_P3}D), 'rate', if(x.digits, {DIGIT_CHANGE}D, {TEXT_CHANGE}D),
        'x2', x.a / x.n * x.squares - x.n,
        'runs', aggregate(zip_with(slice(x.index, 2, size(x.index)), slice(x.index, 1, size(x.index) - 1), (p, q) -> if((p >= x.a / 2) <> (q >= x.a / 2), 1D, 0D)), 0D, (s, v) -> s + v),
        'serial', aggregate(zip_with(slice(x.index, 2, size(x.index)), slice(x.index, 1, size(x.index) - 1), (p, q) -> (p - (x.a - 1) / 2) * (q - (x.a - 1) / 2)), 0D, (s, v) -> s + v)
                  / ((x.n - 1) * (x.a * x.a - 1) / 12),
        'changes', if(x.digits,
            aggregate(zip_with(slice(x.index, 2, size(x.index)), slice(x.index, 1, size(x.index) - 1), (p, q) -> if(abs(p - q) > 1, 1D, 0D)), 0D, (s, v) -> s + v),
            aggregate(zip_with(slice(x.class, 2, size(x.class)), slice(x.class, 1, size(x.class) - 1), (p, q) -> if(p <> q, 1D, 0D)), 0D, (s, v) -> s + v))))"""
    z = f"""transform({tested}, x -> named_struct('start', x.start, 'stop', x.stop, 'enc', x.enc, 'n', x.n,
        'odd', greatest((x.x2 - (x.a - 1)) / sqrt(2 * (x.a - 1) * (x.n - 1) / x.n), abs(x.runs - (x.n - 1) / 2) / sqrt((x.n - 1) / 4), abs(x.serial) * sqrt(x.n - 1)),
        'z', ((x.a - 1 + (x.n - 1) * (x.a * x.p2 - 1) - x.x2) / sqrt(4 * x.n * x.a * x.a * (x.p3 - x.p2 * x.p2) + 2 * x.a * x.a * x.p2 * x.p2)
            + if(x.plain, 0D, (x.changes - x.rate * (x.n - 1)) / sqrt(x.rate * (1 - x.rate) * (x.n - 1)))) / sqrt(if(x.plain, 1D, 2D))))"""
    band = "case " + " ".join(f"when x.n >= {b} then '{b}'" for b in reversed(BANDS)) + " end"
    # Upper tail of the normal distribution by its logistic approximation; in tenths of powers of ten.
    p = "greatest(-1e3, least(1e3, 1.5976 * x.z + 0.07056 * x.z * x.z * x.z))"
    return F.expr(f"""transform({z}, x -> named_struct('start', x.start, 'stop', x.stop, 'stratum', concat(x.enc, {band}),
        'bin', if(x.odd > {GATE}, 0, cast(least({BINS}, floor(10 * (if({p} > 30, {p}, ln(1 + exp({p}))) / ln(10)))) as int))))""")


def thresholds(docs: DataFrame, text: str = "text", rate: float = RATE) -> dict[str, int]:
    """Least bin of each stratum that holds the false-discovery rate, over all documents."""
    runs = packed(docs, text, []).withColumn("base", _base()).withColumn("masked", _masked()).select(F.explode(_runs()).alias("r"))
    bins = runs.groupBy(F.col("r.stratum").alias("stratum"), F.col("r.bin").alias("bin")).agg(F.count("*").alias("n"))
    above = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    table = bins.select("stratum", "bin", F.sum("n").over(above).alias("k"), F.sum("n").over(Window.partitionBy("stratum")).alias("m"))
    held = table.where((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / 10) <= rate * F.col("k") / F.col("m")))
    return {r.stratum: r.bin for r in held.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, text: str = "text", rate: float = RATE, keep=None) -> DataFrame:
    """``row``, text, base and spans (arrays of start, rank, stop, kind; code points, end exclusive, ordered).

    ``spans`` holds the base spans and, as kind "random", the candidates found by the battery; they
    overlap no base span.  A null text counts as empty and has no spans; repeated rows are scanned each;
    without documents there are no thresholds and nothing is found.
    """
    limits = thresholds(docs, text, rate)
    hit = " or ".join(f"(x.stratum = '{s}' and x.bin >= {b})" for s, b in sorted(limits.items())) or "false"
    out = packed(docs, text, keep).select("row", F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("base", _base()).withColumn("masked", _masked()).withColumn("runs", _runs())
    found = F.expr(f"""transform(filter(runs, x -> {hit}),
        x -> named_struct('start', x.start, 'rank', {len(BASE)}, 'stop', x.stop, 'kind', 'random'))""")
    return out.select("row", "text", "base", F.array_sort(F.concat("base", found)).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')")


def redacted(mark: str = "<SECRET>") -> Column:
    """The text with every span (overlapping ones as one) replaced by ``mark``.

    What is kept is cut out of blocks of ``BLOCK`` characters: a look-up by position runs through a string from its start."""
    blocks = f"regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0)"
    kept = f"""transform(filter(zip_with(spans, {_before('spans', 'e.stop', 'greatest({}, {})')}, (x, at) -> named_struct('at', at, 'start', x.start)), x -> x.start >= x.at),
        x -> if(x.start = x.at, '', substring(array_join(slice(b, x.at div {BLOCK} + 1, (x.start - 1) div {BLOCK} - x.at div {BLOCK} + 1), ''), cast(x.at % {BLOCK} + 1 as int), x.start - x.at)))"""
    tail = "substring(text, array_max(transform(spans, x -> x.stop)) + 1)"
    return F.expr(f"if(size(spans) = 0, text, concat(array_join(transform({_let('b', blocks, kept)}, x -> concat(x, '{mark}')), ''), {tail}))")
