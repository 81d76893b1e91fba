import random
import re

from helpers import FOLD, documents, edge_rows, prose, sha
from tillroll.llm import decontam

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(docs, bench, window=10):
    words = lambda t: re.findall(WORD, (t or "").translate(FOLD))
    pats = {}
    for item, t in bench:
        w = words(t)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            pats.setdefault(tuple(w[i:i + m]), set()).add("null" if item is None else str(item))
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for m in {len(p) for p in pats}:
            for i in range(len(w) - m + 1):
                found = pats.get(tuple(w[i:i + m]))
                if found:
                    hit |= set(range(i, i + m))
                    items |= found
        out.append((str(d), len(w), len(hit), sorted(items)))
    return sorted(out)


def cases():
    rng = random.Random(2)
    bench = [(1, prose(rng, 40)), (2, prose(rng, 12)), (10, "Two WORDS"), (3, "x"), (4, None), (5, "..."), (None, prose(rng, 15)), (2, prose(rng, 11)), (6, "a a a a a a a a a a a")]
    docs = edge_rows() + [(20, "lead in. " + bench[0][1] + " out"), (21, bench[0][1][20:150]), (22, bench[1][1].upper().replace(" ", "\n--")), (23, bench[6][1] * 2),
                          (24, "a " * 40), (25, bench[1][1] + " " + bench[0][1]), (26, "two, words two words x")]
    return docs, bench


def check(spark, **how):
    docs, bench = cases()
    out = decontam.decontaminate(documents(spark, docs), spark.createDataFrame(bench, "item_id long, text string"), **how)
    got = sorted((str(r.row.doc_id), r.n_words, r.n_hit, r["items"]) for r in out.collect())
    assert got == brute(docs, bench)


def test_matches_brute_force(spark):
    check(spark)


def test_shards_of_patterns_give_the_same(spark):
    check(spark, shard_bytes=100)


def test_empty_tables_digest_and_columns(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, edge_rows())
    out = decontam.decontaminate(docs, none)
    assert out.where("n_hit > 0").count() == 0 and out.select("row.*").columns == docs.columns
    assert decontam.decontaminate(documents(spark, []), none).count() == 0
    one = decontam.decontaminate(docs.limit(1), none).select(decontam.items_digest("items").alias("d")).first()
    assert one.d == sha("")
