"""Fixtures and brute-force versions shared by the tests of this folder."""
import hashlib
import random
import re

from pyspark.sql import types as T

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Extra columns whose names clash with results and working columns of the operators.
EXTRA = ["row", "fp", "score", "predicted", "ids", "hits", "items", "spans", "base", "doc", "rk", "h", "n", "part", "key", "mask", "start", "tie", "copies"]


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def prose(rng: random.Random, words: int) -> str:
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve é ü ñ".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(words))


def documents(spark, rows):
    """(doc_id, text) rows as a table like ``documents``, with clashing extra columns."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(c, T.StringType()) for c in EXTRA])
    return spark.createDataFrame([(i, t, *[f"{c}!" for c in EXTRA]) for i, t in rows], schema)


def edge_rows():
    """Null ids and texts, empty and blank texts, ties, repeated rows, one very long text."""
    rng = random.Random(5)
    a, b = prose(rng, 120), prose(rng, 90)
    near = a.replace(a.split()[60], "changed", 1)
    return [(1, a), (2, b), (3, near), (4, a), (4, a), (5, None), (6, ""), (7, " \n\t"), (None, a), (None, None), (8, prose(rng, 60_000)),
            (9, "x"), (10, "two words"), (11, b + " " + prose(rng, 30)), (12, prose(rng, 200)), (13, "\U0001F600 é \x00\x1c tail  ")]


def words3(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


class Union:
    """Union-find by least label."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
