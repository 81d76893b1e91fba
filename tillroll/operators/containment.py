"""Which texts hold which words: an inverted index of three-character grams.

A text that holds a word holds all of the word's grams, so a word is looked up by the gram that the fewest texts
hold, and each text found is compared with the whole word.  Words of one or two characters are grams themselves, and
the empty word is in every text.  A word with a gram that no text has is dropped before any look-up.

A gram of many texts and many words is dealt out as blocks of at most ``BLOCK`` texts by ``BLOCK`` words.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.joins import join_counted
from tillroll.session import materialize

GRAM = 3
BLOCK = 4096


def grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters of a text (none if it is shorter)."""
    places = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n)))))


def _word_grams(word: Column) -> Column:
    """A word's grams; shorter words are their own."""
    return F.when(F.length(word) <= GRAM, F.array(word)).otherwise(grams(word, GRAM))


def _text_grams(text: Column) -> Column:
    return F.flatten(F.array(F.array(F.lit("")), *[grams(text, n) for n in range(1, GRAM + 1)]))


def _spread(rows: DataFrame, blocks: DataFrame, n: str, key: str, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Rows with the block of their own side, once for each block of the other side."""
    rows = join_counted(rows, blocks, ["gram"], n)
    place = F.pmod(F.xxhash64(key), F.col(own[1])).alias(own[0])
    return rows.select("gram", key, place, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other[1]) - 1)).alias(other[0]))


def containing(texts: DataFrame, words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (text, word) of ``texts(text)`` and ``words(word)`` where the text holds the word literally.

    Both sides are taken as sets; null texts and words match nothing.  Case counts: fold both sides before.  An empty side gives no pair.
    """
    texts, words = (df.select(df.columns[0]).toDF(name).where(f"{name} is not null").distinct() for df, name in ((texts, "text"), (words, "word")))
    index = materialize(texts.select("text", F.explode(_text_grams(F.col("text"))).alias("gram")))
    wanted = words.select("word", _word_grams(F.col("word")).alias("g"))
    wanted = materialize(wanted.select("word", F.size("g").alias("n_grams"), F.explode("g").alias("gram")))
    held = index.groupBy("gram").agg(F.count("*").alias("n_texts"))
    known = materialize(held.join(wanted.groupBy("gram").agg(F.count("*").alias("n_words")), "gram"))
    rarest = join_counted(wanted, known, ["gram"], "n_words").groupBy("word", "n_grams").agg(
        F.count("*").alias("n"), F.min(F.struct("n_texts", "gram")).alias("r")).where("n = n_grams")
    rarest = materialize(rarest.select("word", F.col("r.gram").alias("gram"), F.col("r.n_texts").alias("n_texts")))

    parts = lambda n: F.ceil(F.col(n) / block)
    blocks = rarest.groupBy("gram", "n_texts").agg(F.count("*").alias("n_words"))
    blocks = materialize(blocks.select("gram", "n_texts", "n_words", parts("n_texts").alias("s_n"), parts("n_words").alias("t_n")))
    by_word = _spread(rarest.select("gram", "word"), blocks, "n_words", "word", ("t", "t_n"), ("s", "s_n"))
    by_text = _spread(index.join(blocks.select("gram"), "gram", "left_semi"), blocks, "n_texts", "text", ("s", "s_n"), ("t", "t_n"))
    return by_text.join(by_word, ["gram", "s", "t"]).where(F.col("text").contains(F.col("word"))).select("text", "word")
