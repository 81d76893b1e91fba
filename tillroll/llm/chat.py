"""Chat formatting in budgeted windows.

Every turn is written as ``<s>[INST]role[/INST]text</s>``; control strings inside roles and
texts are broken with a backslash, which undoes itself on reading.  Prefix sums of the turns' tokens lay a
grid of half a budget over the conversation.  The turns that start in one cell form a window; a last turn that
would overflow the budget gets a window of its own.  So no turn is cut, and only a single turn
that is longer than what the budget leaves exceeds it.  Each window starts with the conversation's system turn and repeats
whole turns of limited history before its own; only a window's own assistant texts are under the loss mask, so each
is a target once.

Prefix sums are taken in two steps, inside the parts of a range partitioning and over the parts' totals, so that a
conversation with a large share of all turns is spread over tasks.  Turns are tokenised once and written with a number; windows are worked
out from numbers, lengths and tokens alone, and the texts join them at the end.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import RunFolder, col, per_text

BUDGET, HISTORY = 1024, 256
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escaped(text: Column) -> Column:
    """Backslashes doubled and one put after the first character of each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, r"<(/?s>)", r"<\\$1")
    return F.regexp_replace(text, r"\[(/?INST\])", r"[\\$1")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _turns(convs: DataFrame, ranks: str, pattern: str, conv: str, turn: str, role: str, text: str, run: RunFolder) -> tuple[DataFrame, DataFrame]:
    """Turns in order without their texts (key columns nk and kc, part, place, h, tie, system, target, lead, length, tokens); and tie, seg."""
    kind = convs.schema[conv].dataType
    rows = convs.select(col(conv).isNull().alias("nk"), F.coalesce(col(conv), F.lit(0).cast(kind)).alias("kc"), col(turn).alias("place"),
                        F.coalesce(col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text).cast("string"), F.lit("")).alias("said"))
    head = F.concat(F.lit("<s>[INST]"), escaped(F.col("role")), F.lit("[/INST]"))
    rows = rows.withColumn("head", head).withColumn("seg", F.concat("head", escaped(F.col("said")), F.lit("</s>")))
    rows = rows.select("nk", "kc", "place", F.xxhash64("role", "seg").alias("h"), (F.col("role") == "system").alias("system"), (F.col("role") == "assistant").alias("target"),
                       F.length("head").alias("lead"), F.length("seg").alias("length"), "seg")

    def make():
        own = codec(ranks, pattern)
        return lambda part: {"tokens": pa.array([len(x) for x in own.encode_all(part)], pa.int64())}

    counted = per_text(rows, make, "tokens long", "seg").select("row.*", "tokens")
    # Written before the range partitioning, which reads its input twice.
    counted = run.write(counted.withColumn("tie", F.monotonically_increasing_id()), "counted")
    order = ["nk", "kc", "place", "h", "tie"]
    dealt = counted.drop("seg").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return run.write(dealt, "turns"), counted.select("tie", "seg")


def format_windows(convs: DataFrame, ranks: str, pattern: str, budget: int = BUDGET, history: int = HISTORY, conv: str = "conv_id",
                   turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, window, n_tokens, n_repeated, text, loss: the windows of every conversation.

    ``window`` is the number of tokens before the window's own turns, ``n_repeated`` how many turns at its start are
    repeated, ``loss`` the masked-in spans of ``text`` (code points, end exclusive).  Turns are ordered by ``turn`` (nulls first),
    ties by their content; repeated rows are turns of their own.  Null roles and texts are empty; rows without conv_id form one conversation.  Only a first
    turn of role "system" is retained.  An empty table gives no window.
    """
    if history > budget // 2 or budget < 2:
        raise ValueError("history is limited to half the budget")
    run, key, grid = RunFolder(convs.sparkSession, "chat"), ["nk", "kc"], budget // 2
    turns, texts = _turns(convs, ranks, pattern, conv, turn, role, text, run)
    # Prefix sums: inside a part, then over the few parts that a conversation reaches over.
    over = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = turns.groupBy(*key, "part").agg(F.sum("tokens").alias("sum_tokens"), F.count("*").alias("n"))
    parts = parts.select(*key, "part", F.coalesce(F.sum("sum_tokens").over(over), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n_before"))
    inside = Window.partitionBy(*key, "part").orderBy("place", "h", "tie")
    turns = turns.withColumn("i", F.row_number().over(inside)).withColumn("p", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
    turns = turns.join(parts, [*key, "part"]).select(*key, "tie", "system", "target", "lead", "length", "tokens", (F.col("i") + F.col("n_before")).alias("i"), (F.col("p") + F.col("tokens_before")).alias("p"))
    turns = run.write(turns.withColumn("is_system", F.col("system") & (F.col("i") == 1)), "placed")
    run.drop("turns")
    systems = turns.where("is_system").join(texts, "tie").select(*key, F.col("seg").alias("sys_seg"), F.col("length").alias("sys_length"), F.col("tokens").alias("sys_tokens"))
    systems = run.write(systems, "systems")

    cell = turns.where("not is_system").withColumn("cell", F.floor(F.col("p") / grid))
    cell = cell.withColumn("start", F.min("p").over(Window.partitionBy(*key, "cell"))).join(systems.select(*key, "sys_tokens"), key, "left")
    room = budget - F.coalesce("sys_tokens", F.lit(0))
    own = cell.withColumn("window", F.when(F.col("p") + F.col("tokens") - F.col("start") > room, F.col("p")).otherwise(F.col("start")))
    own = run.write(own.withColumn("room", room).drop("sys_tokens", "start"), "own")

    windows = own.groupBy(*key, "window").agg(F.sum("tokens").alias("new"), F.first("room").alias("room"))
    back = F.greatest(F.lit(0), F.least(F.lit(history), F.col("room") - F.col("new")))
    windows = windows.select(*key, "window", back.alias("back"))
    look = windows.where("back > 0 and window > 0").withColumn("from", F.col("window") - F.col("back"))
    look = look.withColumn("cell", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("from")) / grid), F.floor((F.col("window") - 1) / grid))))
    repeated = look.join(own.select(*key, "cell", "p", "tie", "target", "lead", "length", "tokens"), [*key, "cell"]).where(F.col("p").between(F.col("from"), F.col("window") - 1))

    # The system turn: new in the first window (or alone in a conversation of its own), repeated in the others.
    first = windows.groupBy(*key).agg(F.min("window").alias("first"))
    heads = systems.join(first, key, "left").select(*key, "sys_seg", "sys_length", "sys_tokens", F.coalesce("first", F.lit(0)).alias("first"))
    placed = lambda df, window, new: df.select(
        *key, window.alias("window"), F.lit(-1).cast("long").alias("p"), F.lit(new).alias("new"), F.col("sys_tokens").alias("tokens"), F.col("sys_length").alias("length"),
        F.lit(None).cast("int").alias("from"), F.col("sys_seg").alias("seg"))
    lone = placed(heads, F.col("first"), True)
    kept = placed(windows.join(heads, key).where(F.col("window") > F.col("first")), F.col("window"), False)
    shape = lambda df, new: df.select(*key, "window", "p", F.lit(new).alias("new"), "tokens", "length", F.when(F.lit(new) & F.col("target"), F.col("lead")).alias("from"), "tie")
    said = shape(own, True).unionByName(shape(repeated, False)).join(texts, "tie").drop("tie")
    rows = said.unionByName(lone).unionByName(kept)

    turn_of = F.struct("p", "new", "tokens", "length", "from", "seg")
    made = rows.groupBy(*key, "window").agg(F.sort_array(F.collect_list(turn_of)).alias("t"))  # a window's turns: a budget's worth
    spans = F.expr("""aggregate(t, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,stop:int>>)),
        (a, x) -> named_struct('at', a.at + x.length, 'out', if(x.`from` is null, a.out, concat(a.out, array(named_struct('start', a.at + x.`from`, 'stop', a.at + x.length - 4))))), a -> a.out)""")
    made = made.select(F.when(~F.col("nk"), F.col("kc")).alias("conv_id"), "window", F.expr("aggregate(t, 0L, (a, x) -> a + x.tokens)").alias("n_tokens"),
                       F.size(F.filter("t", lambda x: ~x["new"])).alias("n_repeated"), F.array_join(F.transform("t", lambda x: x["seg"]), "").alias("text"), spans.alias("loss"))
    made = run.write(made, "formatted")
    for name in ("counted", "placed", "systems", "own"):
        run.drop(name)
    return made


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted string."""
    return [(unescaped(a), unescaped(b)) for a, b in _TURN.findall(text)]


def conversation_digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, read back from formatted windows.

    Windows of a conversation are read one by one in order with running digests; nothing of a conversation is gathered.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    ordered = windows.select("conv_id", "window", "n_repeated", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches):
        at, state, done = None, None, []

        def closed():
            conv, n, turns, chars, loss, size, count = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column("conv_id").type
            for row in (r for k in range(0, batch.num_rows, 256) for r in batch.slice(k, 256).to_pylist()):
                if at is None or row["conv_id"] != at[0]:
                    if state:
                        done.append(closed())
                    at, state = (row["conv_id"],), [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in read_turns(row["text"])[row["n_repeated"]:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    text = unescaped(row["text"][span["start"]:span["stop"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(row["text"])
                state[6] += 1
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, id_type if k == 0 else None) for k, c in enumerate(zip(*done))], names)
                done = []
        if state:
            done.append(closed())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, id_type if k == 0 else None) for k, c in enumerate(zip(*done))], names)

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
