"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the
assistant. Dynamic programming over this automaton reads the turns in order; each turn keeps its role or is
relabelled, and then starts a new turn, is merged into the one before, or starts a new turn behind an inserted
empty one. The cheapest sequence of such repairs wins; among equal costs the first in the order of `STATES` (from
the end backwards). The result is rendered as fragments, one row per turn and per inserted turn, whose
concatenation in the order of `part` and `place` is the conversation's text.

Costs of a stretch of turns are a matrix over the automaton's states, and matrices of neighbouring stretches
combine. So a long conversation is cut into the partitions of a range sort: (1) each stretch gives its matrix,
(2) the stretches of a conversation, a few numbers each, are chained to the states at their borders, (3) each
stretch is repaired between its border states. No task holds a whole conversation.

Cases: null and unknown roles cost a relabel; null text is empty; turns are ordered by turn number (null first),
then role, then text, so repeated rows stay and merge; rows with a null conversation id form one conversation; an
empty table gives an empty result. Only the four columns are read, so extra columns and clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelocus.llm.common import field, map_arrow, runs, stored

ROLES = ("system", "user", "assistant")
START = 3
STATES = (*ROLES, "start")
#: Roles that may follow each state.
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
ALIASES = {"system": 0, "developer": 0, "user": 1, "human": 1, "prompter": 1, "assistant": 2, "bot": 2, "gpt": 2, "model": 2, "ai": 2}
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
FAR = 1e18


def role_code(role: str | None) -> int:
    """Index in ROLES; -1 where the role is unknown."""
    return ALIASES.get((role or "").strip().lower(), -1)


def steps() -> list[list[tuple[int, float, int]]]:
    """For each state: (role that follows, cost besides relabelling, inserted role or -1 new turn or -2 merge)."""
    out = []
    for state in range(4):
        best: dict[int, tuple[float, int]] = {}
        options = [(r, 0.0, -1) for r in NEXT[state]] + ([(state, MERGE, -2)] if state != START else [])
        options += [(r, INSERT, x) for x in NEXT[state] for r in NEXT[x]]
        for r, cost, how in options:
            if r not in best or cost < best[r][0]:
                best[r] = (cost, how)
        out.append([(r, cost, how) for r, (cost, how) in sorted(best.items())])
    return out


STEPS = steps()


def stretch_costs(roles: list[int]) -> np.ndarray:
    """Least cost from each state before the stretch to each role after it (4 x 4; from START only the first column set)."""
    cost = np.full((4, 4), FAR)
    np.fill_diagonal(cost, 0.0)
    for role in roles:
        after = np.full((4, 4), FAR)
        for state in range(4):
            for r, extra, _ in STEPS[state]:
                after[:, r] = np.minimum(after[:, r], cost[:, state] + extra + (0.0 if r == role else RELABEL))
        cost = after
    return cost


def repair(roles: list[int], entry: int, leave: int) -> list[tuple[int, int]]:
    """(role, how) of each turn on the cheapest way from one state to another; how as in `steps`."""
    cost, back = np.full(4, FAR), []
    cost[entry] = 0.0
    for role in roles:
        after, came = np.full(4, FAR), [(-1, 0)] * 4
        for state in range(4):
            for r, extra, how in STEPS[state]:
                c = cost[state] + extra + (0.0 if r == role else RELABEL)
                if c < after[r]:
                    after[r], came[r] = c, (state, how)
        cost = after
        back.append(came)
    out, state = [], leave
    for came in reversed(back):
        before, how = came[state]
        out.append((state, how))
        state = before
    return out[::-1]


def close_cost(state: int) -> float:
    """Cost of the end: the assistant has the last word."""
    return 0.0 if state == 2 else INSERT if state == 1 else 2 * INSERT


def border_states(matrices: list[np.ndarray]) -> list[int]:
    """The state before each stretch and after the last one on the cheapest way."""
    cost, back = np.full(4, FAR), []
    cost[START] = 0.0
    for m in matrices:
        total = cost[:, None] + m
        back.append(total.argmin(0))
        cost = total.min(0)
    state = int(np.argmin(cost + np.array([close_cost(s) for s in range(4)])))
    out = [state]
    for came in reversed(back):
        state = int(came[state])
        out.append(state)
    return out[::-1]


def tables(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(schema.types)], schema=schema)


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, part, place, turn, role, action, fragment) of every repaired conversation; `part`, `place` give the order.

    `action`: keep, relabel, merge, merge+relabel or insert. Stores the sorted turns while the result is built.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = df.select(F.col(id_col).alias("_id"), F.col(turn_col).cast("long").alias("_turn"), F.col(role_col).cast("string").alias("_role"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64(F.coalesce("_role", F.lit("")), "_text"))
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Stretches are cut by the columns that order the turns, so that turns of one number stand alike however many there are.
    dealt = stored(rows.repartitionByRange(n, "_id", "_turn", "_role", "_tie").withColumn("_part", F.spark_partition_id()), "chat-turns")

    matrix = T.StructType([field(df, id_col, "_id"), T.StructField("_part", T.IntegerType()), T.StructField("_cost", T.ArrayType(T.DoubleType())), T.StructField("_rows", T.LongType())])
    arrow = to_arrow_schema(matrix)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tables(((r[0][0], r[0][1], stretch_costs([role_code(x[4]) for x in r]).ravel().tolist(), len(r)) for r in runs(batches, 2)), arrow)

    in_order = ["_id", "_part", "_turn", "_role", "_tie"]
    measured = map_arrow(dealt.select("_id", "_part", "_turn", "_tie", "_role").repartition("_id", "_part").sortWithinPartitions(*in_order), measure, matrix)

    border = T.StructType([field(df, id_col, "_id"), *(T.StructField(c, T.IntegerType()) for c in ("_part", "_entry", "_leave", "_last"))])
    border_arrow = to_arrow_schema(border)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for own in runs(batches, 1):
                states = border_states([np.array(r[2]).reshape(4, 4) for r in own])
                for i, r in enumerate(own):
                    yield r[0], r[1], states[i], states[i + 1], int(i == len(own) - 1)

        yield from tables(out(), border_arrow)

    borders = map_arrow(measured.repartition("_id").sortWithinPartitions("_id", "_part"), chain, border)

    shown = T.StructType([field(df, id_col), T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("action", T.StringType()), T.StructField("fragment", T.StringType())])
    shown_arrow = to_arrow_schema(shown)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for own in runs(batches, 2):
                first, place = own[0], 0
                codes = [role_code(r[3]) for r in own]
                state = first[6]
                for r, code, (role, how) in zip(own, codes, repair(codes, first[6], first[7]), strict=True):
                    if how >= 0:
                        yield r[0], r[1], place, None, ROLES[how], "insert", ("" if state == START else "<|end|>\n") + f"<|{ROLES[how]}|>\n"
                        place, state = place + 1, how
                    action = "+".join([*(["merge"] if how == -2 else []), *(["relabel"] if code != role else [])]) or "keep"
                    head = "\n" if how == -2 else ("" if state == START else "<|end|>\n") + f"<|{ROLES[role]}|>\n"
                    yield r[0], r[1], place, r[2], ROLES[role], action, head + r[5]
                    place, state = place + 1, role
                if first[8]:
                    while state != 2:
                        state = NEXT[state][0]
                        yield first[0], first[1], place, None, ROLES[state], "insert", f"<|end|>\n<|{ROLES[state]}|>\n"
                        place += 1
                    yield first[0], first[1], place, None, "assistant", "end", "<|end|>\n"

        yield from tables(out(), shown_arrow)

    joined = dealt.withColumnRenamed("_id", "_conv").join(borders, F.col("_conv").eqNullSafe(F.col("_id")) & (dealt["_part"] == borders["_part"])).select(
        "_id", dealt["_part"], "_turn", "_role", "_tie", "_text", "_entry", "_leave", "_last"
    )
    return map_arrow(joined.repartition("_id", "_part").sortWithinPartitions(*in_order, "_text"), render, shown)


def rendered(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One text per conversation out of `format_chats`, for conversations that fit in a row."""
    return df.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "fragment"))), lambda x: x["fragment"]), "").alias("text"))
