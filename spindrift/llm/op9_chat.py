"""Chat formatting by minimum-cost role repair.

Legal conversations follow an automaton: system may come first, then user and
assistant alternate, the assistant comes last.  A turn may be kept, relabelled,
or merged with the turn before it, and empty turns may be inserted; dynamic
programming over the automaton's states finds the cheapest repair, and the
repaired sequence is rendered.

A conversation is cut into segments by turn number.  A segment's repair costs form
a small (min, +) matrix from entry state to exit state; a scan over these matrices
fixes the states at the cuts, and each segment is then repaired and rendered by
itself.  The segments' texts in order are the whole rendering, so a conversation
of any length fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import materialize, table

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Legal next states; a conversation may end after the assistant only.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
# Names that are taken for a role.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
MERGE, INSERT, RELABEL, NAME_UNKNOWN = 2, 3, 4, 1
_FAR = 1 << 40


def role_of(name: str | None) -> int:
    """State of a role name; START stands for a name that is unknown, empty or null."""
    return ALIASES.get((name or "").strip().lower(), START)


def _inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest empty turns that lead from one state to another, both states' own turns apart."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for a in range(4):
        level = [(a, ())]
        for _ in range(4):
            for state, path in level:
                for b in NEXT[state]:
                    found.setdefault((a, b), path)
            level = [(b, (*path, b)) for state, path in level for b in NEXT[state]]
    return found


INSERTS = _inserts()


def _label_cost(role: int, label: int) -> int:
    return 0 if role == label else NAME_UNKNOWN if role == START else RELABEL


def _moves(role: int) -> tuple[np.ndarray, dict[tuple[int, int], tuple[tuple[int, ...], bool]]]:
    """Costs from state to state of taking in one turn, and how: (turns inserted before it, whether it is merged)."""
    cost = np.full((4, 4), _FAR, np.int64)
    how: dict[tuple[int, int], tuple[tuple[int, ...], bool]] = {}
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            ways = [(_label_cost(role, b) + INSERT * len(INSERTS[a, b]), INSERTS[a, b], False)] if (a, b) in INSERTS else []
            if a == b:
                ways.append((_label_cost(role, b) + MERGE, (), True))
            if ways:
                c, path, merged = min(ways)
                cost[a, b], how[a, b] = c, (path, merged)
    return cost, how


MOVES = [_moves(r) for r in range(4)]
#: Turns inserted at the end, and their cost, by state.
CLOSING = {q: () if q == ASSISTANT else (*INSERTS[q, ASSISTANT], ASSISTANT) for q in (SYSTEM, USER, ASSISTANT)}
CLOSE_COST = np.array([_FAR, *(INSERT * len(CLOSING[q]) for q in (SYSTEM, USER, ASSISTANT))], np.int64)


def segment_matrix(roles: list[int]) -> np.ndarray:
    m = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for r in roles:
        m = np.minimum((m[:, :, None] + MOVES[r][0][None]).min(axis=1), _FAR)
    return m


def cut_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, exit) state of each segment on the cheapest way; of equal ways that of the smaller states, last first."""
    best, back = np.array([0, _FAR, _FAR, _FAR], np.int64), []
    for m in matrices:
        through = best[:, None] + m
        back.append(through.argmin(axis=0))
        best = np.minimum(through.min(axis=0), _FAR)
    state, out = int((best + CLOSE_COST).argmin()), []
    for k in range(len(matrices) - 1, -1, -1):
        before = int(back[k][state])
        out.append((before, state))
        state = before
    return out[::-1]


def repair(roles: list[int], entry: int, exit_: int) -> tuple[int, list[tuple[tuple[int, ...], int, bool]]]:
    """Cost and, for each turn, (labels of empty turns before it, its label, merged with the turn before)."""
    best, back = np.full(4, _FAR, np.int64), []
    best[entry] = 0
    for r in roles:
        through = best[:, None] + MOVES[r][0]
        back.append(through.argmin(axis=0))
        best = np.minimum(through.min(axis=0), _FAR)
    state, out = exit_, []
    for k in range(len(roles) - 1, -1, -1):
        before = int(back[k][state])
        path, merged = MOVES[roles[k]][1][before, state]
        out.append((path, state, merged))
        state = before
    return int(best[exit_]), out[::-1]


def _safe(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


def render(texts: list[str | None], roles: list[int], entry: int, exit_: int, last: bool) -> tuple[str, int, int, int, int, int]:
    """Rendered segment, its cost and numbers of turns begun, merged, relabelled and inserted."""
    cost, steps = repair(roles, entry, exit_)
    out: list[str] = []
    is_open = entry != START
    turns = merged = relabelled = inserted = 0

    def begin(label: int, text: str) -> None:
        nonlocal is_open, turns
        out.append(("<|im_end|>\n" if is_open else "") + f"<|im_start|>{ROLES[label]}\n{text}")
        is_open, turns = True, turns + 1

    for text, role, (path, label, joined) in zip(texts, roles, steps, strict=True):
        for empty in path:
            begin(empty, "")
        inserted += len(path)
        relabelled += role != label
        if joined:
            merged += 1
            out.append("\n\n" + _safe(text))
        else:
            begin(label, _safe(text))
    if last:
        for empty in CLOSING[exit_]:
            begin(empty, "")
        inserted += len(CLOSING[exit_])
        cost += int(CLOSE_COST[exit_])
        out.append("<|im_end|>\n")
    return "".join(out), cost, turns, merged, relabelled, inserted


_SEGMENT = "conv_id long, part string, segment long"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [segment_matrix([role_of(r) for r in roles]).ravel().tolist() for roles in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["conv_id", "part", "segment", "costs"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("segment", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("last", pa.bool_())]))
    for batch in batches:
        out = []
        for chain in batch.column(2).to_pylist():
            found = cut_states([np.array(x["costs"]).reshape(4, 4) for x in chain])
            out.append([{"segment": x["segment"], "entry": a, "exit": b, "last": k == len(chain) - 1} for k, (x, (a, b)) in enumerate(zip(chain, found, strict=True))])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["conv_id", "part", "states"])


_RESULT = "conv_id long, segment long, rendered string, cost long, n_turns long, n_merged long, n_relabelled long, n_inserted long"


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _RESULT.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = zip(*(part.column(c).to_pylist() for c in ("turns", "entry", "exit", "last")), strict=True)
            found = [render([t["text"] for t in turns], [role_of(t["role"]) for t in turns], a, b, last) for turns, a, b, last in rows]
            columns = [pa.array([x[0] for x in found], pa.string()), *(pa.array([x[i] for x in found], pa.int64()) for i in range(1, 6))]
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("segment"), *columns], names=names)


def format_chats(turns: DataFrame, segment_turns: int = 1024) -> DataFrame:
    """Repaired and rendered conversations of ``turns`` (conv_id, turn, role, text), a row for each segment.

    Turns are ordered by number, then role, then text; those without a number come
    last.  Repeated rows are turns of their own, so none is lost.  A null or unknown
    role is relabelled, a null text is empty; a text's own "<|im_" becomes "<| im_", so
    that no text can close its turn.  Rows without conv_id cannot be told apart and are
    conversations of one turn each.  An empty table gives no rows; other columns are
    ignored.
    """
    # a conversation without id is known by its content, so that a repeated task makes it again; equal ones are counted
    nameless = turns.where("conv_id IS NULL").groupBy(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    nameless = nameless.select(F.lit(None).cast("long").alias("conv_id"), F.sha2(F.to_json(F.struct("role", "text")), 256).alias("part"), F.lit(0).cast("long").alias("turn"), "role", "text", "copies")
    named = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.lit("").alias("part"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
        F.lit(1).cast("long").alias("copies"),
    ).unionByName(nameless)
    segment = F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit((1 << 62))).cast("long")
    listed = named.groupBy("conv_id", "part", segment.alias("segment")).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("turn", F.lit((1 << 62))).alias("turn"), "role", "text"))).alias("turns"), F.max("copies").alias("copies"))
    kept, _ = materialize(listed, "chat-segments")
    matrices = kept.select("conv_id", "part", "segment", F.col("turns.role").alias("roles")).mapInArrow(_matrices, f"{_SEGMENT}, costs array<long>")
    chains = matrices.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("segment", "costs"))).alias("chain"))
    states = chains.mapInArrow(_states, "conv_id long, part string, states array<struct<segment:long,entry:int,exit:int,last:boolean>>")
    flat = states.select(F.col("conv_id").alias("__id"), F.col("part").alias("__part"), F.inline("states")).withColumnRenamed("segment", "__segment")
    joined = kept.join(flat, kept["conv_id"].eqNullSafe(flat["__id"]) & (kept["part"] == flat["__part"]) & (kept["segment"] == flat["__segment"]))
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("conv_id", "segment", "turns", "entry", "exit", "last").mapInArrow(_rendered, _RESULT)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
