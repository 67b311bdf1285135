"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message followed by alternating user and
assistant messages, user first and assistant last. Each turn of the input gets a role;
cost is paid for giving it another role than its own (``relabel``; an unknown or null role
always pays), for joining it to the message before (``merge``) and for an empty message put
before it or at the end (``insert``). Dynamic programming over the automaton's states finds
the cheapest repair, which is then rendered.

Long conversations: a run of turns acts on the automaton as a matrix of least costs from
entry to exit state, and such matrices combine by (min, +). Turns are numbered by a range
sort (a conversation may span partitions), cut into chunks of ``chunk`` turns, each chunk's
matrix is computed by itself, one small row for each chunk meets per conversation to choose
the states between chunks, and each chunk is then repaired between its two states. So no task holds
more than a chunk of turns. The result has one row for each turn; the rendered conversation is
their ``rendered`` pieces joined in the order of ``pos``.

Order of turns: turn (null first), role, text. Rows that repeat all of them are turns like
others. Null texts count as empty. Rows without conv_id are one conversation without id. An empty
table gives an empty result. Further columns are ignored. Between equal costs the state with the
lower number (system, user, assistant) wins. Markers inside texts are broken by a space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm.store import written

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 40


@dataclass(frozen=True)
class ChatParams:
    relabel: int = 3
    merge: int = 1
    insert: int = 2
    chunk: int = 4096
    open: str = "<|im_start|>{role}\n"
    close: str = "<|im_end|>\n"
    joiner: str = "\n\n"


def moves(params: ChatParams) -> dict[tuple[int, int], tuple[int, bool, tuple[int, ...]]]:
    """(state, next state) -> (cost, joins the message before, empty messages put in), of legal moves, the cheaper way first."""
    m, i = params.merge, params.insert
    both = lambda q, other: (m, True, ()) if m <= i else (i, False, (other,))
    return {
        (START, SYSTEM): (0, False, ()), (START, USER): (0, False, ()), (START, ASSISTANT): (i, False, (USER,)),
        (SYSTEM, SYSTEM): (m, True, ()), (SYSTEM, USER): (0, False, ()), (SYSTEM, ASSISTANT): (i, False, (USER,)),
        (USER, USER): both(USER, ASSISTANT), (USER, ASSISTANT): (0, False, ()),
        (ASSISTANT, USER): (0, False, ()), (ASSISTANT, ASSISTANT): both(ASSISTANT, USER),
    }


def endings(params: ChatParams) -> dict[int, tuple[int, tuple[int, ...]]]:
    """State -> (cost, empty messages) that end a conversation legally."""
    return {SYSTEM: (2 * params.insert, (USER, ASSISTANT)), USER: (params.insert, (ASSISTANT,)), ASSISTANT: (0, ())}


def step_costs(params: ChatParams) -> dict[str | None, list[tuple[int, int, int]]]:
    """Own role -> the moves (state, next state, cost); None stands for every unknown role."""
    out: dict[str | None, list[tuple[int, int, int]]] = {}
    for role in (*ROLES, None):
        own = ROLES.index(role) + 1 if role else 0
        out[role] = [(q, z, c + params.relabel * (z != own)) for (q, z), (c, _, _) in sorted(moves(params).items())]
    return out


def forward(roles: list[str | None], begin: list[int], costs) -> list[list[int]]:
    """Least cost of each state after 0, 1, ... turns, from the costs ``begin`` of the four states."""
    out = [begin]
    for r in roles:
        now, new = out[-1], [INF] * 4
        for q, z, c in costs.get(r, costs[None]):
            if now[q] + c < new[z]:
                new[z] = now[q] + c
        out.append(new)
    return out


def path(roles: list[str | None], entry: int, exit_: int, costs) -> list[int]:
    """The state after each turn on a cheapest way from ``entry`` to ``exit_``; lower states win."""
    least = forward(roles, [0 if q == entry else INF for q in range(4)], costs)
    out, z = [], exit_
    for k in range(len(roles) - 1, -1, -1):
        out.append(z)
        z = min((least[k][q] + c, q) for q, to, c in costs.get(roles[k], costs[None]) if to == z)[1]
    return out[::-1]


def groups(batches, keys: list[str]):
    """Lists of row dicts that share ``keys``, from batches sorted by them."""
    held, key = [], None
    for b in batches:
        for r in b.to_pylist():
            k = tuple(r[c] for c in keys)
            if k != key and held:
                yield held
                held = []
            key = k
            held.append(r)
    if held:
        yield held


def _numbered(batches):
    """Adds the partition and the place of a turn among its conversation's turns in it."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, key, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        at = []
        for k in b.column("key").to_pylist():
            n = n + 1 if k == key else 0
            key = k
            at.append(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], [*b.schema.names, "part", "at"])


def _matrices(params: ChatParams):
    def run(batches):
        import pyarrow as pa

        costs = step_costs(params)
        for g in groups(batches, ["key", "chunk"]):
            roles = [r["role"] for r in g]
            rows = [forward(roles, [0 if q == e else INF for q in range(4)], costs)[-1] for e in range(4)]
            yield pa.RecordBatch.from_pylist([{"key": g[0]["key"], "chunk": g[0]["chunk"], "matrix": [min(c, INF) for r in rows for c in r]}],
                                             pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("matrix", pa.list_(pa.int64()))]))
    return _batched(run)


def _batched(run, rows: int = 4096):
    """Joins the small batches that ``run`` yields."""
    def wrapped(batches):
        import pyarrow as pa

        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return wrapped


def _between(params: ChatParams):
    """Entry and exit state of each chunk of a conversation, and its whole cost."""
    def run(batches):
        import pyarrow as pa

        ends = endings(params)
        schema = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), ("cost", pa.int64())])
        for g in groups(batches, ["key"]):
            each = [np.array(r["matrix"], np.int64).reshape(4, 4) for r in g]
            before = [np.array([0, INF, INF, INF])]
            for m in each:
                before.append(np.minimum((before[-1][:, None] + m).min(0), INF))
            cost, z = min((int(before[-1][q]) + c, q) for q, (c, _) in ends.items())
            out = []
            for k in range(len(each) - 1, -1, -1):
                q = int(np.argmin(before[k] + each[k][:, z]))
                out.append({"key": g[k]["key"], "chunk": g[k]["chunk"], "entry": q, "leave": z, "last": k == len(each) - 1, "cost": cost})
                z = q
            yield pa.RecordBatch.from_pylist(out[::-1], schema)
    return _batched(run)


def _render(params: ChatParams):
    def run(batches):
        import pyarrow as pa

        costs, ways, ends = step_costs(params), moves(params), endings(params)
        head = lambda q: params.open.format(role=ROLES[q - 1])
        empty = lambda qs: "".join(head(q) + params.close for q in qs)
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()),
                            ("n_inserted", pa.int32()), ("cost", pa.int64()), ("conv_cost", pa.int64()), ("rendered", pa.string())])
        for g in groups(batches, ["key", "chunk"]):
            q, out = g[0]["entry"], []
            states = path([r["role"] for r in g], q, g[0]["leave"], costs)
            for i, (r, z) in enumerate(zip(g, states)):
                cost, joins, put = ways[q, z]
                own = r["role"] == ROLES[z - 1]
                body = (r["text"] or "").replace("<|", "< |")
                if joins:
                    piece = params.joiner + body
                else:
                    piece = (params.close if q != START else "") + empty(put) + head(z) + body
                n, cost = len(put), cost + (0 if own else params.relabel)
                if r["last"] and i == len(g) - 1:
                    more, closing = ends[z]
                    piece, n, cost = piece + params.close + empty(closing), n + len(closing), cost + more
                action = ("merge" if joins else "keep") if own else ("relabel+merge" if joins else "relabel")
                out.append({"conv_id": r["conv_id"], "turn": r["turn"], "pos": r["pos"], "role": r["role"], "new_role": ROLES[z - 1], "action": action,
                            "n_inserted": n, "cost": cost, "conv_cost": r["cost"], "rendered": piece})
                q = z
            yield pa.RecordBatch.from_pylist(out, schema)
    return _batched(run)


def repair_and_render(conversations: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """One row for each turn of ``conversations`` (conv_id, turn, role, text): its place, new role, action, cost and rendered piece."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("key")
    turns = conversations.select(key, "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("row"))
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first(), F.col("row")]
    sorted_ = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    shape = "key string, conv_id bigint, turn bigint, role string, text string"
    placed = written(sorted_.mapInArrow(_numbered, f"{shape}, part int, at bigint"), "turns")
    spans = placed.groupBy("key", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = written(spans.select("key", "part", before.alias("before")), "turn-offsets")
    turns = placed.join(spans, ["key", "part"]).withColumn("pos", F.col("before") + F.col("at")).drop("before", "at", "part")
    turns = written(turns.withColumn("chunk", F.floor(F.col("pos") / params.chunk).cast("bigint")), "chunked-turns")
    apart = lambda df: df.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "pos")
    matrices = apart(turns.select("key", "chunk", "pos", "role")).mapInArrow(_matrices(params), "key string, chunk bigint, matrix array<bigint>")
    meet = matrices.repartition("key").sortWithinPartitions("key", "chunk")
    plan = written(meet.mapInArrow(_between(params), "key string, chunk bigint, entry int, leave int, last boolean, cost bigint"), "chunk-states")
    both = apart(turns.join(plan, ["key", "chunk"]))
    return both.mapInArrow(_render(params), "conv_id bigint, turn bigint, pos bigint, role string, new_role string, action string, n_inserted int, "
                           "cost bigint, conv_cost bigint, rendered string")
