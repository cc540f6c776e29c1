"""Conversation structure repair: cheapest edits that make a conversation alternate, by a time-major dynamic programme.

A conversation's rows are taken by turn. A row may be kept (0), given another role (2) or deleted (3; blank rows and repeats
must be); a turn without text may be inserted anywhere (2); a truncated row that is not deleted adds 1. What remains has the
role initials `(s?(ua)+)?`: four states (nothing yet, after s, after u, after a), between which a new role is always forced.

Costs are tensors: conversations of like length are one bucket, and each step of time is a few numpy operations on all of them.
Costs to go (from each state to the end) are stored backwards for each step, then all edits are traced forwards at once; of
edits that cost the same the ASCII-least is taken at each step, which gives the least sequence, as the rest of a sequence
follows from the state alone.

No task holds a whole conversation. Rows without their texts are sorted by ranges, so that a long conversation lies in many
partitions, and cut into pieces of PIECE rows. A conversation of one piece is solved at once. A piece of a longer one first
gives a matrix, the least cost from each state to each; the matrices of a conversation (16 numbers for PIECE rows) are chained
from its end, each piece is traced from each state it may be entered in, and the states are chained from the beginning. Texts
are shuffled once, by conversation, and stream through the hash in order (a hash of a whole conversation is one chain).

Defined results: nulls in role and text, and in the ids of the damage, count as one space. Rows without a conv_id are one
conversation. Rows of one turn are in the order of role, then of a digest of role and text. Rows that repeat conv_id and turn
are damaged alike. A role's initial is its first character; a role that is neither s, u nor a can't be kept. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored

#: Rows of a piece as a power of two, cells of a tensor, and a cost that is never reached.
PIECE_BITS, CELLS, NEVER = 12, 1 << 19, 1 << 28
#: The costs of edits, and of a truncated row.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Codes of rows: the class of the role (s, u, a, other) and four times the fault.
SOUND, CUT, BLANK, AGAIN, FILLER = 0, 1, 2, 3, 16
BLANKS = r"[\x20\x09-\x0D]"

#: Where each state (0 nothing, 1 after s, 2 after u, 3 after a; 4 is nowhere) goes with a kept role, and with a new one.
_KEPT = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
_NEW = np.array([2, 2, 3, 2])
_NAMES = {2: "user", 3: "assistant"}
#: Costs to go at the end of a conversation.
_AT_END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int32)
_SAME = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int32)


def backwards(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs to go [time, conversation, end, state] of codes [time, conversation] and costs at the end [conversation, end, state]."""
    n, many = codes.shape
    out = np.empty((n + 1, *ends.shape), dtype=np.int32)
    out[n] = ends
    fault, role = codes // 4, codes % 4
    with_dead = np.full((*ends.shape[:2], 5), NEVER, dtype=np.int32)
    for t in range(n - 1, -1, -1):
        with_dead[:, :, :4] = out[t + 1]
        stays = np.where(fault[t] >= BLANK, NEVER, fault[t] * TRUNCATED).astype(np.int32)[:, None, None]
        kept = np.take_along_axis(with_dead, np.broadcast_to(_KEPT[role[t]][:, None, :], ends.shape), axis=2) + stays
        least = np.minimum(np.minimum(out[t + 1] + DELETE, kept), with_dead[:, :, _NEW] + (stays + RENAME))
        now = out[t]
        np.minimum(least[..., 2], least[..., 3] + INSERT, out=now[..., 2])
        np.minimum(least[..., 3], least[..., 2] + INSERT, out=now[..., 3])
        np.minimum(least[..., 0], now[..., 2] + INSERT, out=now[..., 0])
        np.minimum(least[..., 1], now[..., 2] + INSERT, out=now[..., 1])
        idle = fault[t] >= FILLER // 4
        now[idle] = out[t + 1][idle]
        np.minimum(now, NEVER, out=now)
    return out


def traced(codes: np.ndarray, costs: np.ndarray, entered: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Edits (initials) and last states of conversations entered in these states; costs [time, conversation, state]."""
    n, many = codes.shape
    row, state = np.arange(many), entered.copy()
    letters = np.zeros((many, 3 * n), dtype=np.uint8)
    fault, role = codes // 4, codes % 4
    for t in range(n):
        here, there, busy = costs[t], costs[t + 1], fault[t] < FILLER // 4
        for k in range(2):
            gone = there[row, state] + DELETE == here[row, state]
            put = busy & ~gone & (here[row, _NEW[state]] + INSERT == here[row, state])
            letters[put, 3 * t + k] = ord("I")
            state = np.where(put, _NEW[state], state)
        cost = here[row, state]
        gone = there[row, state] + DELETE == cost
        stays, to = fault[t] * TRUNCATED, _KEPT[role[t], state]
        kept = ~gone & (to < 4) & (fault[t] < BLANK) & (there[row, np.minimum(to, 3)] + stays == cost)
        letters[busy, 3 * t + 2] = np.where(gone, ord("D"), np.where(kept, ord("K"), ord("R")))[busy]
        state = np.where(~busy | gone, state, np.where(kept, to, _NEW[state]))
    return [x[x > 0].tobytes() for x in letters], state


def _at_end(edits: bytes, state: int) -> bytes:
    return edits + b"I" * int(_AT_END[state] // INSERT)


def buckets(codes: list[np.ndarray]):
    """Indices and codes [time, conversation] of bounded buckets of like length; shorter ones are filled up at the end."""
    size = np.array([len(c) for c in codes])
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        # As many as fit, none less than half as long as the longest but the shortest of all.
        limit = max(16, 2 * size[order[at]])
        width = int(np.searchsorted(size[order], limit, side="right")) - at
        some = order[at : at + max(1, min(width, CELLS // limit))]
        tensor = np.full((size[some].max(), len(some)), FILLER, dtype=np.int32)
        for k, i in enumerate(some):
            tensor[: size[i], k] = codes[i]
        yield some, tensor
        at += len(some)


def solved(codes: list[np.ndarray]) -> list[tuple[bytes, int]]:
    """The cheapest edits of whole conversations and what they cost."""
    out: list = [None] * len(codes)
    for some, tensor in buckets(codes):
        costs = backwards(tensor, np.broadcast_to(_AT_END, (len(some), 1, 4)))[:, :, 0]
        edits, state = traced(tensor, costs, np.zeros(len(some), dtype=np.int64))
        for i, e, q, c in zip(some, edits, state, costs[0, :, 0], strict=True):
            out[i] = (_at_end(e, q), int(c))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: rows dropped, emptied, stripped of sentence ends, repeated or given the role user by the hash of
    conv_id and turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    rows = conversations.select("conv_id", "turn", F.when(k == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), k.alias("_k")).where("_k != 0")
    return rows.withColumn("_copy", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _digest() -> Column:
    own = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    return F.unhex(F.sha2(F.concat(F.md5(own), F.md5("role"), F.col("text")), 256))


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copy and code: what is known of each row without its text."""
    blank = ~F.col("text").rlike(BLANKS.replace("[", "[^", 1))
    cut = ~F.col("text").rlike(rf"[.!?]{BLANKS}*\z")
    narrow = rows.select("conv_id", "turn", "role", _digest().alias("digest"), blank.alias("blank"), cut.alias("cut"))
    alike = narrow.groupBy("conv_id", "turn", "role", "digest").agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.count("*").alias("n"))
    first = alike.groupBy("digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("turns"))
    told = salted_join(alike, first, "digest", "turns", "turn").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    again = (F.col("copy") > 1) | ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.col("blank"), BLANK).when(again, AGAIN).when(F.col("cut"), CUT).otherwise(SOUND)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = role + 4 * fault
    return told.select("conv_id", "turn", "role", "digest", "copy", code.cast("short").alias("code"))


def pieces(rows: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """conv_id, piece (rising within a conversation), codes (of at most 2**bits rows, in order), turn, role, digest (of the first)."""
    order = ["conv_id", "turn", "role", "digest", "copy"]
    placed = coded(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    row = F.array_sort(F.collect_list(F.struct("place", "code", "turn", "role", "digest")))
    cut = stored(placed, "places").groupBy("conv_id", F.shiftright("place", bits).alias("piece")).agg(row.alias("rows"))
    return cut.select("conv_id", "piece", F.transform("rows", lambda r: r["code"]).alias("codes"), *(F.col("rows")[0][c].alias(c) for c in ("turn", "role", "digest")))


def _arrays(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    return [flat[a - at[0] : b - at[0]] for a, b in zip(at, at[1:], strict=False)]


def _with(batch: pa.RecordBatch, drop: list[str], **more: pa.Array) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c not in drop]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more.values()], [*names, *more])


def _mapped(df: DataFrame, drop: list[str], more: dict[str, str], told) -> DataFrame:
    """df without the columns `drop` and with those of `more`, which told(batch) gives as Arrow arrays."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop]
    return df.mapInArrow(lambda batches: (_with(b, drop, **told(b)) for b in batches), ", ".join([*kept, *(f"{k} {v}" for k, v in more.items())]))


def _whole(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    found = solved(_arrays(batch.column("codes")))
    return {"edits": pa.array([e.decode() for e, _ in found], pa.string()), "cost": pa.array([c for _, c in found], pa.int64())}


def _matrix(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    codes = _arrays(batch.column("codes"))
    out: list = [None] * len(codes)
    for some, tensor in buckets(codes):
        first = backwards(tensor, np.broadcast_to(_SAME, (len(some), 4, 4)))[0]
        for i, m in zip(some, first, strict=True):
            out[i] = m.ravel().tolist()  # [end, state]
    return {"matrix": pa.array(out, pa.list_(pa.int64()))}


def _entries(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """Costs at the end of each piece of a conversation (`parts`: piece and matrix, in order), and the whole cost with the first."""
    out = []
    for parts in batch.column("parts").to_pylist():
        ends, after = [], _AT_END.astype(np.int64)
        for k in range(len(parts) - 1, -1, -1):
            before = (np.array(parts[k]["matrix"]).reshape(4, 4) + after[:, None]).min(axis=0)
            ends.append({"piece": parts[k]["piece"], "ends": after.tolist(), "last": k == len(parts) - 1, "cost": int(before[0]) if k == 0 else 0})
            after = np.minimum(before, NEVER)
        out.append(ends[::-1])
    return {"known": pa.array(out, pa.list_(pa.struct([("piece", pa.int64()), ("ends", pa.list_(pa.int64())), ("last", pa.bool_()), ("cost", pa.int64())])))}


def _each_entry(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """The edits of each piece from each state that it may be entered in, and the states that it then is left in."""
    codes, ends, last = _arrays(batch.column("codes")), np.array(batch.column("ends").to_pylist(), dtype=np.int32).reshape(-1, 4), batch.column("last").to_pylist()
    ways: list = [None] * len(codes)
    for some, tensor in buckets(codes):
        costs = backwards(tensor, ends[some][:, None])[:, :, 0]
        each = [traced(tensor, costs, np.full(len(some), q)) for q in range(4)]
        for k, i in enumerate(some):
            ways[i] = [{"edits": (_at_end(e[k], s[k]) if last[i] else e[k]).decode(), "left": int(s[k])} for e, s in each]
    return {"ways": pa.array(ways, pa.list_(pa.struct([("edits", pa.string()), ("left", pa.int64())])))}


def _chained(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """The state in which each piece is entered (`parts`: piece and the states left from each)."""
    out = []
    for parts in batch.column("parts").to_pylist():
        state, taken = 0, []
        for p in parts:
            taken.append({"piece": p["piece"], "state": state})
            state = p["left"][state]
        out.append(taken)
    return {"entered": pa.array(out, pa.list_(pa.struct([("piece", pa.int64()), ("state", pa.int64())])))}


def edited(cut: DataFrame) -> DataFrame:
    """Each of `pieces` with edits and cost (the conversation's with its first piece, else 0), without codes."""
    joined = lambda a, b, keys: a.join(b, [F.col(f"`{k}`").eqNullSafe(b[f"_{k}"]) for k in keys], "inner").drop(*(f"_{k}" for k in keys))
    known = stored(cut, "pieces")
    number = known.groupBy(F.col("conv_id").alias("_conv_id")).agg(F.count("*").alias("_pieces"))
    counted = joined(known, number, ["conv_id"])
    answer = {"edits": "string", "cost": "long"}
    short = _mapped(counted.where("_pieces = 1").drop("_pieces"), ["codes"], answer, _whole)
    parts = counted.where("_pieces > 1").drop("_pieces")
    if number.where("_pieces > 1").isEmpty():
        return short
    by_conversation = lambda df, *of: df.groupBy(F.col("conv_id").alias("_conv_id")).agg(F.array_sort(F.collect_list(F.struct("piece", *of))).alias("parts"))
    matrices = _mapped(parts.select("conv_id", "piece", "codes"), ["codes"], {"matrix": "array<long>"}, _matrix)
    ends = _mapped(by_conversation(matrices, "matrix"), ["parts"], {"known": "array<struct<piece: long, ends: array<long>, last: boolean, cost: long>>"}, _entries)
    ends = ends.select("_conv_id", F.inline("known")).withColumnRenamed("piece", "_piece")
    ways = stored(_mapped(joined(parts, ends, ["conv_id", "piece"]), ["codes", "ends", "last"], {"ways": "array<struct<edits: string, left: long>>"}, _each_entry), "ways")
    states = _mapped(by_conversation(ways, F.transform("ways", lambda w: w["left"]).alias("left")), ["parts"], {"entered": "array<struct<piece: long, state: long>>"}, _chained)
    states = states.select("_conv_id", F.inline("entered")).withColumnRenamed("piece", "_piece")
    long = joined(ways, states, ["conv_id", "piece"]).withColumn("edits", F.col("ways")[F.col("state").cast("int")]["edits"]).drop("ways", "state")
    return short.unionByName(long.select(short.columns))


class _Repair:
    """One conversation as it streams by: rows and edits in order."""

    def __init__(self, conv_id):
        self.conv_id, self.hash = conv_id, hashlib.sha256()
        self.edits, self.at, self.parts, self.cost, self.state, self.begun = "", 0, [], 0, 0, False
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def take(self, edits: str, cost: int, faults: list[int]) -> None:
        self.edits, self.at = self.edits[self.at :] + edits, 0
        self.parts.append(edits)
        self.cost += cost
        self.truncated, self.blank, self.duplicate = self.truncated + faults[CUT], self.blank + faults[BLANK], self.duplicate + faults[AGAIN]

    def _say(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def _insert(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            self.state = int(_NEW[self.state])
            self._say(_NAMES[self.state], "")

    def row(self, turn, role: str, text: str) -> None:
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self._insert()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = int(_KEPT["sua".index(role[:1]), self.state])
            self._say(role, text)
        elif edit == "R":
            self.state = int(_NEW[self.state])
            self._say(_NAMES[self.state], text)

    def done(self) -> dict:
        self._insert()
        gaps = 0 if self.low is None else int(self.high) - int(self.low) + 1 - self.turns
        return {
            "conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "cost": self.cost, "audit": "".join(self.parts), "repaired_sha256": self.hash.hexdigest(),
        }


ANSWER = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(conversations: DataFrame, rows: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """One row for each conversation of `conversations`, of which `rows` (conv_id, turn, role, text) are what is left:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the edits), repaired_sha256 (of what they make)."""
    faults = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.size(F.filter("codes", lambda c: F.floor(c / 4) == k)).cast("long"))
    told = edited(pieces(rows, bits).withColumn("faults", faults))
    none = lambda kind: F.lit(None).cast(kind)
    turn = rows.schema["turn"].dataType
    all_ids = conversations.select("conv_id").distinct().select("conv_id", none(turn).alias("turn"), none("string").alias("role"), none("binary").alias("digest"), F.lit(-1).cast("long").alias("kind"), none("string").alias("text"), none("long").alias("cost"), none("array<long>").alias("faults"))
    edits = told.select("conv_id", "turn", "role", "digest", F.col("piece").alias("kind"), F.col("edits").alias("text"), "cost", "faults")
    own = rows.select("conv_id", "turn", "role", _digest().alias("digest"), F.lit((1 << 63) - 1).alias("kind"), "text", none("long").alias("cost"), none("array<long>").alias("faults"))
    stream = all_ids.unionByName(edits).unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "kind")
    names = [p.split()[0] for p in ANSWER.split(", ")]
    kind_of_id = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, begun = None, False
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "kind", "text", "cost", "faults")]
            for conv_id, turn, role, kind, text, cost, faults in zip(*columns, strict=True):
                if not begun or conv_id != now.conv_id:
                    if begun:
                        out.append(now.done())
                    now, begun = _Repair(conv_id), True
                if kind == (1 << 63) - 1:
                    now.row(turn, role, text)
                elif kind >= 0:
                    now.take(text, cost, faults)
            yield from _answers(batch, out)
        if begun:
            yield from _answers(batch, [now.done()])

    def _answers(batch, out):
        if out:
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([o["conv_id"] for o in out], batch.schema.field("conv_id").type), *(pa.array([o[c] for o in out], k) for c, k in zip(names, kinds, strict=True))], ["conv_id", *names])

    return stream.mapInArrow(run, f"conv_id {kind_of_id}, {ANSWER}")

