"""Repair of the structure of conversations, by dynamic programming over runs.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`.
Each row is a symbol: the class of its role and whether it is truncated, or that
it must be deleted (blank, or its role and text were seen earlier).  A symbol is
a min-plus matrix over the four states of that form: what it costs to go from
one state to another over the row, insertions before it included.  Equal
consecutive symbols are one run; a run of any length is taken through the binary
powers of its matrix, which are made once, so costs to the end are known at each
run's end, and at each row of it by doubling.  Going forward, the edit that comes
first in ASCII among those that keep to the least cost is taken, which gives the
least audit.

Matrices of consecutive rows multiply, so a conversation of over UNIT rows is
cut into segments of consecutive rows: each gives its matrix, the costs behind
each segment follow from the matrices alone, each segment unrolls its choices
from every state it may be entered in, and the states chain.  Only the digest of
the repaired text goes through one task a conversation, as SHA-256 is a chain; it
streams through, a piece at a time.

Defined results: a null role or text is one space; a null turn comes first, a
null conversation is one of its own; rows of one turn go by role, then by the
SHA-256 of their text; a role is told by its initial, an empty role has none and
must be edited; a conversation without rows costs nothing and has an empty audit;
an empty table gives an empty table; columns besides those named are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, materialise, salted_join

#: Rows of a conversation that one task takes together; longer ones are cut.
UNIT = 20_000
SPACE = "\t\n\x0b\f\r "

#: States: nothing yet, after a system row, after a user row, after an assistant row.
STATES = 4
#: Where a user or assistant row leads, put in or rerolled: only one of the two fits.
PUT = (2, 2, 3, 2)
#: Where a kept row leads, by the initial of its role.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
CLASSES = ("s", "u", "a", "")
DELETED = 2 * len(CLASSES)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_FAR = 1 << 40
#: What is left to pay behind the last row: insertions up to a whole number of exchanges.
END = np.array([0, 2 * INSERT, INSERT, 0])
LEGAL = ("su", "ua", "au")
#: Conversations of so many rows are remembered with their plan, in a table of so many.
_SHORT, _REMEMBERED = 64, 50_000


def symbol_of(role: Column, text: Column) -> Column:
    """The class of a row that isn't a duplicate: DELETED if blank, else twice its initial's place and one if truncated."""
    shown = F.rtrim(text, F.lit(SPACE))
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CLASSES[:-1]]), F.substring(role, 1, 1)) - 1, F.lit(-1))
    place = F.when(place < 0, len(CLASSES) - 1).otherwise(place)
    return F.when(shown == "", DELETED).otherwise(2 * place + F.when(F.substring(shown, -1, 1).isin(".", "!", "?"), 0).otherwise(1)).cast("int")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product; b may be rows of costs to go."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def matrix_of(symbol: int) -> np.ndarray:
    """What it costs to go from state to state over a row, insertions before it included."""
    step = np.full((STATES, STATES), _FAR)
    np.fill_diagonal(step, DELETE)
    if symbol != DELETED:
        more = TRUNCATED * (symbol % 2)
        for state in range(STATES):
            step[state, PUT[state]] = min(step[state, PUT[state]], REROLE + more)
            if state in KEPT[CLASSES[symbol // 2]]:
                to = KEPT[CLASSES[symbol // 2]][state]
                step[state, to] = min(step[state, to], KEEP + more)
    put = np.full((STATES, STATES), _FAR)
    put[np.arange(STATES), PUT] = INSERT
    np.fill_diagonal(put, 0)
    return product(product(put, put), step)


class Powers:
    """The binary powers of each symbol's matrix, each made once."""

    def __init__(self):
        self.of: dict[int, list[np.ndarray]] = {}

    def power(self, symbol: int, k: int) -> np.ndarray:
        own = self.of.setdefault(symbol, [])
        if not own:
            own.append(matrix_of(symbol))
        while len(own) <= k:
            own.append(product(own[-1], own[-1]))
        return own[k]

    def over(self, symbol: int, n: int) -> np.ndarray:
        """The matrix of a run of n rows."""
        out = None
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = self.power(symbol, k) if out is None else product(out, self.power(symbol, k))
        return out

    def to_go(self, symbol: int, n: int, end: np.ndarray) -> np.ndarray:
        """Costs to go with 0 to n rows of a run still to come, n + 1 rows by state."""
        out = np.empty((n + 1, STATES), np.int64)
        out[0], have, k = end, 1, 0
        while have <= n:
            some = min(have, n + 1 - have)
            out[have : have + some] = product(self.power(symbol, k), out[:some].T).T
            have, k = 2 * have, k + 1
        return out


def runs_of(symbols: Iterable[int]) -> list[tuple[int, int]]:
    return [(s, sum(1 for _ in own)) for s, own in groupby(symbols)]


def matrix_of_runs(runs: list[tuple[int, int]], powers: Powers) -> np.ndarray:
    out = None
    for symbol, n in runs:
        one = powers.over(symbol, n)
        out = one if out is None else product(out, one)
    return out


def unroll(runs: list[tuple[int, int]], end: np.ndarray, states: Iterable[int], powers: Powers, closing: bool) -> list[tuple[str, int, int]]:
    """(audit, state after it, cost to the end) from each of the states, end being the costs to go behind the runs; closing puts in what is missing then."""
    behind, ends = [], end
    for symbol, n in reversed(runs):
        behind.append(powers.to_go(symbol, n, ends))
        ends = behind[-1][n]
    behind.reverse()
    found = []
    for first in states:
        state, audit = first, []
        for (symbol, n), costs in zip(runs, behind, strict=True):
            more, kept = TRUNCATED * (symbol % 2), KEPT[CLASSES[symbol // 2]] if symbol != DELETED else {}
            table = costs.tolist()
            for left in range(n, 0, -1):
                now, then = table[left], table[left - 1]
                while True:
                    if DELETE + then[state] == now[state]:
                        audit.append("D")
                    elif INSERT + now[PUT[state]] == now[state]:
                        audit.append("I")
                        state = PUT[state]
                        continue
                    elif state in kept and KEEP + more + then[kept[state]] == now[state]:
                        audit.append("K")
                        state = kept[state]
                    else:
                        audit.append("R")
                        state = PUT[state]
                    break
        while closing and state in (1, 2):
            audit.append("I")
            state = PUT[state]
        found.append(("".join(audit), state, int(ends[first])))
    return found


def replay(audit: str, state: int, rows: Iterable[tuple[str, str]]) -> Iterator[str]:
    """The lines `role:text` that an audit leaves of rows (role, text)."""
    rows = iter(rows)
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        if edit == "K":
            role, text = next(rows)
            state = KEPT[role[:1]][state]
        else:
            state = PUT[state]
            role, text = "user" if state == 2 else "assistant", next(rows)[1] if edit == "R" else ""
        yield f"{role}:{text}"


def tally(symbols: list[int], blank: list[bool], initials: list[str]) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows and illegal neighbours."""
    gone, blanks = sum(s == DELETED for s in symbols), sum(blank)
    return blanks, gone - blanks, sum(s % 2 for s in symbols if s != DELETED), sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


FIELDS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long"
_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string()), ("n_rows", pa.int64())]
)


def _gaps(turns: set[int]) -> int:
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


def _whole(conv: int | None, rows: list[tuple], powers: Powers, plans: dict) -> dict:
    """The result of a conversation from its rows (turn, role, text, symbol, times), in order but for ties of turn."""
    if len({r[0] for r in rows}) < len(rows):
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    rows = [r for r in rows for _ in range(r[4])]
    seen: set[tuple[str, str]] = set()
    symbols, blank = [], []
    for _, role, text, symbol, _ in rows:
        blank.append(symbol == DELETED)
        symbols.append(DELETED if (role, text) in seen else symbol)
        seen.add((role, text))
    key = bytes(symbols)
    plan = plans.get(key)
    if plan is None:
        plan = unroll(runs_of(symbols), END, (0,), powers, True)[0]
        if len(key) <= _SHORT and len(plans) < _REMEMBERED:
            plans[key] = plan
    audit, _, cost = plan
    counts = tally(symbols, blank, [r[1][:1] for r in rows])
    lines = "\n".join(replay(audit, 0, ((r[1], r[2]) for r in rows)))
    return dict(zip(_SCHEMA.names, (conv, _gaps({r[0] for r in rows} - {None}), *counts, cost, audit, hashlib.sha256(lines.encode()).hexdigest(), len(rows)), strict=True))


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations from rows (conv_id, turn, role, text, symbol, times) sorted by conversation and turn."""
    powers, plans, out = Powers(), {}, []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    for conv, own in groupby(rows(), key=lambda r: r[0]):
        out.append(_whole(conv, [r[1:] for r in own], powers, plans))
        if len(out) == 5000:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


_SEGMENT = "conv_id long, segment int, symbols array<int>, lengths array<long>, matrix array<long>, blank long, duplicate long, truncated long, illegal long, n_rows long, first_initial string, last_initial string"
_SEGMENT_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.int32()), ("symbols", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64()))]
    + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "n_rows")]
    + [("first_initial", pa.string()), ("last_initial", pa.string())]
)


def _ordered(rows: pa.Table) -> Iterator[tuple[str, str, int, bool]]:
    """(role, text, symbol, blank) of each row of a segment, repeats after their first."""
    for r in sorted(rows.to_pylist(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], r["said"])):
        for k in range(r["times"]):
            yield r["role"], r["text"], r["symbol"] if r["is_first"] and not k else DELETED, r["symbol"] == DELETED


def _summary(rows: pa.Table) -> pa.Table:
    powers, own = Powers(), list(_ordered(rows))
    symbols, initials = [r[2] for r in own], [r[0][:1] for r in own]
    runs = runs_of(symbols)
    counts = tally(symbols, [r[3] for r in own], initials)
    values = (rows["conv_id"][0].as_py(), rows["segment"][0].as_py(), [s for s, _ in runs], [n for _, n in runs], matrix_of_runs(runs, powers).ravel().tolist(), *counts, len(own), initials[0], initials[-1])
    return pa.Table.from_pylist([dict(zip(_SEGMENT_SCHEMA.names, values, strict=True))], schema=_SEGMENT_SCHEMA)


def _costs_behind(rows: pa.Table) -> pa.Table:
    """(conv_id, segment, costs to go behind it) from the matrices of a conversation's segments."""
    end, out = END, []
    for r in sorted(rows.to_pylist(), key=lambda r: -r["segment"]):
        out.append({"conv_id": r["conv_id"], "segment": r["segment"], "behind": end.tolist()})
        end = product(np.array(r["matrix"]).reshape(STATES, STATES), end[:, None])[:, 0]
    out[0]["last"] = True
    return pa.Table.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("behind", pa.list_(pa.int64())), ("last", pa.bool_())]))


_WAYS = "conv_id long, segment int, audits array<string>, after array<int>, costs array<long>"


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a segment does and where it leads, for each state it may be entered in."""
    powers = Powers()
    for batch in batches:
        for r in batch.to_pylist():
            ways = unroll(list(zip(r["symbols"], r["lengths"], strict=True)), np.array(r["behind"]), range(STATES), powers, bool(r["last"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["conv_id"]], pa.int64()), pa.array([r["segment"]], pa.int32()), pa.array([[w[0] for w in ways]]), pa.array([[w[1] for w in ways]], pa.list_(pa.int32())), pa.array([[w[2] for w in ways]], pa.list_(pa.int64()))],
                names=["conv_id", "segment", "audits", "after", "costs"],
            )


def _entered(rows: pa.Table) -> pa.Table:
    """(conv_id, segment, the state in which it is entered)."""
    state, out = 0, []
    for r in sorted(rows.to_pylist(), key=lambda r: r["segment"]):
        out.append({"conv_id": r["conv_id"], "segment": r["segment"], "state": state})
        state = r["after"][state]
    return pa.Table.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("state", pa.int32())]))


def _lines(rows: pa.Table, way: pa.Table) -> pa.Table:
    """The repaired lines of a segment as one text."""
    w = way.to_pylist()[0]
    lines = list(replay(w["audit"], w["state"], ((r[0], r[1]) for r in _ordered(rows))))
    found = [{"conv_id": w["conv_id"], "segment": w["segment"], "lines": "\n".join(lines)}] if lines else []
    return pa.Table.from_pylist(found, schema=pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("lines", pa.string())]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's pieces (conv_id, segment, lines), which come in order."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)

    for conv, own in groupby(rows(), key=lambda r: r[0]):
        digest = hashlib.sha256()
        for k, (_, lines) in enumerate(own):
            digest.update(f"{chr(10) * (k > 0)}{lines}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])


def _long_ones(rows: DataFrame, unit: int) -> DataFrame:
    """The results of conversations that are cut into segments; rows has only those."""
    null = F.coalesce("conv_id", F.lit(0)).alias("id"), F.col("conv_id").isNull().alias("no_id")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    own = rows.where("times > 0").groupBy("conv_id", "turn", "role", "text", "symbol").agg(F.sum("times").alias("times"))
    own = materialise(own.select(*null, "*", said.alias("key"), F.sha2("text", 256).alias("said")), "rows")
    first = own.groupBy("id", "no_id", "key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = salted_join(own, first, ["id", "no_id", "key"], "turn", how="left")
    own = own.withColumn("is_first", F.col("first").isNull() | F.col("first.turn").eqNullSafe(F.col("turn"))).drop("first", "key")
    n = max(2, -(-rows.count() // unit))
    own = own.repartitionByRange(n, "no_id", "id", "turn", "role", "said").withColumn("segment", F.spark_partition_id())
    own = materialise(own, "segments")
    per = ["no_id", "id", "segment"]
    sums = materialise(own.groupBy(*per).applyInArrow(_summary, _SEGMENT).select(*null, "*"), "sums")
    behind = sums.select("no_id", "id", "conv_id", "segment", "matrix").groupBy("no_id", "id").applyInArrow(_costs_behind, "conv_id long, segment int, behind array<long>, last boolean")
    ways = sums.join(behind.select(*null, "segment", "behind", "last"), per).select("conv_id", "segment", "symbols", "lengths", "behind", "last").mapInArrow(_ways, _WAYS)
    ways = materialise(ways.select(*null, "*"), "ways")
    state = ways.select("no_id", "id", "conv_id", "segment", "after").groupBy("no_id", "id").applyInArrow(_entered, "conv_id long, segment int, state int")
    taken = ways.join(state.select(*null, "segment", "state"), per).select(*per, "conv_id", "state", F.col("audits")[F.col("state")].alias("audit"), F.when(F.col("segment") >= 0, F.col("costs")[F.col("state")]).alias("cost"))
    taken = materialise(taken, "taken")
    lines = own.groupBy(*per).cogroup(taken.groupBy(*per)).applyInArrow(_lines, "conv_id long, segment int, lines string")
    digest = lines.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_digest, "conv_id long, repaired_sha256 string")
    audits = taken.groupBy("no_id", "id").agg(F.array_sort(F.collect_list(F.struct("segment", "audit", "cost"))).alias("p"))
    audits = audits.select("no_id", "id", F.concat_ws("", F.transform("p", lambda x: x["audit"])).alias("audit"), F.col("p")[0]["cost"].alias("cost"))
    turns = own.groupBy("no_id", "id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("span"))
    turns = turns.join(own.where("turn is not null").groupBy("no_id", "id", "turn").agg(F.lit(1).alias("one")).groupBy("no_id", "id").agg(F.count("*").alias("n")), ["no_id", "id"], "left")
    edges = F.array_sort(F.collect_list(F.struct("segment", "first_initial", "last_initial")))
    sums = sums.groupBy("no_id", "id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "n_rows")], edges.alias("edges"))
    seams = F.aggregate(F.sequence(F.lit(1), F.size("edges") - 1), F.lit(0).cast("long"), lambda s, k: s + F.when(F.concat(F.col("edges")[k - 1]["last_initial"], F.col("edges")[k]["first_initial"]).isin(*LEGAL), 0).otherwise(1))
    sums = sums.withColumn("illegal", F.col("illegal") + F.when(F.size("edges") > 1, seams).otherwise(0))
    found = sums.join(audits, ["no_id", "id"]).join(turns, ["no_id", "id"]).join(digest.select(*null, "repaired_sha256"), ["no_id", "id"], "left")
    found = found.select(F.when(~F.col("no_id"), F.col("id")).alias("conv_id"), (F.col("span") - F.coalesce("n", F.lit(0))).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"), "n_rows")
    none = rows.groupBy("conv_id").agg(F.max("times").alias("times")).where("times = 0")
    return found.unionByName(none.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"), F.lit(0).cast("long").alias("n_rows")))


def repair(rows: DataFrame, unit: int = UNIT) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text, times): its faults, the cheapest edits and the digest of what they leave.

    A row counts `times` times, the same turn each; a conversation of which every
    row counts none is told as one without rows.
    """
    rows = rows.select("conv_id", "turn", "role", "text", symbol_of(F.col("role"), F.col("text")).alias("symbol"), "times")
    long_ones = materialise(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > unit).select(F.col("conv_id").alias("of")), "long")
    if long_ones.isEmpty():
        short, more = rows, None
    else:
        long_ones, same = broadcast_if_small(long_ones, 16), F.col("conv_id").eqNullSafe(F.col("of"))
        short, more = rows.join(long_ones, same, "left_anti"), _long_ones(rows.join(long_ones, same, "left_semi"), unit)
    found = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(_repair, FIELDS)
    return found.unionByName(more) if more is not None else found


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, times) with faults put in by a checksum of conversation and turn; dropped rows count no times."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    way = F.crc32(name.cast("binary")) % 20
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(way == 4, "user").otherwise(role).alias("role"),
        F.when(way == 1, "").when(way == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(way == 0, 0).when(way == 3, 2).otherwise(1).alias("times"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a short ASCII text, in DuckDB's SQL."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    byte = f"list_reduce(range(8), lambda c, k: {step}, xor(c, x)::BIGINT)"
    return f"xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ord({text}[i:i])::BIGINT), lambda c, x: {byte}, 4294967295::BIGINT), 4294967295)"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _then(state: str, cost: str, edit: str, line: str = "''") -> str:
    """A way (cost, audit, lines) with one more edit; a line goes along with a mark before it."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'l': {state}.l || {line}}}"


_USER, _ASSISTANT = "chr(1) || 'user:'", "chr(1) || 'assistant:'"
_T = "CASE WHEN r.truncated THEN 1 ELSE 0 END"
_K = f"(CASE WHEN r.gone OR left(r.role, 1) <> '{{}}' THEN 1000000000 ELSE {_T} END)"
_R = f"(CASE WHEN r.gone THEN 1000000000 ELSE 2 + {_T} END)"
_OWN = "chr(1) || r.role || ':' || r.text"
_FIRST = _least(_then("s0", "2", "I", _USER), _then("s1", "2", "I", _USER), "s2", _then("s3", "2", "I", _USER))
_SECOND = _least("s3", _then("s2", "2", "I", _ASSISTANT), *[_then(s, "4", "II", f"{_USER} || {_ASSISTANT}") for s in ("s0", "s1")])

OP12_SQL = f"""
WITH RECURSIVE named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
marked AS (SELECT *, {_crc32_sql("name")} % 20 AS way FROM named),
hurt AS (
    SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE WHEN way = 1 THEN '' WHEN way = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE way WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS k FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), k) AS n FROM hurt),
told AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
           NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS bare, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS next_initial
    FROM placed),
rows_ AS (SELECT *, blank OR again AS gone, bare AND NOT blank AND NOT again AS truncated FROM told),
paths AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': '', 'l': ''}} AS s0, {{'c': 1000000000, 'a': '', 'l': ''}} AS s1, {{'c': 1000000000, 'a': '', 'l': ''}} AS s2, {{'c': 1000000000, 'a': '', 'l': ''}} AS s3 FROM conversations
    UNION ALL
    SELECT conv_id, n, {_then("c0", "3", "D")}, {_least(_then("c1", "3", "D"), _then("c0", _K.format("s"), "K", _OWN))},
           {_least(_then("c2", "3", "D"), *[w for s in ("c0", "c1", "c3") for w in (_then(s, _K.format("u"), "K", _OWN), _then(s, _R, "R", f"{_USER} || r.text"))])},
           {_least(_then("c3", "3", "D"), _then("c2", _K.format("a"), "K", _OWN), _then("c2", _R, "R", f"{_ASSISTANT} || r.text"))}
    FROM (SELECT p.conv_id, r.n, r, s0 AS c0, s1 AS c1, {_FIRST} AS c2, {_SECOND} AS c3
          FROM paths p JOIN (SELECT conv_id, n, {{'role': role, 'text': text, 'gone': gone, 'truncated': truncated}} AS r FROM rows_) r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = p.n + 1)),
ends AS (SELECT conv_id, {_least("s0", _SECOND)} AS e FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS back FROM paths) WHERE back = 1),
sums AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
           count(*) FILTER (truncated) AS truncated, count(*) FILTER (next_initial IS NOT NULL AND left(role, 1) || next_initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
    FROM rows_ GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, e.e.c::BIGINT AS cost, e.e.a AS audit, sha256(replace(e.e.l[2:], chr(1), chr(10))) AS repaired_sha256, coalesce(n_rows, 0)::BIGINT AS n_rows
FROM ends e LEFT JOIN sums s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
"""
