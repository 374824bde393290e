"""Repair of conversations against brute force and SQL."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from tessera.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, symbol int, said string, id long, times string, audit int"
WS = "\t\n\x0b\f\r "


def faults(rows):
    """Rows (role, text) in order, each with its first fault."""
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(WS)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, digest) by trying every edit with up to two insertions in each gap."""
    own, best = faults(rows), None
    puts = [p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    ways = []
    for (role, text), fault in zip(rows, own, strict=True):
        more = fault == "truncated"
        way = [("D", 3, None)]
        if fault in ("", "truncated"):
            way += [("K", more, (role, text)), ("R", 2 + more, ("user", text)), ("R", 2 + more, ("assistant", text))]
        ways.append(way)
    for gaps in itertools.product(puts, repeat=len(rows) + 1):
        for row in itertools.product(*ways):
            out, audit, cost = [], "", 0
            for k, gap in enumerate(gaps):
                out += [(r, "") for r in gap]
                audit, cost = audit + "I" * len(gap), cost + 2 * len(gap)
                if k < len(row):
                    audit, cost = audit + row[k][0], cost + row[k][1]
                    out += [row[k][2]] if row[k][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    return best


def test_against_every_edit():
    rng, powers = random.Random(3), cr.Powers()
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool", " ", ""]), rng.choice(["a.", "b", " ", "c?\n", "d"])) for _ in range(rng.randrange(4))]
        marks = [(k, r, t, symbol(r, t), 1) for k, (r, t) in enumerate(rows)]
        got = cr._whole(1, marks, powers, {})
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == cheapest(rows), rows
        assert [got[f] for f in ("blank", "duplicate", "truncated")] == [faults(rows).count(f) for f in ("blank", "duplicate", "truncated")]


def symbol(role, text):
    shown = text.rstrip(WS)
    return cr.DELETED if not shown else 2 * (cr.CLASSES.index(role[:1]) if role[:1] in cr.CLASSES else 3) + (shown[-1] not in ".!?")


def test_runs_equal_single_steps():
    """A run's powers, and costs by doubling, against one row at a time."""
    powers = cr.Powers()
    for sym in range(cr.DELETED + 1):
        one, whole, end = cr.matrix_of(sym), cr.matrix_of(sym), cr.END
        costs = [end]
        for n in range(1, 40):
            assert (powers.over(sym, n) == whole).all()
            costs.append(cr.product(one, costs[-1][:, None])[:, 0])
            assert (powers.to_go(sym, n, end) == np.array(costs)).all()
            whole = cr.product(whole, one)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool"]), rng.choice(["yes.", "no", "why?\n", "", "so\x0b", "it is. \r", f"text {t}."])) for c in range(25) for t in range(rng.randrange(1, 12)) if rng.random() < 0.9]
    out += [(90, t, "user" if t % 2 == 0 else "assistant", f"row {t % 70}.") for t in range(300)]
    out += [(91, 5, "user", "same.")] * 40 + [(91, 5, "assistant", "same."), (91, None, "system", "first."), (91, None, None, None)]
    out += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (92, None, "user", None), (93, 2, None, "x."), (94, 1 << 40, "", "é."), (95, 3, "assistant", "y" * 70000)]
    return out


def given(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], SCHEMA)


def plain(conv, rows):
    marks = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return cr._whole(conv, [(t, r, x, symbol(r, x), n) for t, r, x, n in marks], cr.Powers(), {})


@pytest.mark.parametrize("unit", [1, 3, 50, cr.UNIT])
def test_cut_conversations(spark, rows, unit):
    """Conversations cut into segments give what whole ones give, and SQL agrees."""
    hurt = cr.damaged(given(spark, rows))
    got = {r["conv_id"]: r.asDict() for r in cr.repair(hurt, unit).collect()}
    per: dict = {}
    for r in hurt.collect():
        per.setdefault(r["conv_id"], []).append(tuple(r)[1:])
    assert got == {c: plain(c, own) for c, own in per.items()}
    if unit == cr.UNIT:
        db = duckdb.connect()
        held = given(spark, rows).select("conv_id", "turn", "role", "text").toArrow()  # noqa: F841
        db.execute("create view conversations as select * from held")
        names = list(next(iter(got.values())))
        want = db.sql(f"select {', '.join(names)} from ({cr.OP12_SQL})").fetchall()
        assert sorted(want, key=repr) == sorted((tuple(r.values()) for r in got.values()), key=repr)


def test_no_rows(spark):
    assert cr.repair(cr.damaged(given(spark, []))).count() == 0
    gone = next(t for t in range(200) if __import__("zlib").crc32(f"7:{t}".encode()) % 20 == 0)
    got = cr.repair(cr.damaged(given(spark, [(7, gone, "user", "x.")]))).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), 0)]
    many = given(spark, [(7, gone, "user", f"x{k}.") for k in range(5)])
    assert [tuple(r) for r in cr.repair(cr.damaged(many), 2).collect()] == [tuple(r) for r in got]
