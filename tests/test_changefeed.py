import random

import pytest

from tidemark.operators.changefeed import apply_changes

SCHEMA = "rec long, side int, position int, ts long, seq long, op int, price double, size int, note string"


def rebuilt(rows):
    """State by replaying the feed one change at a time."""
    once = {}
    for r in rows:
        if r[5] in (0, 1, 2) and r[4] is not None:
            key = r[:4] + r[5:]
            once[key] = min(once.get(key, r[4]), r[4])
    state = {}
    low = -(10**18)
    for key, seq in sorted(once.items(), key=lambda kv: (low if kv[0][3] is None else kv[0][3], kv[1])):
        slot, op, price, size = key[:3], key[4], key[5], key[6]
        if op == 2:
            state.pop(slot, None)
        elif op == 0 or slot not in state:
            state[slot] = [price, size, seq]
        else:
            old = state[slot]
            state[slot] = [old[0] if price is None else price, old[1] if size is None else size, seq]
    return sorted((str(k), *v) for k, v in state.items())


def run(spark, rows):
    out = apply_changes(spark.createDataFrame(rows, SCHEMA), ["rec", "side", "position"], ["ts"], "seq", "op", ["price", "size"])
    assert out.columns == ["rec", "side", "position", "price", "size", "seq"]
    return sorted((str((r.rec, r.side, r.position)), r.price, r.size, r.seq) for r in out.collect())


def test_random_feeds_with_repeats_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = []
    for seq in range(1500):
        rows.append((rng.choice([1, 2, None]), rng.choice([0, 1, None]), rng.randrange(3), rng.choice([None, *range(60)]), seq, rng.choice([0, 1, 1, 2, 2, None, 7]), rng.choice([None, 1.0, 2.5]), rng.choice([None, 3, 4]), "x"))
        if rng.random() < 0.3:
            old = rng.choice(rows)
            rows.append((*old[:4], 5000 + seq, *old[5:]))
    assert run(spark, rows) == rebuilt(rows)


def test_repeat_after_a_delete_does_not_bring_the_level_back(spark):
    rows = [(1, 1, 0, 10, 5, 1, 9.0, 1, "a"), (1, 1, 0, 10, 7, 2, 0.0, 0, "a"), (1, 1, 0, 10, 9, 1, 9.0, 1, "a")]
    assert run(spark, rows) == []


def test_insert_replaces_and_update_keeps(spark):
    rows = [(1, 1, 0, 1, 1, 0, 5.0, 7, None), (1, 1, 0, 2, 2, 1, None, 8, None), (1, 1, 1, 1, 3, 0, 5.0, 7, None), (1, 1, 1, 2, 4, 0, None, 8, None)]
    assert run(spark, rows) == [("(1, 1, 0)", 5.0, 8, 2), ("(1, 1, 1)", None, 8, 4)]


def test_empty_feed(spark):
    assert run(spark, []) == []


def test_one_hot_slot(spark):
    rows = [(1, 1, 0, t, t, 1, float(t), t, None) for t in range(3000)]
    assert run(spark, rows) == [("(1, 1, 0)", 2999.0, 2999, 2999)]


@pytest.mark.parametrize("name", ["a b", "select", "x`y"])
def test_awkward_column_names(spark, name):
    df = spark.createDataFrame([(1, 1, 1, 0, 2.0)], ["k", "t", "seq", "op", "v"]).withColumnRenamed("v", name)
    assert apply_changes(df, ["k"], ["t"], "seq", "op", [name]).collect()[0][name] == 2.0
