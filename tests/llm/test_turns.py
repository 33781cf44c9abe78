"""Reassembled conversations against a plain replay, and odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest

from foliant.llm import queries, turns

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def replay(rows):
    """The contract, one arrival at a time."""
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows if c is not None and t is not None]
    first, batches = {}, defaultdict(lambda: defaultdict(list))
    for c, t, _, _ in rows:
        first[c] = min(t, first.get(c, t))
    for c, t, r, x in rows:
        h = int(sha(f"{c}:{t}")[:8], 16)
        batches[h % 12][c, t].append((f"{r}|{x}".encode(), r))
        if h % 7 < 2:
            batches[(h + 3) % 12][c, t].append((f"user|{x}".encode(), "user"))
    kept, next_, seen, closed, out = defaultdict(dict), {}, {}, set(), []

    def close(c, batch):
        mine = kept[c]
        waiting = sorted(t for t in mine if t >= next_[c])
        missing = max(mine) - first[c] + 1 - len(mine)
        breaks = sum(t - 1 in mine and mine[t - 1][1] == r for t, (_, r) in mine.items())
        out.append(("close", c, -1, batch, sha(",".join(map(str, waiting))), missing, breaks))
        closed.add(c)

    for b in range(12):
        for (c, t), payloads in sorted(batches[b].items()):
            payload, role = min(payloads)
            if c in closed:
                out.append(("reject", c, t, b, hashlib.sha256(payload).hexdigest(), None, None))
                continue
            next_.setdefault(c, first[c])
            seen[c] = b
            kept[c].setdefault(t, (payload, role))
        for c in next_:
            if c in closed:
                continue
            while next_[c] in kept[c]:
                out.append(("release", c, next_[c], b, hashlib.sha256(kept[c][next_[c]][0]).hexdigest(), None, None))
                next_[c] += 1
            if seen[c] <= b - 3:
                close(c, b)
    for c in next_:
        if c not in closed:
            close(c, 12)
    return Counter(out)


def events(df):
    return Counter(tuple(r) for r in turns.digest(df).select("event", "conv_id", "turn", "batch", "sha256", "n_missing", "n_breaks").collect())


def test_whole_table_equals_a_replay(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = Counter(tuple(r) for r in queries.op13_turns(spark, SF).select("event", "conv_id", "turn", "batch", "sha256", "n_missing", "n_breaks").collect())
    assert got == replay(rows) and {"release", "reject", "close"} <= {k[0] for k in got}


def test_odd_rows_equal_a_replay(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, -7, 2**40, None]), rng.choice([None, -3, 0, 1, 2, 3, 4, 9, 10**12]), rng.choice([None, "", "user", "a|b", "assistant"]), rng.choice([None, "", "x", "b|c", "ü|", "long " * 50_000])) for _ in range(60)]
    rows += [(100 + i, t, "user", "same") for i in range(40) for t in rng.sample(range(12), rng.randrange(1, 12))] + [(500, 0, "user", "same")] * 300
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, event string, bucket int")
    assert events(df) == replay(rows)


def test_empty_table(spark):
    assert turns.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_bucket_gives_the_same_however_it_is_stored():
    """Each batch through a dumped and loaded state, and in one object."""
    rng = random.Random(5)
    whole, stored, n = turns.Bucket(), turns.Bucket().dump(), 0
    for batch in range(13):
        rows = [(rng.randrange(20), rng.randrange(8), 0, rng.choice(["user", "assistant"]), str(rng.random())) for _ in range(30 if batch < 12 else 0)]
        rows = pd.DataFrame(rows, columns=["conv_id", "turn", "first", "role", "text"]).astype({"conv_id": "int64", "turn": "int64", "first": "int64"})
        bucket = turns.Bucket.load(stored)
        a, b = whole.advance(batch, rows, 12), bucket.advance(batch, rows, 12)
        stored = bucket.dump()
        n += len(a)
        assert a.drop(columns="waiting").equals(b.drop(columns="waiting"))
        assert [None if x is None else list(x) for x in a["waiting"]] == [None if x is None else list(x) for x in b["waiting"]]
    assert n and not len(whole.conv) and len(whole.closed) == 20


@pytest.mark.parametrize("batches", [1, 5])
def test_other_numbers_of_batches(spark, batches):
    df = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    got = turns.turn_events(df, batches).collect()
    assert [(r.turn, r.text) for r in sorted(got, key=lambda r: r.turn) if r.event == "release"] == [(1, "a"), (2, "b")]
