"""Line dedup against all pairs compared in turn, the SQL, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from swathkit.llm import linededup, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, n):
    for _ in range(n if line else 0):
        k = rng.randrange(len(line) or 1)
        line = rng.choice([line[:k] + line[k + 1 :], line[:k] + rng.choice("abé😀z") + line[k:], line[:k] + rng.choice("abé😀z") + line[k + 1 :]])
    return line


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abé😀 .") for _ in range(rng.randrange(1, rng.choice((8, 70)))))
        b = edited(rng, a, rng.randrange(edits + 3)) or "q"
        a, b = sorted((a, b), key=len)
        if len(b) - len(a) <= edits:
            rows.append((a, b, distance(a, b) <= edits))
    pairs = spark.createDataFrame(rows, "p string, q string, want boolean").withColumn("c", F.expr(linededup.middle("p", "q")))
    whole, cut = F.expr(linededup.within_edits("p", "q", edits)), F.expr(linededup.within_edits("c.x", "c.y", edits))
    for r in pairs.withColumns({"cut": cut, "whole": whole}).collect():
        x, y = r["c"]
        assert r["cut"] == r["whole"] == r["want"] and r["p"].find(x) >= 0 and len(r["q"]) - len(y) == len(r["p"]) - len(x)
        assert not x or x[0] != y[0] and x[-1] != y[-1]


def brute_lost(rows):
    """(doc_id, pos) -> whether it goes as a near copy, for each line that goes; and the lines of each document."""
    lines = sorted((d, k, line.strip(" ")) for d, t in rows if d is not None and t is not None for k, line in enumerate(t.split("\n")))
    first = {}
    for d, k, line in lines:
        if len(line) >= linededup.MIN_CHARS:
            first.setdefault(line, (d, k))
    known = sorted(first, key=lambda x: (first[x], x.encode()))
    near = lambda a, b: abs(len(a) - len(b)) <= (e := 1 if min(len(a), len(b)) < linededup.LONG else 2) and distance(a, b) <= e
    late = {b for k, b in enumerate(known) if any(near(a, b) for a in known[:k])}
    lost = {(d, k): first[x] == (d, k) for d, k, x in lines if x in first and (first[x] != (d, k) or x in late)}
    return lost, {d: sum(x[0] == d for x in lines) for d, _ in rows if d is not None}


def brute_report(rows):
    lost, n = brute_lost(rows)
    near = {d: sum(v for (e, _), v in lost.items() if e == d) for d in n}
    gone = {d: sum(e == d for e, _ in lost) for d in n}
    return {d: (n[d], n[d] - gone[d], gone[d] - near[d], near[d]) for d in n}


def made_up(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdef gh") for _ in range(rng.choice([9, 10, 12, 38, 39, 40, 41, 55, 90]))).strip() + "x" for _ in range(25)]
    rows = []
    for d in range(40):
        own = [edited(rng, x, rng.randrange(4)) if rng.random() < 0.5 else x for x in rng.sample(base, 5)]
        rows.append((d, "\n".join(own + own[:1] * rng.randrange(2))))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (None, rows[0][1]), (103, rows[0][1]), (104, "q" * 900), (105, "q" * 899)]


@pytest.mark.parametrize("seed", [8, 9])
def test_equals_brute_force(spark, seed):
    rows = made_up(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in linededup.line_report(df).collect()} == brute_report(rows)
    assert {(r["doc_id"], r["pos"]): r["near"] for r in linededup.dropped_lines(df).collect()} == brute_lost(rows)[0]


def test_large_groups_of_near_copies(spark):
    """Which lines go equals brute force in keys beyond HEAVY: copies near the first, near each other only, and not near."""
    rng = random.Random(5)
    head = "all of these lines begin with the same words, "
    tail = ["".join(rng.choice("abcdefgh ") for _ in range(80)) for _ in range(3)]
    lines = [head + t[:k] + rng.choice("xyz") + t[k + 1 :] for t in tail for k in rng.sample(range(80), 30)]  # two edits apart at most
    lines += [head + t[:k] + "QRS" + t[k + 3 :] for t in tail for k in rng.sample(range(70), 20)]  # farther
    lines += [head + "".join(rng.choice("abcdefgh ") for _ in range(80)) for _ in range(40)] + ["Item %d of the list" % k for k in range(10, 60)]
    lines = [x.strip() for x in lines]
    rng.shuffle(lines)
    rows = [(k // 3, "\n".join(lines[k : k + 3])) for k in range(0, len(lines), 3)]
    got = linededup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["pos"]): r["near"] for r in got} == brute_lost(rows)[0] and len(got) > 80


def test_ties_and_repeated_ids(spark):
    """Of two near lines with equal heads of one document the first place decides; rows of one id keep their own lines."""
    head = "x" * 70
    rows = [(1, f"{head} b 1\n{head} a 1"), (2, "one line that stays here\nanother one for both rows"), (2, "another text of the same id\none line that stays here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["pos"], r["near"]) for r in linededup.dropped_lines(df).collect())
    assert got == [(1, 1, True), (2, 1, False)]
    assert sorted(r["text"] for r in linededup.drop_repeated_lines(df).collect()) == sorted([f"{head} b 1", rows[1][1], "another text of the same id"])


def test_equals_sql(spark, data, duck, same_rows):
    got = queries.op4_line_dedup(spark, data)
    want = duck.execute(queries.ORACLE_SQL["op4_line_dedup"])
    assert same_rows(got.columns, [tuple(r) for r in got.collect()]) == same_rows([d[0] for d in want.description], want.fetchall())


def test_lines_are_dropped(spark):
    a, b = "a line that many documents repeat, word for word", "this line is in one document only, and stays there"
    rows = [(1, f"{a}\n{b}", "p"), (2, f"{a}\nshort\n{a}.", "p"), (3, f" {a} ", "p"), (4, None, None), (5, "", "x"), (None, a, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos string")
    got = {r["doc_id"]: r["text"] for r in linededup.drop_repeated_lines(df).collect()}
    assert got == {1: f"{a}\n{b}", 2: "short", 4: None, 5: "", None: a}
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0 and linededup.line_report(df.limit(0)).count() == 0


def test_main_path_is_native(spark, data):
    plan = queries.op4_line_dedup(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
