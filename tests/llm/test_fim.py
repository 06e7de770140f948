"""Fill-in-middle: checkpoints against lists of units, rows against a plain version, round trips, edge cases."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from swathkit.llm import fim, queries

PATTERN = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*"}


def plain(doc_id, text, unit="line", spm=50, drawn=100):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    units = re.findall(PATTERN[unit], text)
    n = len(units)
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= drawn:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\té漢🌲"), max_size=80), st.sampled_from(["line", "char", "word"]), st.integers(1, 7), st.integers(1, 9))
def test_checkpoints_find_every_unit(text, unit, every, chunk):
    units = re.findall(PATTERN[unit], text)
    index = fim.Checkpoints(text.encode(), unit, every, chunk)
    assert index.n == len(units) and index.n_chars == len(text)
    assert len(index.units) <= len(units) // every + 2
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert index.seek(k) == (len(head.encode()), len(head))


ROWS = [
    (1, None), (2, ""), (3, "one line"), (4, "a\nb\nc\n"), (5, "\n\n\n"), (6, "holds <S> itself\nand more\n"), (7, "<\nP\n><P\nM>\n"), (8, "é漢🌲\n" * 700),
    (8, "é漢🌲\n" * 700), (9, "x" * 300_000), (None, "no id\nat all\n"), (10, "a\r\nb\x00c\n d"), (11, "".join(f"line {k} ü\n" for k in range(60_000))),
]


@pytest.mark.parametrize("unit", ["line", "word"])
def test_rows_equal_the_plain_version(spark, unit):
    docs = spark.createDataFrame([(*r, "x", 5) for r in ROWS], "doc_id long, text string, n string, output int")  # other columns share names with results
    got = fim.transform(docs, unit=unit).withColumn("restored", fim.restored()).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got))) == sorted(repr((i, *plain(i, t, unit))) for i, t in ROWS)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert sorted((repr(r["doc_id"]), r["restored"]) for r in got) == sorted((repr(i), t or "") for i, t in ROWS)


def test_shares_and_empty_table(spark):
    docs = spark.createDataFrame([(k, "a\nb\nc\nd\n") for k in range(400)], "doc_id long, text string")
    forms = [r["form"] for r in fim.transform(docs, fim_percent=50, spm_percent=0).collect()]
    assert 140 < forms.count("plain") < 260 and "spm" not in forms
    assert fim.transform(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.transform(docs, marks=("<A>", "<A>x", "<B>"))


def test_query_equals_sql(spark, data, duck, same_rows):
    got, want = queries.op11_fill_in_middle(spark, data), duck.execute(queries.ORACLE_SQL["op11_fill_in_middle"])
    assert same_rows(got.columns, [tuple(r) for r in got.collect()]) == same_rows([d[0] for d in want.description], want.fetchall())
