import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import numeric, ordered, text


def column(frame, values, expression):
    df = frame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()
    return [row.r for row in rows]


def plain_clean(value):
    """What cleaning has to give, spelled out on one Python string."""
    import re

    rows = [re.sub("[ \t]+", " ", r).strip() for r in re.split("\r\n|\r|\n", value or "")]
    return re.sub("\n\n\n+", "\n\n", "\n".join(rows)).strip()


CELLS = [
    None, "", "  ", "a", " a\t\tb ", "a\r\nb\rc\nd", "x\n\n\n\n\ny", "\n\nq\n", "NA", "null",
    "  l1  \n\t l2 \n   \n\n\n l3", " nb ", " wide　\n\x1c", "é\u0085ü", "a\x0bb\x0c",
    "tail  \nnext", "﻿bom",
]


def test_clean_text_matches_plain_rule(frame):
    assert column(frame, CELLS, text.clean_text) == [plain_clean(c) for c in CELLS]


def test_lines_and_strip(frame):
    values = [None, "", " a \r\n\r\n b\x0bc \n", "x y\x85 z "]
    assert column(frame, values, text.lines) == [[], [], ["a", "b", "c"], ["x", "y", "z"]]
    assert column(frame, ["　 a \n"], text.strip) == ["a"]


def test_safe_text(frame):
    got = column(frame, [None, "  ", "abc", "abcdefgh ij", "abcdefg  ijkl"],
                 lambda c: text.safe_text(c, "none", 10))
    assert got == ["none", "none", "abc", "abcdefg...", "abcdefg..."]


NUMBERS = ["", None, "abc", "-1", "0", "nan", " 12.5 ", "1e3", "1_000", "inf", "-inf", "12d", "3.",
           ".5", "0x10", "1__0", "7.9", "1e400"]


def python_positive(value):
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return number if number > 0 else None


def test_positive_numbers(frame):
    assert column(frame, NUMBERS, numeric.positive) == [python_positive(n) for n in NUMBERS]
    whole = column(frame, ["7.9", "-3", "x", None, "1e3"], numeric.positive_whole_or_zero)
    assert whole == [7, 0, 0, 0, 1000]


def test_ratio_is_guarded(frame):
    df = frame([(1.0, 0.0), (1.0, None), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(numeric.ratio(F.col("a"), F.col("b"))).collect()] == [
        None, None, 0.25]


def hot_rows(seed=7, total=900):
    """Rows in which one key holds most of the rows and null is a key as well."""
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(rng.choice(keys), i // 40, i, rng.randint(0, 9)) for i in range(total)]


SCHEMA = "k string, block int, pos int, v int"


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: r[2]):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sums(frame, inclusive):
    rows = hot_rows()
    got = ordered.running_sums(frame(rows, SCHEMA), ["k"], "block", [F.col("pos")],
                               {"s": F.col("v")}, inclusive)
    want = {}
    for group in by_key(rows).values():
        total = 0
        for row in group:
            want[row[2]] = total + (row[3] if inclusive else 0)
            total += row[3]
    assert {r.pos: r.s for r in got.collect()} == want


def test_row_index_without_keys(frame):
    rows = hot_rows()
    got = ordered.row_index(frame(rows, SCHEMA), [], "block", [F.col("pos")], "n").collect()
    assert {r.pos: r.n for r in got} == {i: i + 1 for i in range(len(rows))}


@pytest.mark.parametrize("block_rows", [12, 100, 100_000])
def test_trailing_frame(frame, block_rows):
    rows = hot_rows()
    got = ordered.trailing_frame(
        frame(rows, SCHEMA), ["k"], "block", [F.col("pos")], 10,
        {"first": lambda w: F.first_value("v").over(w), "n": lambda w: F.count("*").over(w)},
        block_rows,
    ).collect()
    assert len(got) == len(rows)
    want = {}
    for group in by_key(rows).values():
        for i, row in enumerate(group):
            start = max(0, i - 9)
            want[row[2]] = (group[start][3], i - start + 1)
    assert {r.pos: (r["first"], r.n) for r in got} == want


@pytest.mark.parametrize("how", ["left", "inner"])
def test_sliced_join_equals_plain_join(frame, how):
    facts = frame(hot_rows(), SCHEMA)
    lookup = frame([("hot", 1), ("a", 2), ("z", 3)], "k string, w int")
    got = ordered.sliced_join(facts, lookup, ["k"], F.xxhash64("pos"), how, slice_rows=50)
    want = facts.join(lookup, "k", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_first_rows_drops_before_the_shuffle(frame):
    df = ordered.first_rows(frame(hot_rows(), SCHEMA), ["k"], [F.col("pos")], 2, "n")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert {r.k: None for r in df.collect()}.keys() == {"hot", "a", "b", None}


def test_null_safe_join(frame):
    left = frame([(None, 1), ("a", 2)], "k string, v int")
    right = frame([(None, 5), ("b", 6)], "k string, w int")
    got = ordered.null_safe_join(left, right, ["k"]).collect()
    assert {(r.k, r.v, r.w) for r in got} == {(None, 1, 5), ("a", 2, None)}
