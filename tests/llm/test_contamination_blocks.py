"""Benchmark blocks: bounded by windows and bytes, long items in pieces, equal results."""

import random
import sys
import time

import numpy as np
import pytest

from faultline.llm import contamination
from tests.llm.test_llm import brute_hits


@pytest.mark.parametrize("limits", [{}, {"block_windows": 40}, {"block_bytes": 300}])
def test_blocks_give_one_result(spark, limits):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(400)]
    items = [(i, ", ".join(rng.choices(pool, k=n))) for i, n in enumerate([500, 60, 13, 12, 3, 1, 0, 90])]
    items += [(8, items[1][1]), (9, None), (10, "!?"), (11, items[7][1] + " ")]
    texts = []
    for _ in range(60):
        whole = items[rng.choice([0, 1, 2, 3, 4, 7])][1].split(", ")
        at = rng.randrange(max(1, len(whole) - 20))
        texts.append(" ".join(rng.choices(pool, k=9) + whole[at : at + rng.randint(1, 40)] + rng.choices(pool, k=5)))
    docs = spark.createDataFrame([(t, "own") for t in [*texts, None, ""]], "text string, spans string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination.find_contamination(docs, benchmark, with_text=True, **limits)
    assert found.columns == ["text", "n_words", "spans", "items", "clean_text"]
    rows = found.select("*", contamination.hit_words().alias("n")).collect()
    assert len(rows) == 62
    for r in rows:
        assert (r["n_words"], r["n"], r["items"]) == brute_hits(r["text"], items)
        assert len(contamination.words_of(r["clean_text"])) == r["n_words"] - r["n"]


def test_pieces_hold_every_window(spark):
    words = [f"w{i}" for i in range(1000)]
    benchmark = spark.createDataFrame([(1, " ".join(words)), (2, "a b"), (3, "x" * 5000 + " y"), (4, None)], "item_id int, text string")
    rows = contamination.item_pieces(benchmark, 13, 200).collect()
    pieces = [contamination.words_of(r["text"]) for r in rows if r["item"] == "1"]
    windows = {tuple(p[i : i + 13]) for p in pieces for i in range(len(p) - 12)}
    assert windows == {tuple(words[i : i + 13]) for i in range(988)} and all(len(p) >= 13 for p in pieces)
    assert sum(len(p) - 12 for p in pieces) == 988
    assert [r["text"] for r in rows if r["item"] == "2"] == ["a b"]


def test_a_full_block_is_small_and_quick():
    rng = np.random.default_rng(1)
    text = " ".join(f"{x:06x}" for x in rng.integers(0, 1 << 24, 1_000_012))
    began = time.process_time()
    windows = contamination.WindowSet([("a", text)])
    assert time.process_time() - began < 10
    keys, sieve, at = windows.sizes[13]
    arrays = (windows.raw, windows.starts, windows.ends, windows.home, keys, sieve, at)
    assert len(keys) == 1_000_000 and sum(a.nbytes for a in arrays) + sys.getsizeof(text) < 200e6
