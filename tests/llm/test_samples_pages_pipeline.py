"""Samples of labelled rows, texts without letters, damaged pages, and whole rows in the pipeline."""

from __future__ import annotations

import collections
import re
import sys
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import html_text, language, quality, queries, toxicity
from faultline.llm.common import bounded_choice

FOLDER = "/root/testdata/sf0.001"


def test_labels_of_other_documents_change_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    other = spark.range(1_000_000, 1_200_000).select(
        F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")
    )
    one = queries.quality_model(docs, labels)
    both = queries.quality_model(docs, labels.select("doc_id", "quality", "toxic").unionByName(other, True))
    assert one.rules and one == both


def test_equal_labels_count_once_and_clashing_columns_stay(spark):
    docs = spark.createDataFrame(
        [(i, "word " * (1 + i % 40), "own") for i in range(200)], "doc_id long, text string, __stats string"
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    learn = F.col("doc_id") >= 0
    one, twice = (quality.train(docs, x, learn) for x in (labels, labels.union(labels)))
    assert one == twice
    scored = quality.with_score(docs, one)
    assert scored.columns == ["doc_id", "text", "__stats", "score"]
    assert {r["__stats"] for r in scored.collect()} == {"own"}


def test_statistics_equal_plain_python(spark):
    texts = ["", "One two, two! 12 ## AB.\n\nOne two, two! 12 ## AB.\nlast line", "é É ß Straße 的中文 … ; :", " \t\n "]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    made = quality.statistics(F.col("text"))
    rows = frame.select("text", *[c.cast("double").alias(n) for n, c in made.items()]).collect()
    for r in rows:
        t = r["text"]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if x.strip(" ")]
        solid = sum(map(len, words))

        def share(a, b):
            return a / b if b else 0.0

        def of(chars):
            return share(sum(c in chars for c in t), solid)

        want = {
            "log_words": np.log1p(len(words)), "word_length": share(solid, len(words)),
            "upper_share": share(sum(unicodedata.category(c) == "Lu" for c in t), solid),
            "symbol_share": of("#*$%&|<>{}=_~^"), "shout_share": of("!"), "digit_share": of("0123456789"),
            "stop_share": of(".,;:?"), "distinct_words": share(len(set(words)), len(words)),
            "distinct_lines": share(len(set(lines)), len(lines)), "words_a_line": share(len(words), len(lines)),
        }
        assert {n: r[n] for n in want} == pytest.approx(want)


def test_compiled_rules_equal_plain_python(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, len(quality.NAMES)))
    y = ((x[:, 1] > 0.4) & (x[:, 5] < 0.7)).astype(int)
    model = quality.fit_rules(x, y)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in quality.NAMES))
    got = [r[0] for r in frame.select(model.score({n: F.col(n) for n in quality.NAMES})).collect()]
    for row, score in zip(x, got):
        values = dict(zip(quality.NAMES, row))
        total = model.intercept + sum(
            r.weight for r in model.rules if all((values[n] > c) if above else (values[n] <= c) for n, above, c in r.tests)
        )
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_choice_is_bounded_exact_and_even(spark):
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("c"))
    rows = rows.unionByName(spark.range(30).select(F.col("id").alias("doc_id"), F.lit("b").alias("c")))
    rows = rows.unionByName(rows)
    chosen = bounded_choice(rows, 100, "c").collect()
    assert collections.Counter(r["c"] for r in chosen) == {"a": 100, "b": 30}
    hashed = rows.where("c = 'a'").distinct().select(
        "doc_id", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1)).alias("h")
    ).orderBy("h").limit(100)
    assert {r["doc_id"] for r in chosen if r["c"] == "a"} == {r["doc_id"] for r in hashed.collect()}
    assert bounded_choice(rows.select("doc_id"), 10).count() == 10
    assert bounded_choice(rows.where("false"), 10, "c").count() == 0


def test_no_letter_no_language():
    others = [
        chr(i) for i in range(sys.maxunicode + 1)
        if not 0xD800 <= i < 0xE000 and not chr(i).isalpha() and not chr(i).lower()[:1].isalpha()
    ]
    model = language.LanguageModel(["de", "en"])
    texts = [" ".join(others[i : i + 5000]) for i in range(0, len(others), 5000)] + ["½ ①", "Ⅷ ²", "12 + 3"]
    found, scores = model.predict(texts)
    assert set(found) == {language.UNKNOWN} and not scores.any()
    assert language.letter_runs("a½b Ⅷx") == ["a", "b", "x"]


def test_remembered_sums_equal_reading_each_text_afresh():
    texts = ["The cat and the hat", "Der Hut ½ und das", "the the", "x" * 60, ""]
    model = language.LanguageModel(["de", "en", "fr"], seed=5)
    model.predict(["cat und fresh"])
    found, scores = model.predict(texts)
    for text, name, score in zip(texts, found, scores):
        total, n = np.zeros(3), 0
        for run in language.letter_runs(text):
            raw = np.frombuffer(b" " + run.encode() + b" ", np.uint8)[None]
            labelled = model._label(raw)[1:-1]
            total, n = total + labelled.sum(0)[0], n + len(labelled)
        if n:
            assert name == model.languages[int(total.argmax())] and score == pytest.approx(total.max() / n, rel=1e-4)
        else:
            assert name == language.UNKNOWN


PARTS = [f"Paragraph {i} of the story, long enough, with commas, to count." for i in range(4)]


@pytest.mark.parametrize("before, text", [
    ("<p title=don't>", "It doesn't end, here, as one might think, but goes on."),
    ("<p title=\"a > b\" data-id='comments'>", "A value may hold, as here, the end mark of a tag."),
    ("<p title=it's class=x data-class=\"sidebar\">", "Names of other attributes, like this one, say nothing."),
])
def test_quotes_in_values(before, text):
    page = "<article>" + "".join(f"<p>{p}</p>" for p in PARTS[:2]) + f"{before}{text}</p>" + \
        "".join(f"<p>{p}</p>" for p in PARTS[2:]) + "</article><p>that's it</p>"
    assert html_text.main_text(page).startswith(" ".join([*PARTS[:2], text, *PARTS[2:]]))


@pytest.mark.parametrize("open_tag", ['<a href="x>', "<a href='x>", '<a href="x', "<b class="])
def test_open_quotes_stay_out_of_the_text(open_tag):
    page = "<article>" + "".join(f"<p>{p}</p>" for p in PARTS) + f"{open_tag}"
    assert html_text.main_text(page) == " ".join(PARTS)


@pytest.mark.parametrize("comments", [
    '<ol class="commentlist">{}</ol>', '<section class="discussion">{}</section>', '<div class="comment-list">{}</div>',
    '<div id="replies-thread">{}</div>', '<ul class="reply-list">{}</ul>', '<div class="commentArea">{}</div>',
])
def test_comment_areas_by_compound_names(comments):
    said = "".join(f"<li>I, reader {i}, say, at some length, that I do not agree with it.</li>" for i in range(3))
    page = f"<body><div><div class=story>{''.join(f'<p>{p}</p>' for p in PARTS)}</div>{comments.format(said)}</div></body>"
    assert html_text.main_text(page) == " ".join(PARTS)


def test_a_paper_keeps_its_discussion():
    parts = "".join(f"<p>{p}</p>" for p in PARTS)
    page = f"<article><h1>Title of it</h1>{parts}<section id=discussion><h2>Discussion</h2><p>We discuss, at length, what we found here.</p></section></article>"
    assert html_text.main_text(page).endswith("Discussion We discuss, at length, what we found here.")


def test_stray_end_tags_take_linear_time():
    import time

    def took(n):
        page = "<div>" * n + "".join(f"<p>{p}</p>" for p in PARTS) + "</span>" * n
        start = time.process_time()
        html_text.parse(page)
        return time.process_time() - start

    assert took(40_000) < 12 * max(took(10_000), 0.02)


def test_largest_logits_equal_a_loop_over_windows():
    model = toxicity.ToxicityModel()
    texts = [" ".join(f"w{i * j % 17}" for i in range(n)) for j, n in enumerate((1, 5, 30, 200))] + [""]
    best, _ = model.largest_logits(texts)
    assert np.isnan(best[-1])
    for text, value in zip(texts[:-1], best):
        alone, _ = model.largest_logits([text])
        assert value == pytest.approx(alone[0], rel=1e-4, abs=1e-4)


# -- pipeline ----------------------------------------------------------------------------------


def water(sizes: dict, weights: dict, cap: float = 3.0) -> dict:
    """Targets by plain rounds: fix what is over its cap, share the rest by weight."""
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = {s: w for s, w in weights.items() if s not in fixed}
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_pipeline_keeps_whole_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == [*docs.columns, "size", "text_crc32", "shard", "slot"]
    rows = found.collect()
    whole = {r["doc_id"]: r for r in docs.collect()}
    assert rows and all(tuple(r[c] for c in docs.columns) == tuple(whole[r["doc_id"]]) for r in rows)

    # shards: copies together, sizes as near as the largest group allows, slots without gaps
    homes, size, slots = {}, collections.Counter(), collections.defaultdict(list)
    groups = collections.Counter()
    for r in rows:
        n = len((r["text"] or "").encode()) + 1
        assert homes.setdefault(r["text"], r["shard"]) == r["shard"]
        size[r["shard"]] += n
        groups[r["text"]] += n
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.get(s, 0) for s in range(16)) <= max(groups.values())

    # the mix of the rows that came to it, by plain rounds
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, FOLDER)
    came = kept.select("doc_id", "text", "source").collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in came}
    sizes = collections.Counter()
    for r in came:
        sizes[r["source"]] += words[r["doc_id"]]
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = water(sizes, {s: 1 + i % 3 for i, s in enumerate(ranked)})
    taken = collections.Counter()
    for r in rows:
        taken[r["source"]] += words[r["doc_id"]]
    longest = max(words.values())
    for s in ranked:
        assert abs(taken[s] - targets[s]) <= longest
    assert max(collections.Counter(r["doc_id"] for r in rows).values()) <= 3


def test_stages_with_hard_rows(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"word{i % 50} is here." for i in range(200))
    rows = [(1, text, "en", None, 5, "own", 1), (1, text, "en", None, 5, "own", 1), (None, text + " more", None, "a", None, "x", 2),
            (None, None, None, None, None, None, None), (3, "", "en", "a", 0, "x", 3), (4, "w" * 50_000, "en", "b", 1, "y", 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, print string, __score int"
    docs = spark.createDataFrame(rows, schema)
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    for made in (docs, docs.where("false")):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            folder = f"{tmp_path}/{name.replace(' ', '-')}-{made.count()}-{i}"
            made.write.parquet(folder)
            out = stage(spark, spark.read.parquet(folder), str(tmp_path))
            last = i == len(corpus_pipeline.STAGES) - 1
            assert out.columns == docs.columns + (["size", "text_crc32", "shard", "slot"] if last else []), name
            assert out.count() <= 3 * made.count()


