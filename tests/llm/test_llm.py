"""The training-data operators against brute force, SQL and hard cases."""

import collections
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from faultline.llm import (
    bktree,
    components,
    contamination,
    html_text,
    language,
    lines,
    mixing,
    quality,
    queries,
    sharding,
    simhash,
    tokens,
    toxicity,
)

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} other{i}" for i in range(40_000))
EDGE = [
    (1, "A plain text. It has lines.\nAnd more words in the second one.", "en", "a"),
    (1, "A plain text. It has lines.\nAnd more words in the second one.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \t\n ", None, "b"),
    (None, "no id here but some words all the same, are there?", "fr", None),
    (5, "A plain text. It has lines.\nAnd more words in the second one.", "de", "b"),
    (6, LONG, "en", "a"),
    (7, "12 34 !! ▁x ﬁ 𝔘 \x00 é", "es", "é"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def edge(spark):
    """Hard rows, with extra columns whose names clash with what the operators make."""
    made = ["n_words", "score", "size", "shard", "Print", "spans", "target", "times", "key", "of", "n_tokens"]
    docs = spark.createDataFrame(EDGE, SCHEMA)
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in made])


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# quality


def test_rules_find_a_conjunction_and_ignore_noise():
    rng = np.random.default_rng(1)
    x = rng.random((1500, len(quality.NAMES)))
    y = ((x[:, 1] > 0.5) & (x[:, 3] <= 0.6)).astype(int)
    model = quality.fit_rules(x, y)
    used = {name for rule in model.rules for name, _, _ in rule.tests}
    assert {quality.NAMES[1], quality.NAMES[3]} <= used
    assert len(model.rules) < 60


def test_quality_of_hard_rows(spark, edge):
    model = quality.RuleModel([quality.Rule((("log_words", True, 1.0),), 2.0)], -1.0)
    scores = [r["score"] for r in quality.with_score(edge, model).collect()]
    assert len(scores) == len(EDGE) and all(0 <= s <= 1 for s in scores)
    assert quality.with_score(edge.limit(0), model).count() == 0
    nothing = quality.train(edge.limit(0), spark.createDataFrame([], "doc_id bigint, quality int"), F.lit(True))
    assert nothing.rules == [] and nothing.intercept == 0


def accuracy(spark, name, column, cut):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = queries.QUERIES[name](spark, folder).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert all(r["predicted"] == int(r["score"] >= cut) for r in found)
    return sum(p == y for p, y in held) / len(held)


def test_quality_held_out(spark):
    assert accuracy(spark, "op1_quality_rules", "quality", 0.3) > 0.9


def test_toxicity_held_out(spark):
    assert accuracy(spark, "op10_toxicity", "toxic", 0.5) > 0.85


# lines


def brute_repeats(found):
    grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    many = collections.Counter(grams)
    return len({i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)})


def test_repeated_words_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in lines.clean_lines(df).collect():
        assert r["n_repeat_words"] == brute_repeats(words(r["text"]))
        assert r["n_words"] == len(words(r["text"]))


def test_line_rules(spark):
    body = "This is a sentence that stays here for good.\nAnother sentence follows it right away."
    text = body + "\nHome\nNews | Sports | Money | Video.\nWe use cookies, see our cookie policy.\nno end mark"
    r = lines.clean_lines(spark.createDataFrame([(text,)], "text string")).first()
    assert r["clean_text"] == body and r["lost_chars"] == r["word_chars"] - len("".join(words(body)))
    assert not lines.clean_lines(spark.createDataFrame([("word " * 3,)], "text string")).first()["kept"]


def test_lines_of_hard_rows(spark, edge):
    found = lines.clean_lines(edge)
    assert found.count() == len(EDGE)
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[2]["n_words"] == 0 and by_id[2]["base_failed"] and not by_id[2]["kept"]
    assert by_id[6]["n_words"] == 80_000
    assert lines.clean_lines(edge.limit(0)).count() == 0


# decontamination


def brute_hits(text, items):
    found = contamination.words_of(text)
    hit, owners = set(), set()
    for item, body in items:
        own = contamination.words_of(body)
        n = min(13, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(found) - n + 1):
            if grams and tuple(found[i : i + n]) in grams:
                hit.update(range(i, i + n))
                owners.add(str(item))
    return len(found), len(hit), sorted(owners)


@pytest.mark.parametrize("block", [1_000_000, 8])
def test_contamination_equals_brute_force(spark, block):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(12)] + ["É", "9"]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 2, 3, 13, 15])))) for i in range(6)] + [(7, None), (8, "--")]
    texts = []
    for _ in range(80):
        parts = [rng.choice([items[rng.randrange(6)][1].upper(), " ".join(rng.choices(pool, k=5))]) for _ in range(4)]
        texts.append(", ".join(parts))
    docs = spark.createDataFrame([(t,) for t in texts + [None, ""]], "text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination.find_contamination(docs, benchmark, block_windows=block, with_text=True)
    for r in found.select("*", contamination.hit_words().alias("n")).collect():
        assert (r["n_words"], r["n"], r["items"]) == brute_hits(r["text"], items)
        covered = sum(s["last"] - s["first"] for s in r["spans"])
        assert len(contamination.words_of(r["clean_text"])) == r["n_words"] - covered


def test_contamination_of_hard_rows(spark, edge):
    benchmark = spark.createDataFrame([(1, EDGE[0][1])], "item_id bigint, text string")
    found = contamination.find_contamination(edge, benchmark)
    assert sorted(found.columns) == sorted({*edge.columns, "items"})
    assert sum(len(r["items"]) for r in found.collect()) == 3
    assert all(not r["items"] for r in contamination.find_contamination(edge, benchmark.limit(0)).collect())
    assert contamination.find_contamination(edge.limit(0), benchmark).count() == 0


# tokens


def test_tokens_equal_the_library(spark, edge):
    import sentencepiece

    path = queries.tokenizer_path()
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "▁", "\t", "the", "ing", "é", "<s>", "</s>", "<0x0A>", "𝔘", "　", "a" * 70, "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(400)]
    docs = edge.select("text").union(spark.createDataFrame([(t,) for t in texts], "text string"))
    for r in tokens.count_tokens(docs, path, memory=50).collect():
        assert r["n_tokens"] == len(whole.encode(r["text"] or "")), r["text"]
        assert r["n_bytes"] == len((r["text"] or "").encode())
    assert tokens.count_tokens(edge.limit(0), path).count() == 0


# language


def test_language_gradients():
    model = language.LanguageModel(["a", "b"], 4)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    rows = np.array([[32, 97, 98, 32], [32, 99, 98, 32]])
    labels = np.array([0, 1])

    def loss():
        return -np.log(model._label(rows)[:, np.arange(2), labels]).mean()

    check_gradients(model.weights, model._gradients(rows, labels), loss)


def check_gradients(weights, gradients, loss, step=1e-5):
    rng = np.random.default_rng(0)
    for name, g in gradients.items():
        for _ in range(4):
            where = tuple(rng.integers(n) for n in g.shape)
            if name in ("ahead", "back", "word", "gram"):
                where = tuple(int(x) for x in np.unravel_index(np.abs(g).argmax(), g.shape))
            old = weights[name][where]
            weights[name][where] = old + step
            up = loss()
            weights[name][where] = old - step
            down = loss()
            weights[name][where] = old
            assert abs((up - down) / (2 * step) - g[where]) < 1e-4 + 1e-2 * abs(g[where]), name


def test_language_learns_and_hard_rows(spark, edge):
    text = {"x": "schön über grün wäre", "y": "niño año señal mañana"}
    rows = [(i, " ".join(random.Random(i).sample(text[k].split(), 3)), k) for i, k in enumerate(["x", "y"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs, F.lit(True), epochs=30)
    found = language.identify(docs, model)
    assert found.where("lang_pred != lang").count() == 0
    hard = {r["doc_id"]: r for r in language.identify(edge, model).collect()}
    assert all(hard[i]["lang_pred"] == "und" and hard[i]["score"] == 0 for i in (2, 3, 4))
    assert 0 < hard[6]["score"] <= 1
    untaught = language.train(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(edge, untaught).collect()} == {"und"}
    assert language.identify(edge.limit(0), model).count() == 0


# toxicity


def test_toxicity_gradients():
    model = toxicity.ToxicityModel(hidden=3, size=2, width=4)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    ids = model._ids(["one", "two", "three"])
    grid, lengths, labels = np.array([[1, 2, 3, 1], [2, 3, 0, 0]]), np.array([4, 2]), np.array([1.0, 0.0])

    def loss():
        vectors = np.concatenate([np.zeros((1, 4)), model._embed(ids)])
        logit = model._run(vectors, grid, lengths)
        return np.mean(np.log1p(np.exp(logit)) - labels * logit)

    check_gradients(model.weights, model._gradients(ids, grid, lengths, labels), loss)


def test_windows_cover_every_word():
    model = toxicity.ToxicityModel()
    counts = np.array([0, 1, 24, 25, 100])
    text, begin, length = model._windows(counts)
    for t, n in enumerate(counts):
        seen = set()
        for b, size in zip(begin[text == t], length[text == t]):
            seen.update(range(b, b + size))
        assert seen == set(range(n))


def test_toxicity_of_hard_rows(spark, edge):
    model = toxicity.ToxicityModel()
    scores = {r["doc_id"]: r["score"] for r in toxicity.with_score(edge, model).collect()}
    assert scores[2] == scores[3] == scores[4] == 0 and 0 <= scores[6] <= 1
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.train(edge, labels, F.lit(True)).constant == 0.5


def test_toxicity_is_learned_from_long_texts(spark):
    rng = random.Random(11)
    plain = ["".join(rng.choices("aeioubdlmnrst", k=6)) for _ in range(400)]
    rows = []
    for i in range(120):
        found = rng.choices(plain, k=rng.randrange(900, 1100))
        if i % 3 == 0:
            found[rng.randrange(len(found))] = "zzyxqk wqxkz"
        rows.append((i, " ".join(found), int(i % 3 == 0)))
    assert min(len(text) for _, text, _ in rows) > 4000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.col("doc_id") < 90)
    assert model.constant is None
    found = toxicity.with_score(docs, model).collect()
    assert all((r["score"] >= 0.5) == bool(r["toxic"]) for r in found)


def test_toxicity_chooses_among_all_windows():
    model, odds = toxicity.ToxicityModel(), np.full(toxicity.GRAM_ROWS, -9.0)
    odds[toxicity.gram_rows(["zzyxqk"])[0]] = 5.0
    text = " ".join(["word"] * 20_000 + ["zzyxqk"])
    keys, labels = np.array([5, 6]), np.array([1, 0])
    of, _, words = model.choose(keys, [text, text], labels, odds, 0, 16)
    assert [("zzyxqk" in w) for w, t in zip(words, of) if t == 0] == [True]
    assert sum(of == 1) in range(17, 20) and any("zzyxqk" in w for w, t in zip(words, of) if t == 1)


# pages

PAGE = """<html><head><title>T</title><script>x<p>1</p></script></head><body><header>Top</header>
<nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, really.</div>
<div class=layout><div class="sidebar"><p>See also, these other, pages, and more of them, all linked.</p></div>
<div id="story"><h2>The title of it</h2><p>First paragraph, with a <b>bold</b> word &amp; more, and commas.
<p>Second  one,\n here, is long enough to count as well, &eacute;t voil&agrave;.<ul><li>A point, made at length<li>Another point</ul></div>
<div class="comments"><p>I, a reader, disagree, with all, of it, and say so at length here.</p></div></div>
<form><p>Subscribe, now, please, to this</p></form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == (
        "The title of it First paragraph, with a bold word & more, and commas. Second one, here, is long enough to "
        "count as well, ét voilà. A point, made at length Another point"
    )


STORY = "".join(f"<p>Paragraph {i} of the story, long enough, with commas, to count.</p>" for i in range(4))
STORY_TEXT = " ".join(f"Paragraph {i} of the story, long enough, with commas, to count." for i in range(4))


@pytest.mark.parametrize("names", ['class="page with-sidebar"', 'class="layout no-sidebar"', 'class="has-sidebar"',
                                   'class="main-content with-sidebar"', 'class="post comments-open"', 'id="search"'])
@pytest.mark.parametrize("inside", ["<article>{}</article>", "<div>{}</div>"])
def test_names_of_wrappers_keep_the_page(names, inside):
    side = '<div class="site-sidebar"><p>Other pages, and more, of them.</p></div><div class="ad-box">Buy this, now, please</div>'
    page = f"<body><div {names}>{side}{inside.format(STORY)}</div></body>"
    assert html_text.main_text(page) == STORY_TEXT


def test_names_inside_a_story_keep_its_parts():
    page = (
        f'<body><main><article>{STORY}<section id="related-work"><h2 id="search">Search</h2><p class="notice">Short.</p></section>'
        '<section id="social-impact"><p>It had one, and it was large.</p></section><div class="share-buttons">Send</div></article>'
        '<section id="comments"><p>I, a reader, disagree, with all, of it.</p></section></main></body>'
    )
    assert html_text.main_text(page) == STORY_TEXT + " Search Short. It had one, and it was large."


REST = (
    "<ul><li>A point</li><li>Another</li></ul><h3>Further</h3><pre>x = 1</pre><blockquote>Said so.</blockquote>"
    "<table><tr><td>Cell</td></tr></table><div><p>One short end.</p></div>"
)
REST_TEXT = " A point Another Further x = 1 Said so. Cell One short end."


def test_parts_beside_the_best_container_stay():
    links = "<ul><li><a href=/a>Other page</a><li><a href=/b>One more page</a></ul>"
    inner = f"<div class=content>{STORY}</div>{REST}"
    for around in ("<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<main><div>{}</div></main>"):
        page = f"<body>{links}{around.format(inner)}{links}<div class='ad'>Buy, now</div></body>"
        assert html_text.main_text(page) == STORY_TEXT + REST_TEXT
    page = f"<body><div>{links}Before, <b>bold</b>{inner}{links}</div></body>"
    assert html_text.main_text(page) == "Before, bold " + STORY_TEXT + REST_TEXT
    page = f"<main><h1>Title</h1><article>{STORY}</article><article><p>Short.</p></article>{links}<div>About us</div></main>"
    assert html_text.main_text(page) == "Title " + STORY_TEXT + " Short."


def test_many_comments_do_not_outscore_the_story():
    notes = "".join(f"<li><article class='comment-body'><p>Reader {i}, in short, disagrees, again.</p></article>" for i in range(40))
    for story in (f"<article>{STORY}</article>", f"<div>{STORY}</div>"):
        page = f"<body><div>{story}<div id='comments'><ol class='comment-list'>{notes}</ol></div></div></body>"
        assert html_text.main_text(page) == STORY_TEXT


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</div></p>", "<!--", "<script>x", "<div " + "<b>" * 3000])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page), str)


def test_pages_of_hard_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, PAGE, "x"), (None, PAGE, None)], "page_id bigint, html string, text string")
    found = html_text.extract(pages)
    assert sorted(len(r["text"]) > 0 for r in found.collect()) == [False, True, True]
    assert html_text.extract(pages.limit(0)).count() == 0


# mixing


def test_mix_meets_targets(spark, edge):
    found = mixing.mix_sizes(edge).collect()
    assert len(found) == len(EDGE)
    assert sum({r["source"]: r["target"] for r in found}.values()) == pytest.approx(sum(r["size"] for r in found))
    assert all(0 <= r["times"] <= 3 and r["target"] <= 3 * r["source_size"] for r in found)
    again = mixing.mix_sizes(edge).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    copies = collections.Counter(r["doc_id"] for r in mixing.mixed(edge).collect())
    times = collections.Counter()
    for r in found:
        times[r["doc_id"]] += r["times"]
    assert copies == +times and mixing.mixed(edge).columns == edge.columns
    assert mixing.mix_sizes(edge.limit(0)).count() == 0


def test_mix_of_many_sources_needs_no_broadcast(spark, edge):
    narrow = edge.select(
        "source", mixing.count_words(mixing.text_or_empty()).alias("size"), mixing.seeded_key().alias("key")
    )
    plans = [mixing.source_plan(narrow, broadcast_sources=most) for most in (0, mixing.BROADCAST_SOURCES)]
    taken = [
        sorted(map(repr, mixing.with_repetitions(narrow, plan, F.col("key"), most).collect()))
        for plan, most in zip(plans, (0, mixing.BROADCAST_SOURCES))
    ]
    assert taken[0] == taken[1] and len(taken[0]) == len(EDGE)


def test_water_filling_equals_rounds(spark):
    rng = random.Random(8)
    for _ in range(4):
        sizes = [(f"s{i:02}", rng.choice([0, 1, 5, 50, 4000]), i % 3 + 1) for i in range(9)]
        total = sum(s for _, s, _ in sizes)
        want, open_ = {}, {n: (s, w) for n, s, w in sizes}
        while open_:
            rest = total - sum(want.values())
            share = {n: rest * w / sum(w for _, w in open_.values()) for n, (s, w) in open_.items()}
            over = [n for n, (s, w) in open_.items() if share[n] >= 3 * s]
            if not over:
                want |= share
                break
            for n in over:
                want[n] = 3 * open_.pop(n)[0]
        df = spark.createDataFrame(sizes, "source string, size bigint, weight bigint")
        got = {r["source"]: r["target"] for r in mixing.water_fill(df).collect()}
        assert got == pytest.approx(want)


# sharding


def test_differencing_is_tight_and_consistent():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 10_000, 500).tolist()
    parts, sums = sharding._deal(sizes, 8)
    assert [sum(s for s, p in zip(sizes, parts) if p == k) for k in range(8)] == sums.tolist()
    assert sums.max() - sums.min() <= 2


@pytest.mark.parametrize("items, spread", [(16_384, 40), (100, 400)])
def test_shards(spark, items, spread):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(60)))) for i in range(400)]
    rows += [(1000 + i, "copy of one text") for i in range(50)] + [(None, None), (None, ""), (5, rows[5][1])]
    found = sharding.byte_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, items).collect()
    assert len(found) == len(rows)
    total, slots, of_text = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in found:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of_text[(r["text_crc32"], r["size"])].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert max(total.values()) - min(total.values()) <= spread


def test_shards_of_hard_rows(spark, edge):
    assert sharding.byte_shards(edge).count() == len(EDGE)
    assert sharding.byte_shards(edge.limit(0)).count() == 0


# near duplicates


def brute_print(text):
    found = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(edge):
    for _, text, _, _ in EDGE:
        assert simhash.fingerprint(text) == brute_print(text)


def brute_components(prints, radius=3):
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_bk_forest_finds_all_in_radius():
    rng = np.random.default_rng(2)
    shard = np.sort(rng.integers(0, 5, 300))
    base = rng.integers(0, 1 << 60, 8).astype(np.uint64)
    prints = base[rng.integers(0, 8, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    _, first = np.unique(np.stack([shard.astype(np.uint64), prints]), axis=1, return_index=True)
    shard, prints = shard[np.sort(first)], prints[np.sort(first)]
    forest = bktree.Forest(shard, prints)
    got = {(int(a), int(b)) for q, n in forest.search(prints, forest.root, 3, block=50) for a, b in zip(q, n)}
    near = np.bitwise_count(prints[:, None] ^ prints) <= 3
    assert got == set(map(tuple, np.argwhere(near & (shard[:, None] == shard)).tolist()))


@pytest.mark.parametrize("shard_size", [4096, 20, 3])
def test_links_connect_what_is_near(spark, shard_size):
    rng = random.Random(9)
    prints = set()
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(25):
            prints.add(at)
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                at ^= 1 << bit
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(v,) for v in signed.values()], "print bigint")
    found = {r["node"]: r["root"] for r in components.components(simhash.links(df, 3, shard_size)).collect()}
    want = brute_components(sorted(prints))
    groups = collections.defaultdict(set)
    for p, l in want.items():
        groups[l].add(signed[p])
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_near_duplicates_of_hard_rows(spark, edge):
    found = rows_of(simhash.near_duplicates(edge), "doc_id", "component_id")
    ids = dict(found)
    assert len(found) == len(EDGE) and ids[5] == 1 and ids[3] == ids[4] == 2
    kept = simhash.one_per_component(edge)
    assert kept.columns == edge.columns
    # the row without an id is a component of its own
    assert rows_of(kept, "doc_id") == [(1,), (2,), (6,), (7,), (None,)]
    assert simhash.one_per_component(edge.limit(0)).count() == 0


# queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        db.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    result = queries.QUERIES[name](spark, FOLDER)
    cursor = db.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    assert rows_of(result, *columns) == sorted(cursor.fetchall(), key=repr)


def test_pipeline_equals_brute_force(spark):
    """Each stage on its predecessor's rows, by plain Python where the operator is exact."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op1_quality_rules"](spark, FOLDER).collect()}
    rows = [r for r in docs.collect() if scored[r["doc_id"]] == 1]
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in rows}
    label = brute_components(sorted(set(prints.values())))
    best = {}
    for i, p in prints.items():
        best[label[p]] = min(best.get(label[p], i), i)
    rows = [r for r in rows if best[label[prints[r["doc_id"]]]] == r["doc_id"]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = []
    for r in rows:
        n, hit, _ = brute_hits(r["text"], items)
        if not (hit and 20 * hit >= n):
            clean.append(r)
    mix = mixing.mix_sizes(spark.createDataFrame(clean, docs.schema)).collect()
    want = collections.Counter({r["doc_id"]: r["times"] for r in mix})
    found = corpus_pipeline.run(spark, FOLDER)
    got = collections.Counter(r["doc_id"] for r in found.collect())
    assert got == +want
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "SimHash near-dedup"
    sums = [r["s"] for r in found.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) <= 16 and hashlib.sha256(b"").hexdigest() == contamination_empty(spark)


def contamination_empty(spark):
    df = spark.createDataFrame([([],)], "items array<string>")
    return df.select(contamination.items_digest()).first()[0]


def test_folder_is_there():
    assert os.path.isdir(FOLDER)
