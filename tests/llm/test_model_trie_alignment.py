"""Language model, token alignment and prefix trie against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultline.llm import alignment, language_model, prefix_trie, queries
from faultline.llm.common import remainder

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
TEXT = "doc_id long, text string, block string, learn int"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_scores(rows, order, strength=3.0, add=0.1):
    """Interpolated probabilities word by word, without states or failure arcs."""
    border = object()
    streams = {i: [border, *WORD.findall(lowered(t)), border] for i, (_, t) in enumerate(rows)}
    learned = [i for i, (d, _) in enumerate(rows) if d is not None and zlib.crc32(str(d).encode()) % 10]
    counts = Counter()
    for i in learned:
        s = streams[i]
        for k in range(1, order + 1):
            counts.update(tuple(s[p - k + 1 : p + 1]) for p in range(max(k - 1, 1), len(s)))
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(1 for g in counts if len(g) == 1)

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + add) / (n + add * (v + 1))
        return (counts[gram] + strength * p(gram[1:])) / (counts[gram[:-1]] + strength)

    out = []
    for i, (d, _) in enumerate(rows):
        s = streams[i]
        ends = range(1, len(s))
        out.append((
            d, len(s) - 1, sum(counts[(s[e],)] > 0 for e in ends), n,
            sum(math.log10(p((s[e],))) for e in ends),
            sum(math.log10(p(tuple(s[max(0, e - order + 1) : e + 1]))) for e in ends),
        ))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_automaton_equals_plain_probabilities(spark, order):
    rng = random.Random(order)
    words = ["the", "The", "of", "Étion", "a\x0bb", "x-y", "word\x00", "的中文"]
    rows = [(i, " \n\t".join(rng.choices(words, k=rng.choice([0, 1, 2, 7, 60])))) for i in range(80)]
    rows += [(7, rows[7][1])] * 3 + [(None, "the of"), (200, None), (201, ""), (202, " \n "), (203, "unseen words here")]
    rows += [(300, "the of " * 3000)]
    docs = spark.createDataFrame([(d, t, "b", 1) for d, t in rows], TEXT).repartition(3).cache()
    learn = remainder(F.col("doc_id"), 10) != 0
    scored = language_model.with_scores(docs, learn, order, strength=3.0, block_bytes=700)
    assert scored.columns == ["doc_id", "block", "learn", *["n_tokens", "n_known", "train_tokens", "base_score", "score"]]
    got = sorted(
        (tuple(r) for r in scored.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()),
        key=repr,
    )
    want = sorted(plain_scores(rows, order), key=repr)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[1])), sorted(want, key=lambda r: (str(r[0]), r[1]))):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)
    docs.unpersist()


def test_model_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.with_scores(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = language_model.with_scores(one, F.lit(False)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_model_beats_single_words_on_held_out_texts(spark):
    rows = queries.op11_language_model(spark, FOLDER).where("held_out").agg(
        F.sum("score").alias("score"), F.sum("base_score").alias("base")
    ).first()
    assert rows.score > rows.base


# -- alignment ---------------------------------------------------------------------------------


def plain_alignment(texts):
    """Both libraries on whole texts, and every A-B pair compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    alphabet = alignment._byte_alphabet()

    def spans(ids, spell):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(spell(i))))
            at = out[-1][2]
        return out, b"".join(spell(i) for i in ids)

    documents = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        left, raw_a = spans(a.encode(whole.decode(), add_special_tokens=False).ids,
                            lambda i: bytes(alphabet[c] for c in a.id_to_token(i)))
        right, raw_b = spans(b.encode(text or ""), lambda i: alignment._piece_bytes(b.id_to_piece(i)))
        if not text or raw_a != whole or raw_b != whole:
            documents.append(([], [], [], []))
            continue
        links = [(x, y) for x, i, j in left for y, k, m in right if i < m and k < j]
        ends = sorted({j for _, _, j in left} & {m for _, _, m in right})
        groups, at = [], 0
        for end in ends:
            groups.append((
                [x for x, i, j in left if at < j <= end], [y for y, k, m in right if at < m <= end]
            ))
            at = end
        documents.append((left, right, links, groups))
    counts = Counter(p for d in documents for p in set(d[2]))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for left, right, links, groups in documents:
        named = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            len(left), len(right), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(named.encode()).hexdigest() if left else "",
        ))
    links = Counter(p for d in documents for p in d[2])
    return out, {p: (n, links[p]) for p, n in counts.items()}


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts(n):
    rng = random.Random(4)
    parts = [
        "the", "The", " ", "  ", "\n", "\n\n", "\t", "\r\n", "don't", "Étion", "é", "naïve", "的中文", "🙂",
        "\x00", "\x1c", "\x85", " ", " ", "　", "᠎", "​", "12", "345", "...", "<|endoftext|>",
        "</s>", "<s>", "<0x0A>", "ﬁ", "①", "=", "word,word", "(x)", "Straße", "à", "́",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(n)]
    return [*texts, None, "", " ", "\n", "a▁b", "▁", "x" * 3000, "the " * 500, "the " * 500, "the cat", " lead", "trail "]


def test_alignment_equals_whole_texts(spark):
    texts = odd_texts(600)
    texts += [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    rows = [(i, t, "b", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, TEXT).repartition(3)
    want, pairs = plain_alignment(texts)
    index = alignment.PairIndex(docs, queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path(),
                                groups=True, block_bytes=20_000, memory=900)
    scored = index.scored()
    assert scored.columns == ["doc_id", "block", "learn", *COLUMNS[:4], "groups", "groups_sha256", "n_best", "count_sum"]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in scored.collect()}
    assert got == dict(enumerate(want))
    found = {(r.a, r.b): (r.n_docs, r.links) for r in index.pairs().collect()}
    assert found == pairs


def test_alignment_of_repeated_rows_and_none(spark):
    a, b = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path()
    docs = spark.createDataFrame([(1, "the cat")] * 40 + [(2, None)], "doc_id long, text string").coalesce(1)
    rows = alignment.PairIndex(docs, a, b).scored().collect()
    want, _ = plain_alignment(["the cat"] * 40 + [None])
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(want)
    assert alignment.PairIndex(docs.where("false"), a, b).scored().count() == 0


def test_bitmaps_both_ways():
    import numpy as np

    for rows in (1, 9, 1000, 65536):
        for n in {0, 1, rows // 20, rows // 2, rows}:
            numbers = np.array(sorted(random.Random(n).sample(range(rows), n)), np.int64)
            assert alignment.members(alignment.bitmap(numbers, rows), rows).tolist() == numbers.tolist()


# -- prefix trie -------------------------------------------------------------------------------


def plain_trie(rows, family=5, span=9):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    order = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in turns.items()}
    members = {}
    for c, own in order.items():
        h = zlib.crc32(str(c).encode()) % span
        path = order.get(c - c % family, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, len(path) == d))
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, held in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c, last in sorted(held) if last)
        out.append((
            min(held)[0], len(p), min(members[p[:-1]])[0] if p else None, len(held), children[p],
            sum(not children[q] for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


CONVERSATION = "conv_id long, turn long, role string, text string, path string, block int"


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
@pytest.mark.parametrize("hot", [False, True])
def test_trie_equals_plain_python(spark, cells, hot):
    rng = random.Random(cells)
    rows = []
    for c in range(0, 260):
        if c in (15, 20) or rng.random() < 0.1:
            continue
        n = rng.choice([1, 2, 3, 4, 9, 14])
        same = hot and c % 3 == 0
        for t in range(n if not same else 3):
            text = "hello" if same or (t == 0 and rng.random() < 0.5) else rng.choice(["a", "bé", "", None, "ccc"])
            rows.append((c, t if t else None, "user" if t % 2 else None, text, "p", t))
    rows += [(None, 1, "user", "lost", "p", 1)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, CONVERSATION)
    lists = prefix_trie.with_family_start(prefix_trie.turn_lists(table, 5), 9)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.prefix_trie(lists, cells=cells)
        assert got.columns == prefix_trie.NODE
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie([r[:4] for r in rows])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_trie_of_nothing_and_of_long_paths(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    assert prefix_trie.prefix_trie(prefix_trie.turn_lists(empty)).count() == 0
    long = [(c, t, "user", f"turn {t}", "p", 0) for c in (1, 2, 3) for t in range(400 + c)]
    got = prefix_trie.prefix_trie(prefix_trie.turn_lists(spark.createDataFrame(long, CONVERSATION)), cells=100)
    rows = {r.depth: r for r in got.collect()}
    assert len(rows) == 404 and rows[0].n_convs == 3 and rows[403].n_convs == 1
    assert rows[0].n_leaves == 1 and all(rows[d].n_children == 1 for d in range(403))
    assert rows[402].parent_conv_id == 1 and rows[403].parent_conv_id == 2 and rows[403].conv_id == 3
