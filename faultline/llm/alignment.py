"""Alignment of two tokenizers: inverted pair bitmaps.

Texts are tokenized by a byte-level BPE (A) and a SentencePiece BPE (B).  Where tokens of both end
at one byte a group ends; an A and a B token that share bytes are linked.  Both tokenizers are
blind across the place between a character that is no white space and a space or line end, so
texts are cut there into units, and each distinct unit of a task is tokenized and linked once.

The index: documents are numbered within blocks, and for each pair of ids a block has compressed
bitmaps of documents, one plane per binary digit of the number of links in the document.  The OR of
the planes tells which documents hold the pair; its popcount, over all blocks, is the pair's count
of documents, and the popcounts of the planes give its links.  The counts go back along the
postings to the documents.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import buffers, fresh, set_aside, ship, slices

#: Documents of a block: a number in it takes 16 bits.
BLOCK_ROWS = 1 << 16
#: The last bytes of white space beyond ASCII (and of characters that some rules take for it).
WIDE_GAPS = tuple(
    chr(c).encode()
    for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def _byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones stand for
    themselves, the others for 256 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Linker:
    """Tokenizes and links units; remembers at most ``memory`` units."""

    def __init__(self, path_a: str, path_b: str, memory: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        crossing = [p for p in pieces if "▁" in p.lstrip("▁") or "\n" in p]
        if crossing:
            raise ValueError(f"pieces cross unit borders: {crossing[:5]}")
        alphabet = _byte_alphabet()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        # an entry outside the alphabet is a special token, which texts never give
        self.bytes_a = [
            bytes(alphabet.get(c, 0) for c in entries.get(i, "")) for i in range(max(entries) + 1)
        ]
        self.bytes_b = [_piece_bytes(p) for p in pieces]
        self.sizes_a = np.array([len(x) for x in self.bytes_a])
        self.sizes_b = np.array([len(x) for x in self.bytes_b])
        self.mark = pieces.index("▁")
        # every id with each mark that can follow it
        most = max(len(self.bytes_a), len(pieces))
        self.marks = {m: k * most for k, m in enumerate(",|;")}
        self.names = pa.array([f"{i}{m}" for m in ",|;" for i in range(most)], pa.large_string())
        self.memory = memory
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        self.figures = [np.zeros((0, 4), np.int64)]
        self.pairs = [np.zeros(0, np.int64)]

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, each beginning with a space or line end: the library of B puts a
        space mark before a text, so a space is left out and a line end loses the mark."""
        found = self.a.encode_batch_fast(texts, add_special_tokens=False)
        a = np.concatenate([np.array(x.ids, np.int64) for x in found])
        b = []
        asked = [t[1:] if t[0] == " " else t for t in texts]
        for text, question, ids in zip(texts, asked, self.b.encode(asked, num_threads=1)):
            b.extend([self.mark] if not question else ids[1:] if text[0] != " " and ids[0] == self.mark else ids)
        return a, np.array(b, np.int64)

    def _whole(self, a, b, raw: bytes) -> bool:
        return (
            b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw
        )

    def _learn(self, units: list[bytes]) -> None:
        """Tokenizes many units in a row; one that ends with white space ends the row."""
        row: list[bytes] = []
        rows: list[list[bytes]] = []
        size = whole = 0
        for unit in units:
            row.append(unit)
            size += len(unit)
            last = unit[-1]
            if size > 1 << 10 or last <= 32 or (last >= 128 and unit.endswith(WIDE_GAPS)):
                rows.append(row)
                whole += size
                row, size = [], 0
                if whole > 1 << 17:
                    self._link(rows)
                    rows, whole = [], 0
        if row:
            rows.append(row)
        if rows:
            self._link(rows)

    def _link(self, rows: list[list[bytes]]) -> None:
        spelled = [b"".join(r) for r in rows]
        raw, units = b"".join(spelled), [u for r in rows for u in r]
        a, b = self._tokens([r.decode() for r in spelled])
        unit_ends = np.cumsum([len(u) for u in units])
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        sound = self._whole(a.tolist(), b.tolist(), raw)
        if sound:
            at_a, at_b = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
            at_a[ends_a] = at_b[ends_b] = True
            sound = bool((at_a & at_b)[unit_ends].all())
        if not sound and len(units) > 1:
            for unit in units:
                self._link([[unit]])
            return
        for unit in units:
            self.number[unit] = len(self.number)
        if not sound:
            self.groups.append(b"")  # and no token, which marks it
            self.figures.append(np.zeros((1, 4), np.int64))
            return
        # each stretch between two ends lies in one token of A and one of B: a link
        ends, both = np.flatnonzero(at_a | at_b), np.flatnonzero(at_a & at_b)
        links_a, links_b = a[np.searchsorted(ends_a, ends)], b[np.searchsorted(ends_b, ends)]
        upto = [np.searchsorted(e, unit_ends, "right") for e in (ends_a, ends_b, both, ends)]
        self.figures.append(np.stack([np.diff(u, prepend=0) for u in upto], 1))
        self.pairs.append(links_a << 16 | links_b)
        # the ids of each group, those of A first, each with the mark that follows it
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        last_a, last_b = np.diff(group_a, append=len(both)) > 0, np.diff(group_b, append=len(both)) > 0
        rank = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        entry = np.concatenate([a + np.where(last_a, self.marks["|"], 0), b + np.where(last_b, self.marks[";"], 0)])
        written = self.names.take(pa.array(entry[rank]))
        bounds = np.frombuffer(written.buffers()[1], np.int64)[: len(written) + 1]
        text = written.buffers()[2].to_pybytes()
        first = 0
        for last in bounds[upto[0] + upto[1]].tolist():
            self.groups.append(text[first : last - 1])
            first = last

    def ready(self, units: list[bytes]) -> np.ndarray:
        """Numbers of distinct units, after learning new ones."""
        if len(self.number) + len(units) > self.memory:
            self.clear()
        self._learn([u for u in units if u not in self.number])
        self.figures, self.pairs = [np.concatenate(self.figures)], [np.concatenate(self.pairs)]
        return np.array([self.number[u] for u in units], np.int64)


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All units of `` `` + text in a row, dictionary-encoded, and where each text's begin."""
    raw, offsets = buffers(texts)
    n = len(texts)
    starts = offsets[:-1] + np.arange(n)
    spaced = np.empty(len(raw) + n, np.uint8)
    inside = np.ones(len(spaced), bool)
    inside[starts] = False
    spaced[inside] = raw
    spaced[starts] = 32
    at = np.flatnonzero((spaced == 32) | (spaced == 10))
    at = at[at > 0]
    before = spaced[at - 1]
    open_ = (before > 32) & (before != 127)
    odd = np.flatnonzero(before >= 128)
    for gap in WIDE_GAPS:
        ends = np.ones(len(odd), bool)
        for back, byte in enumerate(reversed(gap), 1):
            ends &= spaced[np.maximum(at[odd] - back, 0)] == byte
        open_[odd[ends]] = False
    cut_at = ~inside
    cut_at[at[open_]] = True
    cuts = np.flatnonzero(cut_at)
    bounds = np.append(cuts, len(spaced)).astype(np.int64)
    units = pa.Array.from_buffers(
        pa.large_binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(spaced)]
    ).dictionary_encode()
    return units, np.append(np.searchsorted(cuts, starts), len(cuts))


def _linked(linker: Linker, texts: pa.Array):
    """Figures and group strings of texts, and (text, pair, links) for each pair a text holds."""
    units, first = _units(texts)
    names = linker.ready(units.dictionary.to_pylist())
    used = names[units.indices.to_numpy(zero_copy_only=False)]
    table, pairs = linker.figures[0], linker.pairs[0]
    sound = table[used, 0] > 0
    lengths = np.diff(first)
    filled = np.array([bool(t) for t in texts.to_pylist()]) & (np.add.reduceat(~sound, first[:-1]) == 0)
    figures = np.where(filled[:, None], np.add.reduceat(table[used], first[:-1], axis=0), 0)
    groups, bounds, listed = [], first.tolist(), used.tolist()
    for i, good in enumerate(filled.tolist()):
        groups.append(
            b";".join([linker.groups[u] for u in listed[bounds[i] : bounds[i + 1]]]) if good else b""
        )
    text = np.repeat(np.arange(len(lengths)), lengths)
    held = filled[text]
    code, times = np.unique(text[held] * len(table) + used[held], return_counts=True)
    text, unit = np.divmod(code, len(table))
    ends = np.cumsum(table[:, 3])
    n = table[unit, 3]
    place = np.arange(int(n.sum())) + np.repeat(ends[unit] - n - (np.cumsum(n) - n), n)
    code = pairs[place] << 16 | np.repeat(text, n)
    return figures, groups, _summed(code, np.repeat(times, n))


def _summed(code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(code):
        return code, times
    rank = np.argsort(code, kind="stable")
    code, times = code[rank], times[rank]
    start = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
    return code[start], np.add.reduceat(times, start)


def bitmap(numbers: np.ndarray, rows: int) -> bytes:
    """Ascending numbers below ``rows`` as 16-bit numbers, or as bits where that is no longer."""
    if 2 * len(numbers) < (rows + 7) // 8:
        return numbers.astype("<u2").tobytes()
    bits = np.zeros(rows, np.uint8)
    bits[numbers] = 1
    return np.packbits(bits).tobytes()


def members(data: bytes, rows: int) -> np.ndarray:
    """The numbers of a :func:`bitmap`."""
    if len(data) < (rows + 7) // 8:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), count=rows))


def _postings(code: np.ndarray, times: np.ndarray, rows: int) -> dict[str, list]:
    """Per pair of a block: planes of its number of links, and the popcounts of their OR and, by
    worth, of the planes."""
    pair, number = code >> 16, code & 0xFFFF
    start = np.flatnonzero(np.diff(pair, prepend=-1))
    stop = np.append(start[1:], len(pair))
    out: dict[str, list] = {
        "a": (pair[start] >> 16).tolist(),
        "b": (pair[start] & 0xFFFF).tolist(),
        "planes": [],
        "n_docs": (stop - start).tolist(),
        "links": np.add.reduceat(times, start).tolist() if len(start) else [],
    }
    small = number.astype("<u2").tobytes()
    for i, j, links in zip(start.tolist(), stop.tolist(), out["links"]):
        if links == j - i and 2 * links < (rows + 7) // 8:  # one link in each: one plane
            out["planes"].append([small[2 * i : 2 * j]])
            continue
        n, t = number[i:j], times[i:j]
        out["planes"].append([bitmap(n[t >> d & 1 == 1], rows) for d in range(int(t.max()).bit_length())])
    return out


def _returned(rows: int, planes: pa.Array, worth: np.ndarray) -> np.ndarray:
    """Sums of ``worth`` (one row of numbers per pair) over the links of a block's documents."""
    each = np.diff(planes.offsets.to_numpy())
    flat = planes.flatten().cast(pa.large_binary())
    pair = np.repeat(np.arange(len(each)), each)
    digit = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
    worth = worth[pair] << digit[:, None]
    size = np.diff(np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1])
    packed = size >= (rows + 7) // 8
    out = np.zeros((rows, worth.shape[1]), np.int64)
    listed = np.frombuffer(b"".join(flat.filter(pa.array(~packed)).to_pylist()), "<u2").astype(np.int64)
    for c in range(worth.shape[1]):
        np.add.at(out[:, c], listed, np.repeat(worth[~packed, c], size[~packed] // 2))
    for i in np.flatnonzero(packed).tolist():
        out[members(flat[i].as_py(), rows)] += worth[i]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], linker: Linker, schema: pa.Schema, carried: list[str],
            block_bytes: int, groups: bool) -> Iterator[pa.RecordBatch]:
    """Rows of documents and of postings, block by block."""
    number = TaskContext.get().partitionId() << 32
    rows, weight, codes = 0, 0, []

    def closed() -> pa.RecordBatch:
        code = _summed(*map(np.concatenate, zip(*codes)))
        found = _postings(*code, rows)
        n = len(found["a"])
        found |= {"block": [number] * n, "rows": [rows] * n}
        return pa.RecordBatch.from_arrays(
            [pa.array(found[f.name], f.type) if f.name in found else pa.nulls(n, f.type) for f in schema],
            schema=schema,
        )

    for batch in batches:
        for first, last in slices(batch.column("text")):
            for first in range(first, last, BLOCK_ROWS // 4):
                part = batch.slice(first, min(last - first, BLOCK_ROWS // 4))
                texts = part.column("text").fill_null("")
                size = len(buffers(texts)[0])
                if codes and (rows + len(part) > BLOCK_ROWS or weight + size > block_bytes):
                    yield closed()
                    number, rows, weight, codes = number + 1, 0, 0, []
                figures, strings, (code, times) = _linked(linker, texts)
                codes.append((code + rows, times))
                found = dict(zip(FIGURES, figures.T)) | {
                    "block": np.full(len(part), number),
                    "slot": np.arange(rows, rows + len(part)),
                    "groups": [s.decode() for s in strings] if groups else None,
                    "groups_sha256": [hashlib.sha256(s).hexdigest() if s else "" for s in strings],
                }
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(f.name) if f.name in carried
                        else pa.array(found[f.name], f.type) if found.get(f.name) is not None
                        else pa.nulls(len(part), f.type)
                        for f in schema
                    ],
                    schema=schema,
                )
                rows, weight = rows + len(part), weight + size
    if codes:
        yield closed()


OWN = (
    "block bigint, slot int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
    "groups_sha256 string, rows int, a int, b int, planes array<binary>, n_docs bigint, links bigint"
)


class PairIndex:
    """The written index of ``docs``: ``documents`` and ``postings``.

    A text that is null or empty, or whose tokens do not spell it (B leaves its space mark
    ambiguous, for example), has no tokens: figures 0, groups and digest empty.  Repeated rows are
    documents of their own.  ``groups`` asks for the group strings to be kept.  ``text`` is left
    out; a column of an own name is replaced.
    """

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, groups: bool = False,
                 block_bytes: int = 24 << 20, memory: int = 300_000):
        from pyspark.sql.pandas.types import to_arrow_schema

        spark = docs.sparkSession
        ship(spark)
        results = [*FIGURES, "groups", "groups_sha256", "n_best", "count_sum"]
        docs = docs.drop(*results)
        own = T._parse_datatype_string(OWN)
        plain, _ = set_aside(docs, *[f.name for f in own if f.name not in results])
        carried = [c for c in plain.columns if c != "text"]
        self.names = dict(zip([c for c in docs.columns if c != "text"], carried))
        self.results = [c for c in results if groups or c != "groups"]
        schema = T.StructType([*[f for f in plain.schema.fields if f.name != "text"], *own.fields])
        arrow = to_arrow_schema(schema)

        def run(batches):
            yield from _blocks(batches, Linker(path_a, path_b, memory), arrow, carried, block_bytes, groups)

        folder = fresh(spark, "pair-index")
        plain.mapInArrow(run, schema).write.parquet(folder)
        shown = [c for c in self.results if c not in ("n_best", "count_sum")]
        self.documents = spark.read.schema(schema).parquet(folder).where("slot is not null").select(
            "block", "slot", *carried, *shown
        )
        self.postings = spark.read.schema(schema).parquet(folder).where("a is not null").select(
            "block", "rows", "a", "b", "planes", "n_docs", "links"
        )

    def pairs(self) -> DataFrame:
        """``a``, ``b``, ``n_docs`` and ``links`` of each pair.  Blocks have different documents, so
        the popcount of the OR of all bitmaps of a pair is the sum of those of its blocks."""
        return self.postings.groupBy("a", "b").agg(
            F.sum("n_docs").alias("n_docs"), F.sum("links").alias("links")
        )

    def scored(self) -> DataFrame:
        """The documents with ``n_best`` and ``count_sum``."""
        counts = self.pairs().select(
            "a", "b", F.col("n_docs").alias("count"),
            # the pairs of an A id are no more than B has ids
            (F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a"))).cast("bigint").alias("best"),
        )
        postings = self.postings.select("block", "rows", "a", "b", "planes").join(counts, ["a", "b"])
        schema = T.StructType(
            [f for f in self.documents.schema.fields if f.name not in ("block", "slot")]
            + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")]
        )

        def score(documents, found):
            slot = documents.column("slot").to_numpy()
            sums = np.zeros((len(slot), 2), np.int64)
            if len(found) and len(slot):
                worth = np.stack([found.column(c).to_numpy() for c in ("best", "count")], 1)
                sums = _returned(found.column("rows")[0].as_py(), found.column("planes").combine_chunks(), worth)[slot]
            rows = documents.drop_columns(["block", "slot"])
            return rows.append_column("n_best", pa.array(sums[:, 0])).append_column("count_sum", pa.array(sums[:, 1]))

        made = self.documents.groupBy("block").cogroup(postings.groupBy("block")).applyInArrow(score, schema)
        return made.select(*[F.col(f"`{p}`").alias(c) for c, p in self.names.items()], *self.results)
