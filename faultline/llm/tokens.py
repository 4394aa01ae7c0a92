"""Token counts of a SentencePiece BPE model, by distinct pre-token.

No piece of the model holds a space mark after another character, or a line end, so no merge
crosses the place before a run of spaces or around a line end.  Texts are cut there into
pre-tokens.  A task counts the pieces of each distinct pre-token once, joins the counts to the
pre-token frequencies of each text, and sums; ids of whole texts are never made.

The join is within a task, against counts kept from earlier batches: a shuffled table of
(text, pre-token, frequency) would be larger than the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import ship, slices

SPACE = "▁"
#: A run of spaces (or their mark) with what follows up to the next space or line end.
PRE_TOKEN = re.compile(f"[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+")


class PieceCounter:
    """Counts pieces; remembers at most ``memory`` pre-tokens of up to 64 characters."""

    def __init__(self, model_path: str, memory: int = 250_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        crossing = [p for p in pieces if SPACE in p.lstrip(SPACE) or "\n" in p]
        if crossing:
            raise ValueError(f"pieces cross pre-token borders: {crossing[:5]}")
        self.memory = memory
        self.known: dict[str, int] = {}

    def _learn(self, tokens: list[str]) -> dict[str, int]:
        """Pieces of pre-tokens.  The library puts a space mark before what it encodes; a
        pre-token that begins with a space leaves its own out, another one stands behind a line
        end, which is one piece after that mark."""
        asked, extra = [], []
        for t in tokens:
            spaced = t[0] == " " or t[0] == SPACE
            asked.append(t[1:] if spaced else "\n" + t)
            extra.append(0 if spaced else -2)
        made = self.model.encode(asked, num_threads=1)
        counts = {}
        for t, a, ids, e in zip(tokens, asked, made, extra):
            counts[t] = len(ids) + e if a else 1
        return counts

    def count(self, texts: list[str]) -> list[int]:
        frequencies = []
        for text in texts:
            # the mark that the library puts before a text
            found = Counter(PRE_TOKEN.findall(" " + text)) if text else Counter()
            frequencies.append((found, text.count("\n")))
        if len(self.known) > self.memory:
            self.known.clear()
        distinct = set().union(*(f for f, _ in frequencies)) if frequencies else set()
        new = self._learn([t for t in distinct if t not in self.known])
        local = {t: new[t] if t in new else self.known[t] for t in distinct}
        self.known.update((t, n) for t, n in new.items() if len(t) <= 64)
        return [sum(n * local[t] for t, n in found.items()) + ends for found, ends in frequencies]


def count_tokens(docs: DataFrame, model_path: str, memory: int = 250_000) -> DataFrame:
    """``docs`` plus ``n_bytes`` (UTF-8) and ``n_tokens``; columns of these names are replaced.

    A null text is empty, and an empty text has no tokens.  ``model_path`` names the model file
    on the executors.
    """
    ship(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_tokens").withColumn(
        "n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    )
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_path, memory)
        for batch in batches:
            column = batch.column("text")
            counts: list[int] = []
            for first, last in slices(column):
                texts = [t or "" for t in column.slice(first, last - first).to_pylist()]
                counts.extend(counter.count(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64())], names=schema.names
            )

    return docs.mapInArrow(run, schema)
