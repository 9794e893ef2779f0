"""Token counts of whole texts from two tiers of pre-token lengths.

A pre-token is a word with the spaces before it. Merges never reach from a word
into the next, because no piece of the vocabulary does (checked against the
vocabulary when it is read), so the tokens of a text are the sum over its
pre-tokens.

* First tier: the ``TABLE_ROWS`` commonest pre-tokens of the whole corpus with
  their lengths in tokens, packed into three blocks of bytes and broadcast.
* Second tier: pre-tokens not in it are encoded, a batch of texts at a time, and
  their lengths kept in a cache of the Python worker, which lives from task to
  task. Very long ones are not kept and a full cache is emptied, so its size is
  bounded.

No pre-token is shuffled: every task sums up its texts into one row of at most
``SUMMARY_ROWS`` pre-tokens (a full counter drops its rarest), and these rows are
merged in two steps of about sqrt(tasks) rows each. The table only saves
encoding; any table gives the same counts.

Nulls and odd rows: a null or empty text has 0 bytes and 0 tokens; strings of
special tokens are ordinary text; a repeated row is counted again; a null
``doc_id`` stays null; very long texts and pre-tokens are encoded whole; an empty
table gives no rows; other columns of the table are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, filterfalse, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import bound_batches, release_memory, table

LIMIT = 4096
TABLE_ROWS = 65_536
SUMMARY_ROWS = 16_384
#: Distinct pre-tokens that a task counts before it drops the rarest.
COUNTER_ROWS = 524_288
#: Second tier: entries of a worker's cache, code points of a pre-token kept there.
CACHE_ROWS = 262_144
CACHE_LENGTH = 64
SUMMARY = "slot long, pre_tokens array<string>, counts array<long>"

SPACE = "▁"  # how the vocabulary writes a space
PRE_TOKEN = re.compile(" *[^ ]+| +")


class Vocabulary:
    """One sentencepiece file: the pre-tokens of a text and their lengths.

    Pre-tokens go by what follows their first space: nearly all have one space,
    and their keys are then plain words.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        spec, kinds = model.ModelProto(), model.ModelProto.SentencePiece
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != model.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback or norm.precompiled_charsmap:
            raise ValueError("counts need a byte-fallback BPE vocabulary without normalisation")
        if norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("counts need a vocabulary that keeps every space and starts texts with one")
        if any(len(PRE_TOKEN.findall(p.piece.replace(SPACE, " "))) > 1 for p in spec.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)):
            raise ValueError("a piece of the vocabulary reaches from a word into the next")
        self._encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        self._cache: dict[str, int] = {}

    @staticmethod
    def split(text: str | None) -> list[str]:
        """The keys of the pre-tokens of ``text``."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [p[1:] for p in PRE_TOKEN.findall(" " + text)]
        return text.split(" ")

    def lengths(self, keys: list[str]) -> list[int]:
        # a text starts with a space of its own, so a key's text is its pre-token; an empty key is one space
        return [len(ids) if key else 1 for key, ids in zip(keys, self._encode(keys, num_threads=1), strict=True)]

    def count(self, texts: list[list[str]], known: dict[str, int]) -> list[int]:
        """Tokens of texts given by their keys; ``known`` is the first tier."""
        rare = [list(filterfalse(known.__contains__, keys)) for keys in texts]
        cache = self._cache
        unseen = list(set(chain.from_iterable(rare)) - cache.keys())
        cache.update(zip(unseen, self.lengths(unseen), strict=True))
        out = [sum(map(known.get, keys, repeat(0))) + sum(map(cache.__getitem__, r)) for keys, r in zip(texts, rare, strict=True)]
        for key in unseen:
            if len(key) > CACHE_LENGTH:
                del cache[key]
        if len(cache) > CACHE_ROWS:
            cache.clear()
        return out


_of_worker: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """This worker's vocabulary of a file, read once."""
    if path not in _of_worker:
        _of_worker[path] = Vocabulary(path)
    return _of_worker[path]


def _commonest(counts: Counter, rows: int) -> Counter:
    """At most ``rows`` of the commonest short pre-tokens; of those tied at the
    end, all or none, so that the choice does not depend on their order."""
    if len(counts) > rows:
        n = np.fromiter(counts.values(), np.int64, len(counts))
        bar = np.partition(n, -rows - 1)[-rows - 1]
        counts = {key: k for key, k in counts.items() if k > bar}
    return Counter({key: k for key, k in counts.items() if len(key) <= CACHE_LENGTH})


def _summary(counts: Counter, slot: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))],
                                      ["slot", "pre_tokens", "counts"])


def frequent_pre_tokens(docs: DataFrame, rows: int = TABLE_ROWS, summary_rows: int = SUMMARY_ROWS, counter_rows: int = COUNTER_ROWS) -> list[str]:
    """The keys of about the ``rows`` commonest pre-tokens of all texts."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            counts.update(chain.from_iterable(map(Vocabulary.split, batch.column(0).to_pylist())))
            if len(counts) > counter_rows:
                counts = _commonest(counts, counter_rows // 8)
        if counts:
            yield _summary(_commonest(counts, summary_rows), TaskContext.get().partitionId())
        release_memory()

    def merge(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for t in tables:
            for names, values in zip(t.column("pre_tokens"), t.column("counts"), strict=True):
                for name, n in zip(names.as_py(), values.as_py(), strict=True):
                    counts[name] += n
                if len(counts) > max(counter_rows, 2 * rows):
                    counts = _commonest(counts, max(counter_rows // 8, rows))
        yield _summary(_commonest(counts, rows), 0)

    texts = docs.select("text").where(F.col("text").isNotNull())
    width = max(1, math.isqrt(texts.rdd.getNumPartitions()))
    per_task = texts.mapInArrow(summarise, SUMMARY)
    merged = per_task.withColumn("slot", F.col("slot") % width).groupBy("slot").applyInArrow(merge, SUMMARY).groupBy("slot").applyInArrow(merge, SUMMARY)
    top = merged.select("pre_tokens").first()
    return top["pre_tokens"] if top else []


def _pack(keys: list[str], lengths: list[int]) -> tuple[bytes, bytes, bytes]:
    """The first tier in three blocks: the keys' bytes, their sizes, their lengths
    in tokens (two bytes each: keys have at most ``CACHE_LENGTH`` code points)."""
    raw = [key.encode() for key in keys]
    return b"".join(raw), np.array(list(map(len, raw)), "<u2").tobytes(), np.array(lengths, "<u2").tobytes()


def _unpack(text: bytes, sizes: bytes, lengths: bytes) -> dict[str, int]:
    ends = np.cumsum(np.frombuffer(sizes, "<u2"), dtype=np.int64).tolist()
    return {text[a:b].decode(): n for a, b, n in zip([0, *ends], ends, np.frombuffer(lengths, "<u2").tolist())}


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT, rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id,
    text) for the sentencepiece file at ``model``."""
    bound_batches(docs.sparkSession)
    frequent = frequent_pre_tokens(docs, rows)
    table_of = docs.sparkSession.sparkContext.broadcast(_pack(frequent, vocabulary(model).lengths(frequent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = vocabulary(model), _unpack(*table_of.value)
        for batch in batches:
            n = words.count([words.split(text) for text in batch.column("text").to_pylist()], known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        release_memory()

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", size.alias("n_bytes")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), model_path())
