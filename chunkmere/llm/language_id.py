"""Operator 8: language ID by compression.

A language's model is a raw-content Zstandard dictionary: a bounded sample of its labelled texts.
A text is cut into blocks, each is compressed with every language's dictionary, and the language
whose blocks take the fewest bytes in all is chosen.  When the runner-up needs hardly more, the
margin is narrow and the text is rejected.

Texts are lower-cased and runs of anything but letters become one space before they are compressed,
for samples and predictions alike; every letter of the text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, cut, release_worker

#: The sample: at most so many texts of a language, so many bytes of each from a place that its hash sets, and of all.
SAMPLE_TEXTS, SAMPLE_TEXT_BYTES, DICT_BYTES = 256, 2048, 112 << 10
SALTS = 64
#: Level 5 is the first whose match finder is thorough enough for dictionaries of this size.
LEVEL, BLOCK_BYTES = 5, 2048
#: The runner-up must need this share more bytes, else the text is rejected; a lead of this share halves the runner-up's weight in the score.
NARROW, HALVING = 0.002, 0.02
UNKNOWN = "und"
RESULT = "lang_pred string, score double, margin double, rejected boolean"
PARTS = "lang string, k int, part string"

_REST = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str) -> bytes:
    return f" {_REST.sub(' ', text.lower())} ".encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, each as long as its sample; no language's length bears on another's."""

    dictionaries: dict[str, bytes]

    def coders(self) -> dict[str, zstandard.ZstdCompressor]:
        """A shorter dictionary is repeated to the longest's length, as the coder's settings and the cost of distances depend on it."""
        out = {}
        most = max(map(len, self.dictionaries.values()), default=0)
        for lang, raw in sorted(self.dictionaries.items()):
            raw = (raw * (most // max(1, len(raw)) + 1))[:most]
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        return out


def classify(coders: dict[str, zstandard.ZstdCompressor], text: str | None) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected); ties go to the first language by name."""
    if not coders or text is None or not _LETTER.search(text):
        return UNKNOWN, 0.0, 0.0, True
    data = letters(text)
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in coders.items())
    best = sizes[0][0]
    margin = (sizes[1][0] - best) / best if len(sizes) > 1 else 1.0
    weights = sum(2.0 ** (-(s - best) / (best * HALVING)) for s, _ in sizes)
    return sizes[0][1], 1.0 / weights, margin, margin < NARROW


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of the sample: a task passes on the first copy that it meets, so copies aren't shuffled."""
    met: set[tuple[str, int]] = set()
    for b in batches:
        keep = []
        for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if key not in met:
                met.add(key)
                keep.append(i)
        yield b.take(pa.array(keep, pa.int64()))


def _joined(group: pa.Table) -> pa.Table:
    """One language's sample as bytes, in order of ``k``."""
    group = group.sort_by("k")
    raw = b"".join(map(letters, group["part"].to_pylist()))[:DICT_BYTES]
    return pa.table({"lang": group["lang"].slice(0, 1), "raw": pa.array([raw], pa.binary())})


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from rows with a language; those without a text, letters or language are passed over.

    Every language is learned, however few rows it has.  Its sample is the distinct texts with the
    smallest hashes, so it depends neither on how many copies they have nor on how rows are dealt to
    partitions; equal texts count once.
    """
    text = F.col(text_col)
    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("h")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h"))
    # A language's hashes are first narrowed in SALTS groups apart, so that no task sorts all of a frequent one's.
    near = rows.select("lang", "h").distinct().withColumn("salt", F.pmod("h", F.lit(SALTS)))
    near = near.withColumn("k", first("lang", "salt")).filter(F.col("k") <= SAMPLE_TEXTS).select("lang", "h")
    near = cut(near.withColumn("k", first("lang")).filter(F.col("k") <= SAMPLE_TEXTS))
    if near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        near = F.broadcast(near)
    start = F.expr(f"1 + pmod(shiftright(h, 20), greatest(1, length(text) - {SAMPLE_TEXT_BYTES}))").cast("int")
    parts = rows.join(near, ["lang", "h"]).select("lang", "k", F.substring("text", start, F.lit(SAMPLE_TEXT_BYTES)).alias("part"))
    sample = parts.mapInArrow(_first_copies, PARTS).dropDuplicates(["lang", "k"])
    return LanguageModel({r["lang"]: bytes(r["raw"]) for r in sample.groupBy("lang").applyInArrow(_joined, "lang string, raw binary").collect()})


def predict(model: LanguageModel, text: str | Column = "text") -> Column:
    """A struct column ``lang_pred, score, margin, rejected`` of whole texts."""

    @F.pandas_udf(RESULT)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release_worker()
        coders = model.coders()
        for s in texts:
            yield pd.DataFrame([classify(coders, x) for x in s], columns=["lang_pred", "score", "margin", "rejected"]).astype({"score": float, "margin": float, "rejected": bool, "lang_pred": object})

    return run(F.col(text) if isinstance(text, str) else text)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, margin, rejected`` instead of any columns of these names.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if
    the model has learned no language.  With one learned language the margin is 1.  Copies and
    repeated rows get equal results; an empty table stays empty.
    """
    names = ["lang_pred", "score", "margin", "rejected"]
    held = docs.withColumn("__lang_id", predict(model, text_col))
    return held.select(*(docs[c] for c in docs.columns if c not in names), *(F.col(f"__lang_id.{n}").alias(n) for n in names))


def drop_rejected(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they were, without the rows that the model rejects."""
    return docs.filter(~predict(model, text_col)["rejected"])
