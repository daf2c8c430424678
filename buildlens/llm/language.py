"""Language identification by compression.

For each language a dictionary of raw content is cut from a bounded sample of labelled
texts. A text is compressed block by block with every dictionary, and the language whose
dictionary leaves the fewest bytes wins. A narrow lead over the second is a rejection.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import per_task, record_batch, remainder, slices, table

UNKNOWN = "und"
# Bounds of the sample: texts per language, characters of each, languages (those with the
# most texts).
TEXTS, CHARS, LANGUAGES = 400, 512, 200
BLOCK, LEVEL = 4096, 3
MIN_MARGIN = 0.01

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
    ("rejected", pa.bool_()),
])
DDL = "doc_id long, lang_pred string, score double, rejected boolean"
_HAS_LETTER = "\\p{L}"


def fit(labelled: DataFrame, texts: int = TEXTS, chars: int = CHARS,
        languages: int = LANGUAGES) -> dict[str, bytes]:
    """A dictionary per language from ``text, lang``.

    Texts are chosen by their hash, copies count once, and of each comes one stretch at a
    place that its hash names. Rows without a language or a letter teach nothing; of an empty
    table nothing is learned. What the driver gathers is bounded by the three parameters.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(_HAS_LETTER)) \
        .select("lang", "text", F.xxhash64("text").alias("h"))
    # Different texts, since copies count once: a language that is mostly copies is learned too.
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("h", 0.03).alias("n")) \
        .orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return {}
    # Four times as many as wanted pass, so that enough are left where the hash is uneven.
    share = F.create_map(*(x for r in counts for x in
                           (F.lit(r.lang), F.lit(min(1.0, 4 * texts / max(1, r.n))))))
    unit = F.pmod(F.shiftrightunsigned("h", 11), F.lit(1 << 53)) / F.lit(float(1 << 53))
    at = F.pmod("h", F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    rows = (
        usable.filter(unit < share[F.col("lang")])
        .select("lang", "h", F.substring("text", at, F.lit(chars)).alias("piece"))
        .groupBy("lang", "h").agg(F.min("piece").alias("piece"))
        .collect()
    )
    chosen: dict[str, list] = {}
    for r in sorted(rows):
        chosen.setdefault(r.lang, []).append(r.piece)
    return {lang: "\n".join(pieces[:texts]).encode() for lang, pieces in sorted(chosen.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import regex
        import zstandard as z

        self.has_letter = regex.compile(_HAS_LETTER).search
        self.languages = sorted(dictionaries)
        self.compress = []
        for lang in self.languages:
            content = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compress.append(z.ZstdCompressor(
                level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False,
            ).compress)

    def classify(self, text: str | None) -> tuple[str, float]:
        """The language and the share by which it beats the second."""
        if not text or not self.languages or not self.has_letter(text):
            return UNKNOWN, 0.0
        data = text.encode()
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c(b)) for b in blocks) for c in self.compress]
        best = min(sizes)
        rest = sorted(sizes)[1:2] or [2 * best]
        return self.languages[sizes.index(best)], 1 - best / rest[0]


def predict(docs: DataFrame, dictionaries: dict[str, bytes],
            min_margin: float = MIN_MARGIN) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row, by its whole text.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if
    nothing was learned. Ties go to the first language by name, with score 0. ``und`` and
    scores below ``min_margin`` are rejected. Nothing is shuffled; repeated rows get the same
    answer, null ids stay, other columns are left out.
    """
    digest = hashlib.sha256(repr(sorted(dictionaries.items())).encode()).digest()
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for part in slices(batches):
            own = own or per_task(("language", digest), lambda: Classifier(sent.value))
            found = [own.classify(t) for t in part.column(1).to_pylist()]
            yield record_batch(SCHEMA, [
                part.column(0), [lang for lang, _ in found], [s for _, s in found],
                [lang == UNKNOWN or s < min_margin for lang, s in found]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DDL)


def recognised(docs: DataFrame, dictionaries: dict[str, bytes],
               min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows that are not rejected, with all their columns; a null ``lang`` is filled in."""
    digest = hashlib.sha256(repr(sorted(dictionaries.items())).encode()).digest()
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for part in slices(batches):
            own = own or per_task(("language", digest), lambda: Classifier(sent.value))
            found = [own.classify(t) for t in part.column(text_at).to_pylist()]
            keep = pa.array([lang != UNKNOWN and s >= min_margin for lang, s in found])
            filled = pc.coalesce(part.column(lang_at), pa.array([lang for lang, _ in found]))
            yield part.set_column(lang_at, part.schema.field(lang_at), filled).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may teach: not held out."""
    return docs.filter(remainder("doc_id", 3) != 1)


def op2_compression_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = predict(docs, fit(learnable(docs)))
    return found.select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred", "score", "rejected")
