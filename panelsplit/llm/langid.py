"""Language identification by compression against one dictionary a language.

Letters are lower-cased and all else becomes a space; the text is compressed with each language's
zstandard raw-content dictionary, and the language that needs the fewest bytes wins. Sizes that lie
close say little: the score weighs the sizes (a byte halves the odds) with the languages' shares of the
training rows, and ``accepted`` rejects a narrow margin.

The fit draws at most ``rows_per_language`` rows a language by a hash of their id, and at most
a piece of each (``piece_chars`` code points, or more where the language has few rows, from a place drawn
by hash) until the dictionary holds ``dictionary_bytes``; shares are counted over all training rows. Prediction compresses whole texts.

Edge cases: a text that is null or has no letter gets ``und`` with score 0; without any training row
every text is ``und``; a null or empty lang is not learned; equal rows get equal answers; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsplit.llm.common import id_remainder, table

#: ASCII other than letters becomes a space; bytes of other characters stay.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def _folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit_languages(training: DataFrame, rows_per_language: int = 600, piece_chars: int = 400, dictionary_bytes: int = 128 << 10) -> dict[str, tuple[bytes, float]]:
    """Dictionary and share of the rows of every lang value in ``training`` (doc_id, text, lang)."""
    rows = training.where(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    if not counts:
        return {}
    chars = {lang: max(piece_chars, dictionary_bytes // min(n, rows_per_language)) for lang, n in counts.items()}
    size = F.create_map(*[F.lit(x) for kv in chars.items() for x in kv])[F.col("lang")]
    room = F.greatest(F.length("text") - size, F.lit(0))
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit("piece")), room + 1) + 1).cast("int"), size)
    # The piece is cut before the rows are ranked: texts don't travel.
    ranked = rows.select("doc_id", "lang", piece.alias("piece")).withColumn("nth", F.row_number().over(order))
    pieces = ranked.where(F.col("nth") <= rows_per_language).select("lang", "nth", "piece").collect()
    content: dict[str, list[bytes]] = {}
    for r in sorted(pieces, key=lambda r: (r["lang"], r["nth"])):
        content.setdefault(r["lang"], []).append(b" ".join(_folded(r["piece"]).split()))
    total = sum(counts.values())
    return {lang: (b" ".join(parts)[:dictionary_bytes], counts[lang] / total) for lang, parts in content.items()}


def predict_languages(docs: DataFrame, model: dict[str, tuple[bytes, float]], *keep: str | Column, level: int = 5, least_score: float = 0.6) -> DataFrame:
    """The columns ``keep``, lang_pred, score and accepted (the margin is wide enough) for every row."""
    rows = docs.select(*keep, "text")
    kept = rows.drop("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "lang_pred string, score double, accepted boolean"])
    names = sorted(model)
    shares = np.log(np.array([model[n][1] for n in names])) if names else None

    def run(batches):
        compressors = []
        for n in names:
            d = zstandard.ZstdCompressionDict(model[n][0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            compressors.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

        def one(text):
            if not names or not text or not _has_letter(text):
                return "und", 0.0, False
            raw = _folded(text)
            odds = shares - np.log(2) * np.array([len(c.compress(raw)) for c in compressors])
            odds = np.exp(odds - odds.max())
            best = int(odds.argmax())
            score = float(odds[best] / odds.sum())
            return names[best], score, score >= least_score

        for batch in batches:
            n = batch.num_columns - 1
            found = [one(t) for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                names=batch.schema.names[:n] + ["lang_pred", "score", "accepted"])

    return rows.mapInArrow(run, schema)


#: Rows with this remainder of crc32 modulo 3 are held out.
HELD_OUT = 1


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(id_remainder("doc_id", 3) != HELD_OUT))
    held_out = F.coalesce(id_remainder("doc_id", 3) == HELD_OUT, F.lit(False)).alias("held_out")
    return predict_languages(docs, model, "doc_id", held_out)
