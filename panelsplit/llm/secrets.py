"""Secret scan by linking the parts of multipart credentials.

A regular expression finds three kinds of self-evident secrets (``BASE_KINDS``). Other parts of a
credential say little alone: an account name, a key in base64, the address of a service. They are
*weak* and are reported only when a complementary part lies near: the parts are joined as intervals,
within a scope (one document, at most ``reach`` code points between two parts), and a weak part
stays if the scope holds an identifier and a secret, or an endpoint and a secret.

Edge cases: a null text is an empty one and has no spans; rows that share a doc_id keep spans of
their own (the row key is doc_id and text hash; equal rows get equal spans); a null doc_id is a
value like others; extra columns are ignored; an empty table gives an empty result. Texts are
scanned whole.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsplit.llm.common import row_key, store, table

#: Kinds that count by themselves, in the order in which equal starts are listed.
BASE_KINDS = ("assign", "access", "hex")
#: Kinds that count only next to a complementary part: an identifier, a secret, an endpoint.
WEAK_KINDS = ("weak_id", "weak_secret", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS
#: What each kind contributes to a credential.
PART_OF = {"assign": "secret", "access": "identifier", "hex": "secret",
           "weak_id": "identifier", "weak_secret": "secret", "endpoint": "endpoint"}
COMPLEMENTS = {"identifier": ("secret",), "endpoint": ("secret",), "secret": ("identifier", "endpoint")}

_ASSIGN = re.compile(
    rb"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    rb"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ASSIGN_CUES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_WEAK_ID = re.compile(rb"(?:user(?:_?name|_?id)?|login(?:_?name|_?id)?|account(?:_?name|_?id)?|client_?(?:id|name)|access_?key_?(?:id|name))[\"']?\x20*[:=]\x20*[\"']?([a-z0-9._@-]{3,})")
_WEAK_ID_CUES = (b"user", b"login", b"account", b"client", b"access")
_ENDPOINT = re.compile(rb"(?:https?|s3|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20\"'<>]+")
#: 24 characters of base64 or more with both cases and a digit, or 40 (the form of many access secrets) with a sign instead of the digit.
_WEAK_SECRET = re.compile(rb"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9+/])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])"
                          rb"(?:[A-Za-z0-9+/]{40}|(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{24,})={0,2}(?![A-Za-z0-9+/=])")
_LONG_RUN = re.compile(rb"[A-Za-z0-9+/]{24}")


def parts_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every base and weak part of one text, in code points, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    found = []
    if any(cue in low for cue in _ASSIGN_CUES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(raw) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in _ACCESS.finditer(raw) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(raw)]
    if any(cue in low for cue in _WEAK_ID_CUES):
        found += [("weak_id", *m.span(1)) for m in _WEAK_ID.finditer(low)]
    if b"://" in low:
        found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(low)]
    if _LONG_RUN.search(raw):
        found += [("weak_secret", *m.span()) for m in _WEAK_SECRET.finditer(raw)]
    if found and len(raw) != len(text):  # bytes to code points, for the few ends found
        at = sorted({p for _, a, b in found for p in (a, b)})
        point, last, n = {}, 0, 0
        for p in at:
            n += len(raw[last:p].decode("utf-8", "surrogatepass"))
            point[p], last = n, p
        found = [(k, point[a], point[b]) for k, a, b in found]
    return found


_PARTS = "doc_id bigint, row_key bigint, kind string, start int, end int"


def find_parts(docs: DataFrame) -> DataFrame:
    """One row per part of a credential: doc_id, row_key, kind, start, end."""
    def scan(batches):
        for batch in batches:
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = [(i, k, *part) for i, k, t in zip(ids, keys, texts) if t for part in parts_of(t)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()))],
                names=["doc_id", "row_key", "kind", "start", "end"])

    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(scan, _PARTS)


def linked_spans(parts: DataFrame, reach: int = 400) -> DataFrame:
    """Base parts, and those weak parts with a complementary part at most ``reach`` code points away.

    The interval join runs on (document, bin of ``reach``): a part is looked up in its own bin and the
    neighbouring ones, and only whether there is a partner matters (left semi join), so the result
    never outgrows the parts. Bins without a partner are never compared.
    """
    parts = parts.distinct().withColumn("role", F.create_map(*[F.lit(x) for kv in PART_OF.items() for x in kv])[F.col("kind")])
    base = parts.where(F.col("kind").isin(*BASE_KINDS))
    weak = parts.where(F.col("kind").isin(*WEAK_KINDS))
    pairs = F.create_map(*[x for role, others in COMPLEMENTS.items() for x in (F.lit(role), F.array(*map(F.lit, others)))])
    wanted = (weak.withColumn("wants", F.explode(pairs[F.col("role")]))
              .withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach)))))
    offered = (parts.select("doc_id", "row_key", F.col("role").alias("wants"), F.col("start").alias("p_start"), F.col("end").alias("p_end"),
                            F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))).alias("bin")))
    near = wanted.join(
        offered,
        wanted.doc_id.eqNullSafe(offered.doc_id) & (wanted.row_key == offered.row_key) & (wanted.wants == offered.wants)
        & (wanted.bin == offered.bin) & (offered.p_start <= wanted.end + reach) & (offered.p_end >= wanted.start - reach),
        "left_semi")
    return base.unionByName(near.select(*base.columns).distinct()).drop("role")


def scan_secrets(docs: DataFrame, reach: int = 400) -> DataFrame:
    """Spans of secrets: doc_id, row_key, kind, start, end, weak. The parts are stored: the texts are scanned once."""
    return linked_spans(store(find_parts(docs), "secret-parts"), reach).withColumn("weak", F.col("kind").isin(*WEAK_KINDS))


def span_digest(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, their digest, and all spans written out."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    per_doc = spans.groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end"))).alias("spans"))

    def listed(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    rows = docs.select("doc_id", row_key().alias("row_key"))
    joined = rows.alias("d").join(per_doc.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("d.row_key").eqNullSafe(F.col("s.row_key")), "left")
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return (joined.select(F.col("d.doc_id").alias("doc_id"), F.coalesce("spans", empty).alias("spans"))
            .select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
                    F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")))


def mask_secrets(docs: DataFrame, reach: int = 400, mask: str = "<secret>") -> DataFrame:
    """``docs`` with every reported span replaced by ``mask``; n_chars follows the text.

    Overlapping spans are merged first. Only rows that have spans are rewritten.
    """
    spans = scan_secrets(docs, reach).groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    @F.pandas_udf("string")
    def cut(texts, spans_of):
        def one(text, spans):
            out, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    out += [text[at:s["start"]], mask]
                at = max(at, s["end"])
            return "".join(out) + text[at:]
        return pd.Series([t if s is None else one(t, s) for t, s in zip(texts, spans_of)], dtype=object)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("d_id"), row_key().alias("d_key"))
    joined = rows.join(spans, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_key") == F.col("row_key")), "left")
    text = F.col("doc.text")
    masked = joined.withColumn("masked", cut(text, "spans"))
    changed = {"text": F.col("masked"), "n_chars": F.when(F.col("spans").isNull(), F.col("doc.n_chars")).otherwise(F.length("masked"))
               if "n_chars" in docs.columns else None}
    return masked.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return span_digest(docs, store(scan_secrets(docs), "secret-spans"))
