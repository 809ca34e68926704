"""Operator 6: secret scans with an incremental blob ledger.

Every version of a document is addressed by the SHA-256 of its text.  A ledger
table holds, for each (blob, rule version) ever scanned, the spans found, also
when there are none.  A run scans only blobs that the ledger lacks for the
present rule version, each once however many paths hold it, appends them, and
joins the findings back to all paths.  A new rule version scans every blob
anew; old entries stay.

Rules: assignments of passwords, secrets, tokens and API keys; access key ids;
long hexadecimal strings; PEM private-key headers (an addition of this
operator).  Spans are code points of the whole match, end exclusive.

Defined results: a null text is the empty blob; repeated rows each get their
own result row.  One run is one writer of its ledger: the entries of a failed
run may be appended again by the next, and equal entries count once.  An empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_if_null, save, scratch_dir

RULE_VERSION = "2"
# The base rules' patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the leftmost longest runs, short ones left out
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
KINDS = ("assign", "access", "hex", "pem")
BASE = KINDS[:3]
#: Unseen blobs (digests of 64 characters) that are broadcast at most.
BROADCAST_BLOBS = 100000


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all findings, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        out += [(m.start(), 3, m.end()) for m in PEM.finditer(text)]
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["blob", "spans"])


LEDGER_SCHEMA = "blob string, spans array<struct<kind:string,start:bigint,end:bigint>>, rule_version string"


def new_ledger(spark: SparkSession, path: str | None = None) -> str:
    """The path of an empty ledger, in the shared folder unless given."""
    path = path or f"{scratch_dir(spark)}/parley-ledger-{uuid.uuid4().hex}"
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("ignore").parquet(path)
    return path


def read_ledger(spark: SparkSession, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger).filter(F.col("rule_version") == rule_version)


def scan_unseen(docs: DataFrame, ledger: str, text_col: str = "text", rule_version: str = RULE_VERSION) -> None:
    """Scan each blob of ``docs`` that the ledger lacks and append the results.
    Which blobs are unseen is found on digests alone; only their texts move."""
    text = empty_if_null(text_col)
    blob = F.sha2(text.cast("binary"), 256)
    seen = read_ledger(docs.sparkSession, ledger, rule_version).select("blob")
    unseen = save(docs.select(blob.alias("blob")).distinct().join(seen, "blob", "left_anti"))
    rows = docs.select(blob.alias("blob"), text.alias("text"))
    if unseen.count() <= BROADCAST_BLOBS:
        once = rows.join(F.broadcast(unseen), "blob").groupBy("blob").agg(F.first("text").alias("text"))
    else:  # copies are combined on the map side before the join
        once = rows.groupBy("blob").agg(F.first("text").alias("text")).join(unseen, "blob")
    (once.mapInArrow(_scan, LEDGER_SCHEMA.rpartition(",")[0])
     .withColumn("rule_version", F.lit(rule_version)).write.mode("append").parquet(ledger))


def find_secrets(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 rule_version: str = RULE_VERSION) -> DataFrame:
    """(id, blob, spans) for every path, after bringing the ledger up to date."""
    spark = docs.sparkSession
    ledger = new_ledger(spark, ledger)
    scan_unseen(docs, ledger, text_col, rule_version)
    # Only blobs with findings are joined; all others have an empty list.
    found = (read_ledger(spark, ledger, rule_version).filter(F.size("spans") > 0)
             .groupBy("blob").agg(F.first("spans").alias("__spans")))
    paths = docs.select(F.col(id_col), F.sha2(empty_if_null(text_col).cast("binary"), 256).alias("blob"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return paths.join(found, "blob", "left").select(id_col, "blob", F.coalesce("__spans", none).alias("spans"))


def listed(spans):
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


# The texts between the matches and the matches themselves, in turn, give their places.
ORACLE = r"""
WITH rules(kind, nr, pattern, part, least) AS (VALUES
  ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 16), ('hex', 2, '[0-9a-f]+', 0, 32),
  ('pem', 3, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----', 0, 0)),
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
met AS (
  SELECT row, kind, nr, least, regexp_split_to_array(text, pattern) AS gaps, regexp_extract_all(text, pattern) AS hits,
    regexp_extract_all(text, pattern, 2) AS values FROM docs, rules WHERE kind = 'assign'
  UNION ALL SELECT row, kind, nr, least, regexp_split_to_array(text, pattern), regexp_extract_all(text, pattern),
    regexp_extract_all(text, pattern) FROM docs, rules WHERE kind <> 'assign'),
each AS (SELECT row, kind, nr, least, unnest(gaps[:len(hits)]) AS gap, unnest(hits) AS hit, unnest(values) AS value,
  generate_subscripts(hits, 1) AS i FROM met),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row, kind ORDER BY i) AS stop FROM each),
spans AS (SELECT row, kind, nr, (stop - length(hit))::BIGINT AS start, kind || ':' || (stop - length(hit))::BIGINT || ':' || stop::BIGINT AS span
  FROM placed WHERE length(value) >= least),
listed AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, nr) FILTER (kind <> 'pem') AS base,
  string_agg(span, ',' ORDER BY start, nr) AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN listed USING (row)
"""
