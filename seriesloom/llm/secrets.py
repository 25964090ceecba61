"""Secret scans over an incremental blob ledger.

Every text version is a blob, addressed by the SHA-256 of its bytes; a path (document) only
points at blobs. A store holds two Parquet tables:

- ``versions`` (doc_id, version, blob, source): every text that a path ever had, numbered from 1;
- ``ledger``: the (blob, rule version) pairs that have been scanned, with their findings (an empty
  list for a clean blob).

A scan computes the blobs of all paths, enters versions that are new, keeps the (blob, rule version)
pairs that the ledger lacks (anti join), fetches one copy of each such text, scans it, appends the
result, and joins findings back to all paths. A second run over the same texts scans nothing; a new
rule version scans anew. ``history`` joins findings to all versions, also to those that a path has no more.

Only hashes and ids are grouped: copies meet as addresses, and one text of each unseen
blob is shuffled. Blobs of very many paths are joined by broadcast, at most 1024 of them.

Defined cases: null text is the empty text; repeated rows are paths of their own, and one version; two
texts under one doc_id are two blobs and two versions; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import ship
from .common import scratch_path, skewed_join, staged, table, whole_row
from .spans import base_digest, told

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "private_key", "web_token", "host_token")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Beyond the base: PEM blocks, signed web tokens, and tokens with a host's prefix.
KEY_MARK = re.compile(r"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
#: What is left of a block without its END line: header lines, then the body.
KEY_REST = re.compile(r"(?:\r?\n[A-Za-z][A-Za-z0-9-]*+:[^\r\n]*+)*+[A-Za-z0-9+/=\s]*+")
WEB_START, WEB_PART = re.compile(r"\beyJ"), re.compile(r"[A-Za-z0-9_-]++")
WEB_TOKEN = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
HOST_TOKEN = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)")
RULES = (ASSIGN, ACCESS, HEX, KEY_MARK, KEY_REST, WEB_TOKEN, HOST_TOKEN)
RULE_VERSION = "2-" + hashlib.sha256("\n".join(r.pattern for r in RULES).encode()).hexdigest()[:12]
VERSIONS = "version long, blob string, source string"
LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Blocks from each BEGIN to the END line before any other BEGIN, whatever lies between."""
    marks = list(KEY_MARK.finditer(text))
    for n, m in enumerate(marks):
        if m[1] == "BEGIN":
            later = marks[n + 1] if n + 1 < len(marks) else None
            if later and later[1] == "END":
                yield m.start(), later.end()
            else:
                yield m.start(), KEY_REST.match(text, m.end(), later.start() if later else len(text)).end()


def _web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """As WEB_TOKEN.finditer, but linear: all starts in one run of characters end with it."""
    at = 0
    while start := WEB_START.search(text, at):
        if m := WEB_TOKEN.match(text, start.start()):
            yield m.span()
        at = (m or WEB_PART.match(text, start.start())).end()


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of one text, in code points, end exclusive."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of under 24 fails as a whole, so asking for 24 finds the same spans
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        out += [("private_key", a, z) for a, z in _private_keys(text)]
    if "eyJ" in text:
        out += [("web_token", a, z) for a, z in _web_tokens(text)]
    if "_" in text or "xox" in text:
        out += [("host_token", *m.span()) for m in HOST_TOKEN.finditer(text)]
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None  # rows that repeat each other come one after the other
    for b in batches:
        rows = []
        for blob, text in zip(b["blob"], b["text"], strict=True):
            if blob == last:
                continue
            last = blob
            found = find_secrets(text)
            kinds = [k for k, _, _ in found]
            rows.append((blob, RULE_VERSION, *(kinds.count(k) for k in BASE), base_digest(found, BASE), told(found, KINDS)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEDGER.split(", ")])


def blobs_of(docs: DataFrame) -> DataFrame:
    """(doc_id, blob) of every row."""
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table's rows; none if nothing was ever written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def read_ledger(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, f"{store}/ledger", LEDGER)


def read_versions(spark: SparkSession, store: str, kind: str = "long") -> DataFrame:
    return _read(spark, f"{store}/versions", f"doc_id {kind}, {VERSIONS}")


def _known(spark: SparkSession, store: str) -> DataFrame:
    """Findings of each blob under the rules of today."""
    # an executor that is lost may leave a blob twice, with one result
    return read_ledger(spark, store).where(F.col("rule_version") == RULE_VERSION).drop("rule_version").dropDuplicates(["blob"])


def enter_versions(paths: DataFrame, store: str, source: str) -> None:
    """Adds the (doc_id, blob) pairs that the store doesn't know, as the paths' next versions."""
    spark, kind = paths.sparkSession, paths.schema["doc_id"].dataType.simpleString()
    old = read_versions(spark, store, kind)
    same = F.col("n.doc_id").eqNullSafe(F.col("o.doc_id"))
    new = paths.select("doc_id", "blob").distinct().alias("n").join(old.alias("o"), same & (F.col("n.blob") == F.col("o.blob")), "left_anti")
    last = old.groupBy("doc_id").agg(F.max("version").alias("last")).alias("o")
    new = new.alias("n").join(last, same, "left").select("n.doc_id", "n.blob", F.coalesce("last", F.lit(0)).alias("last"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("blob"))
    new.select("doc_id", (F.col("last") + place).cast("long").alias("version"), "blob", F.lit(source).alias("source")).write.mode("append").parquet(f"{store}/versions")


def scan_documents(docs: DataFrame, store: str, source: str = "") -> DataFrame:
    """Findings of every path: (doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans).

    ``store`` is a folder that driver and executors share; its tables are read, extended by what
    is new in ``docs``, and read again. ``source`` says where these versions came from."""
    spark = docs.sparkSession
    ship(spark)
    paths = staged(blobs_of(docs), "paths")
    enter_versions(paths, store, source)
    seen = read_ledger(spark, store).where(F.col("rule_version") == RULE_VERSION).select("blob")
    counts = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("paths"))
    unseen = counts.join(seen, "blob", "left_anti")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # null ids are kept: the join key is null-safe
    # what is unseen grows with the texts: both sides are shuffled at every size
    mine = texts.alias("t").join(unseen.hint("merge").alias("u"), F.col("t.doc_id").eqNullSafe(F.col("u.doc_id"))).where(F.sha2(F.col("t.text"), 256) == F.col("u.blob"))
    found = mine.select("u.blob", "t.text").mapInPandas(_scan, LEDGER)
    found.write.mode("append").parquet(f"{store}/ledger")
    known = _known(spark, store).join(counts.select("blob", "paths"), "blob")
    return skewed_join(paths, known, "blob", "paths", paths.count()).drop("paths")


def history(spark: SparkSession, store: str, kind: str = "long") -> DataFrame:
    """Findings of every version of every path; null where today's rules have not met the blob yet."""
    return read_versions(spark, store, kind).join(_known(spark, store), "blob", "left")


def op2_secret_scan(spark: SparkSession, sf_dir: str, store: str | None = None) -> DataFrame:
    """Secrets of every document, through a store that lasts, or else one of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_documents(docs, store or scratch_path(spark, "secrets"), sf_dir)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")


def redact_secrets(docs: DataFrame, store: str, mask: str = "[SECRET]") -> DataFrame:
    """Documents with every found span replaced by ``mask``; columns stay as they are."""
    spark = docs.sparkSession
    told = scan_documents(docs.select("doc_id", "text"), store).where("spans <> ''")
    known = staged(told.groupBy("blob").agg(F.first("spans").alias("spans"), F.count("*").alias("paths")), "found")

    @F.pandas_udf("string")
    def masked(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if not s else _mask(t, s, mask) for t, s in zip(text, spans, strict=True)], dtype=object)

    # only the few documents with findings pass through Python; the others stay as scanned
    rows = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"), whole_row(docs).alias("row"))
    marked = skewed_join(rows, known, "blob", "paths", docs.count(), "merge")
    hit = marked.where("spans is not null").withColumn("masked", masked("row.text", "spans"))
    hit = hit.withColumn("row", F.col("row").withField("text", F.col("masked")))
    return marked.where("spans is null").select("row.*").unionByName(hit.select("row.*"))


def _mask(text: str, spans: str, mask: str) -> str:
    cuts = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",")))
    out, at, end = [], 0, 0
    for a, b in cuts:
        if a >= end:
            out += [text[at:a], mask]
        at = end = max(end, b)
    return "".join([*out, text[at:]])
