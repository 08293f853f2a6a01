"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by its content: a blob is the SHA-256 of a text. The ledger remembers which blob
was scanned by which version of which rule, and what was found. ``scan`` looks only at pairs of blob and rule version that
the ledger does not know, one text per blob however many paths and versions have it; ``spans_of`` joins the findings back
to all of them. Raising a rule's version, or adding a rule, scans every blob once for that rule and for no other.

Findings are places of matches in code points, leftmost and non-overlapping per rule. Spark's functions return matches and
the pieces between them, but no places; these are running sums over the lengths of both.

The ledger is two tables below one folder, both only appended to: ``findings`` first, then ``scanned``. A run that dies in
between scans its pairs again, and equal findings count once. One writer at a time.

Defined cases: a null text is the empty one. Rows may repeat, and one path may have any number of versions; a null path is a
path like others. Columns other than those named are neither read nor returned, whatever their names. An empty table leaves
the ledger as it is and gives no rows. Texts are scanned whole, however long (up to Spark's 2 GB for a string); the matches of one
text are summed up in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.sources.scratch import materialize


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` (0: the whole match) has at least ``least`` code points.

    ``needs``: a string that every match has, for a cheap look before the pattern's.
    """

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    needs: str = ""

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The base patterns. A run of one character class is maximal, so its least length can stand in the pattern.
# fmt: off
BASE = [
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
]
ADDED = [
    Rule("pem", 1, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", needs="eyJ"),
]
# fmt: on

_SCANNED = "blob binary, rules array<string>"
_FINDINGS = "blob binary, rule string, start long, end long"


def create(spark: SparkSession, ledger: str) -> str:
    """An empty ledger, unless there is one already."""
    for name, schema in (("findings", _FINDINGS), ("scanned", _SCANNED)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{ledger}/{name}")
    return ledger


def _read(spark: SparkSession, ledger: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{ledger}/{name}")


def _blob() -> F.Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def unseen(versions: DataFrame, ledger: str, rules: list[Rule]) -> DataFrame:
    """(blob, path, rules): the rules to run on each blob, and the least path that has it."""
    seen = _read(versions.sparkSession, ledger, "scanned", _SCANNED).groupBy("blob")
    seen = seen.agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    blobs = versions.groupBy(_blob().alias("blob")).agg(F.min("path").alias("path"))
    wanted = F.array(*[F.lit(rule.key) for rule in rules])
    left = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "path", left.alias("rules")).filter(F.size("rules") > 0)


def _lengths(strings: F.Column) -> F.Column:
    return F.transform(strings, lambda s: F.length(s))


def _cuts(rule: Rule) -> F.Column:
    """The lengths of the pieces before each match, of the matches, and of their groups; null without a match."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    whole, part = (_lengths(F.regexp_extract_all(text, pattern, F.lit(group))) for group in (0, rule.group))
    gaps = _lengths(F.split(text, rule.pattern, -1))
    cuts = F.arrays_zip(gaps.alias("gap"), whole.alias("size"), part.alias("part"))
    has = F.contains(text, F.lit(rule.needs)) & text.rlike(rule.pattern)
    return F.when(F.array_contains("rules", rule.key) & has, cuts)


def _places(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of (blob, text, rules)."""
    cuts = [F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.least).alias("least"), _cuts(rule).alias("cuts")) for rule in rules]
    hits = texts.select("blob", F.inline(F.array(*cuts))).filter("cuts IS NOT NULL")
    # Rows that repeat as a whole come twice; equal blobs have equal cuts.
    hits = hits.groupBy("blob", "rule", "least").agg(F.first("cuts").alias("cuts"))
    rows = hits.select("blob", "rule", "least", F.posexplode("cuts").alias("pos", "cut")).select("*", "cut.*")
    before = Window.partitionBy("blob", "rule", "least").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0)) + F.col("gap")
    found = rows.withColumn("start", start).filter("size IS NOT NULL AND part >= least")
    return found.select("blob", "rule", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).alias("end"))


def scan(versions: DataFrame, ledger: str, rules: list[Rule]) -> DataFrame:
    """Brings the ledger up to date with ``versions`` (path, text) and ``rules``; returns what was scanned for it.

    Texts are shuffled once, those of blobs with something to scan only.
    """
    versions = versions.select("path", "text")
    todo = materialize(unseen(versions, ledger, rules), "unseen-blobs")
    texts = versions.select("path", F.coalesce("text", F.lit("")).alias("text"), _blob().alias("blob"))
    same = (texts.blob == todo.blob) & texts.path.eqNullSafe(todo.path)
    chosen = texts.join(todo.hint("merge"), same).select(todo.blob, "text", "rules")
    _places(chosen, rules).write.mode("append").parquet(f"{ledger}/findings")
    todo.select("blob", "rules").write.mode("append").parquet(f"{ledger}/scanned")
    return todo


def spans_of(versions: DataFrame, ledger: str, rules: list[Rule]) -> DataFrame:
    """(path, spans) for each row of ``versions``: (start, kind, end) by start, then in the order of ``rules``; kind is the
    rule's number."""
    kinds = F.create_map(*[F.lit(x) for i, rule in enumerate(rules) for x in (rule.key, i)])
    found = _read(versions.sparkSession, ledger, "findings", _FINDINGS).distinct().withColumn("kind", kinds[F.col("rule")])
    spans = F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans")
    by_blob = found.filter("kind IS NOT NULL").groupBy("blob").agg(spans)
    rows = versions.select("path", _blob().alias("blob")).join(by_blob, "blob", "left")
    return rows.select("path", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def _told(spans: F.Column, rules: list[Rule]) -> F.Column:
    names = F.array(*[F.lit(rule.name) for rule in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_digests(docs: DataFrame, ledger: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``.

    The ledger first takes the base rules, then the added ones, as a rule set that grows would: the second run scans each blob
    for the new rules alone.
    """
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    rules = [*BASE, *ADDED]
    for known in (BASE, rules):
        scan(versions, ledger, known)
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{rule.name}") for k, rule in enumerate(BASE)
    ]
    digest = F.sha2(_told(base, rules).cast("binary"), 256).alias("base_sha256")
    return spans_of(versions, ledger, rules).select(F.col("path").alias("doc_id"), *counts, digest, _told(spans, rules).alias("spans"))
