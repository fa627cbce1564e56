"""Secret scan over an incremental ledger of blobs.

Every version of a text is addressed by its content. Only pairs of a blob and a rule version
that the ledger has not seen are scanned, each blob once however many documents hold it; findings
are kept by blob and joined back to every document that has it. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import full_text, new_path, temporary, written


@dataclass(frozen=True)
class SecretRule:
    """``value``: the group whose length must reach ``least``, else the match is dropped.

    ``probe`` is a pattern that every text with a match that stays contains.
    """

    kind: str
    version: int
    pattern: str
    value: int
    least: int
    probe: str


_NAME = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"

#: In the order in which kinds are listed.
RULES = (
    SecretRule("assign", 1, _NAME + r"([A-Za-z0-9+/_.=-]+)", 2, 6, _NAME + r"[A-Za-z0-9+/_.=-]{6}"),
    SecretRule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    SecretRule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)


class BlobLedger:
    """``scanned(blob, kind, version)`` and ``findings(blob, kind, version, spans)`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "blob-ledger")
        self._make("scanned", "blob binary, kind string, version int")
        self._make("findings", "blob binary, kind string, version int, spans array<struct<start:int,end:int>>")

    def _make(self, name: str, schema: str) -> None:
        empty = self.spark.createDataFrame([], schema)
        empty.write.mode("append").parquet(f"{self.path}/{name}")
        setattr(self, f"_{name}", empty.schema)

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(self._scanned).parquet(f"{self.path}/scanned")

    def findings(self) -> DataFrame:
        return self.spark.read.schema(self._findings).parquet(f"{self.path}/findings")

    def append(self, scanned: DataFrame, findings: DataFrame) -> None:
        """Findings first: a run that dies between the two scans those blobs again, and ``scan`` drops repeats."""
        findings.write.mode("append").parquet(f"{self.path}/findings")
        scanned.write.mode("append").parquet(f"{self.path}/scanned")


def blob_address(column: str = "text") -> Column:
    return F.unhex(F.sha2(full_text(column), 256))


#: Matches whose ends are added up together, see ``_scan``.
_TOGETHER = 256


def _pieces(text: Column, rule: SecretRule) -> Column:
    """For each match in order: code points before it since the last match, its own, its value's."""
    gaps = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value))
    return F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["value"]).alias("value")),
    )


def _running(xs: Column) -> Column:
    return F.aggregate(xs, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))


def _scan(blobs: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """Findings of ``blobs`` (``blob, kinds, text``): one row per blob and kind that has any.

    No row meets another: where matches end is added up inside the row, in groups and then over the groups, so that each of very
    many matches costs little more. Pieces and groups are columns of their own, which are made once.
    """
    text = F.col("text")
    found = F.array(
        *[
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
                     F.when(F.array_contains("kinds", r.kind) & text.rlike(r.probe), _pieces(text, r)).alias("pieces"))
            for r in rules
        ]
    )
    each = blobs.select("blob", F.explode(found).alias("f")).where("size(f.pieces) > 0").select("blob", "f.*")
    starts = F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / _TOGETHER).cast("int"))
    inside = F.transform(starts, lambda g: _running(F.transform(F.slice("pieces", g * _TOGETHER + 1, _TOGETHER), lambda x: x["gap"] + x["hit"])))
    totals = _running(F.transform("inside", lambda xs: F.get(xs, F.size(xs) - 1)))
    ends = F.flatten(F.zip_with("inside", F.slice(F.concat(F.array(F.lit(0)), totals), 1, F.size("inside")), lambda xs, before: F.transform(xs, lambda x: x + before)))
    span = F.zip_with("pieces", "ends", lambda x, end: F.when(x["value"] >= F.col("least"), F.struct((end - x["hit"]).alias("start"), end.alias("end"))))
    spans = F.filter(span, lambda s: s.isNotNull())
    return each.withColumn("inside", inside).withColumn("ends", ends).select("blob", "kind", "version", spans.alias("spans")).where("size(spans) > 0")


def _by_blob(docs: DataFrame, ledger: BlobLedger, rules: tuple[SecretRule, ...]) -> tuple[DataFrame, DataFrame]:
    """Scans what the ledger lacks; gives ``doc_id, blob`` of every row, and ``blob, spans`` of blobs with findings."""
    spark = docs.sparkSession
    versions = spark.createDataFrame([(r.kind, r.version, i) for i, r in enumerate(rules)], "kind string, version int, rank int")
    addressed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"), blob_address().alias("blob"))
    paths = written(addressed.select("doc_id", "blob"), "paths")
    # Pre-aggregated: one row a blob, whatever the number of its copies.
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    each = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])).alias("r")
    pairs = blobs.select("blob", "doc_id", each).select("blob", "doc_id", "r.kind", "r.version")
    # Of the ledger only what is about these blobs: a small batch is sent to where the ledger lies, which is not shuffled.
    met = paths.select("blob").distinct()
    scanned = ledger.scanned().join(met, "blob", "left_semi")
    unseen = written(pairs.join(scanned, ["blob", "kind", "version"], "left_anti"), "unseen")
    due = unseen.groupBy("blob", "doc_id").agg(F.collect_set("kind").alias("kinds"))  # as many kinds as rules, at most
    # Keyed by document and blob, so copies do not meet in one task; the narrow side is hashed, texts are not sorted.
    texts = addressed.alias("d").join(
        due.alias("u").hint("shuffle_hash"), F.col("d.doc_id").eqNullSafe(F.col("u.doc_id")) & (F.col("d.blob") == F.col("u.blob"))
    ).select("u.blob", "kinds", "text")
    if not paths.groupBy("doc_id", "blob").count().where("count > 1").isEmpty():  # repeated rows
        texts = texts.dropDuplicates(["blob"])
    ledger.append(unseen.select("blob", "kind", "version"), _scan(texts, rules))
    # Two runs of one blob have the same spans: one row each for blob and kind.
    by_kind = ledger.findings().join(met, "blob", "left_semi").join(F.broadcast(versions), ["kind", "version"]).groupBy("blob", "kind", "rank").agg(F.max("spans").alias("spans"))
    ranked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank"), F.col("kind"), s["end"].alias("end")))
    return paths, written(by_kind.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(ranked))).alias("spans")), "by-blob")


def scan(docs: DataFrame, ledger: BlobLedger, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, blob, spans``.

    ``spans``: array of ``start, rank, kind, end`` (code points, end exclusive; rank: the rule's
    place), in that order; empty where nothing is found. A null text counts as empty. Repeated
    rows and copies share their blob's findings. Very long texts are scanned whole. No documents give no rows; other columns are
    ignored.
    """
    paths, by_blob = _by_blob(docs, ledger, rules)
    # Narrow rows and plain exchanges on both sides: a blob with a third of all documents is split at run time.
    none = F.array().cast(by_blob.schema["spans"].dataType)
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, ledger: BlobLedger, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``docs`` with every character of a secret replaced by ``*`` in ``text``; other columns, whatever they are called, and a null text, stay as they are."""
    blob, held, spans = temporary("blob", "held", "spans")
    found = _by_blob(docs, ledger, rules)[1].select(F.col("blob").alias(held), F.col("spans").alias(spans))
    met = docs.withColumn(blob, blob_address()).join(found, F.col(blob) == F.col(held), "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(mask(F.col("text"), F.col(spans)))
    return met.withColumn("text", text).select(*docs.columns)


#: Code points of a text that are masked together.
_STRETCH = 4096


def mask(text: Column, spans: Column, mark: str = "*") -> Column:
    """``text`` with every character inside ``spans`` (sorted by start; they may overlap) replaced by ``mark``.

    Stretch by stretch, each with the spans that touch it, so that a very long text with many secrets is copied once.
    """
    stretches = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_STRETCH}}}"), F.lit(0))
    end = lambda i: (i + 1) * _STRETCH
    own = lambda i: F.transform(
        F.filter(spans, lambda s: (s["start"] < end(i)) & (s["end"] > i * _STRETCH)),
        lambda s: F.struct(F.greatest(s["start"] - i * _STRETCH, F.lit(0)).alias("start"), F.least(s["end"] - i * _STRETCH, F.lit(_STRETCH)).alias("end")),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(stretches, lambda x, i: _masked(x, own(i), mark)), ""))


def _masked(text: Column, spans: Column, mark: str) -> Column:
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    a["out"],
                    F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))),
                    F.repeat(F.lit(mark), s["end"] - F.greatest(s["start"], a["at"])),
                ).alias("out"),
            )
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.lit(_STRETCH))),
    )
    return done
