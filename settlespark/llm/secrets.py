"""Secret scans with an incremental ledger of blobs.

Every version of every file is addressed by the digest of its content.  The ledger
holds, per blob, the rule versions that have scanned it and what they found, so a
scan reads only blobs with an unseen rule version, each once however many paths
hold it.  Findings are joined back to all paths.

Only DataFrame functions are used.  A regular expression gives matches without
positions; as its matches and the pieces between them make up the text, the
running sum of their lengths is the position of each match.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from settlespark.llm.batches import text_or_empty
from settlespark.llm.columns import small
from settlespark.plans.skew import checkpoint_dir, freeze

SPAN = "struct<kind:string,start:bigint,end:bigint>"
# In the ledger a span also names the rule version that found it.
FOUND = "struct<rule:string,kind:string,start:bigint,end:bigint>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of ``pattern`` count if
    ``group`` of the match has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns of the contract.  Runs that are too short are left out
# of `access` and `hex` by the pattern itself: such a run holds no longer match.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


MATCH = "struct<rule:int,gap:bigint,size:bigint,held:int>"


def matches(text: Column, rule: Rule, number: int) -> Column:
    """Array of the matches of a rule: its number, the characters since the match before,
    and the characters of the match and of its group."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    parts = F.zip_with(
        F.slice(between, 1, F.size(found)), F.arrays_zip(found.alias("m"), held.alias("g")),
        lambda gap, x: F.struct(
            F.lit(number).alias("rule"), F.length(gap).cast("long").alias("gap"),
            F.length(x["m"]).cast("long").alias("size"), F.length(x["g"]).alias("held")))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), parts).otherwise(F.array().cast(f"array<{MATCH}>"))


class Ledger:
    """A Parquet folder with one row per blob and scan: ``blob``, ``rules``, ``found``.

    A row is written with its findings in one commit, so a blob counts as scanned
    only when its findings are there; a scan that fails is repeated.
    """

    SCHEMA = f"blob binary, rules array<string>, found array<{FOUND}>"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], self.SCHEMA).coalesce(1).write.mode("append").parquet(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def scan(self, df: DataFrame, rules: Sequence[Rule], text: str = "text") -> None:
        """Scan the contents of ``df`` that some rule version has not seen yet."""
        held = df.select(text_or_empty(text).alias("text")).withColumn("blob", address(F.col("text")))
        seen = self.table().groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        blobs = held.dropDuplicates(["blob"]).join(seen, "blob", "left")
        names = F.array(*[F.lit(r.name) for r in rules])
        todo = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
        unseen = blobs.withColumn("rules", todo).filter(F.size("rules") > 0)
        every = F.concat(*[
            F.when(F.array_contains("rules", r.name), matches(F.col("text"), r, k))
            .otherwise(F.array().cast(f"array<{MATCH}>")) for k, r in enumerate(rules)])
        # one row per match, and one for a blob without any; they stay in the blob's task
        rows = unseen.select("blob", "rules", F.posexplode_outer(every).alias("at", "m"))
        end = F.sum(F.col("m.gap") + F.col("m.size")).over(Window.partitionBy("blob", "m.rule").orderBy("at"))
        rule, kind, least = (F.get(F.array(*[F.lit(v) for v in values]), F.col("m.rule")) for values in (
            [r.name for r in rules], [r.kind for r in rules], [r.least for r in rules]))
        span = F.struct(
            rule.alias("rule"), kind.alias("kind"), (F.col("end") - F.col("m.size")).alias("start"), F.col("end"))
        found = F.collect_list(F.when(F.col("m.held") >= least, span))
        rows.withColumn("end", end).groupBy("blob").agg(
            F.first("rules").alias("rules"), found.cast(f"array<{FOUND}>").alias("found")
        ).write.mode("append").parquet(self.path)

    def findings(self, rules: Sequence[Rule]) -> DataFrame:
        """Spans that these rule versions found, per blob that has any: ``blob``, ``found``.

        What other versions of a rule found in the same blob stays in the ledger only.
        """
        one = self.table().select("blob", "found", F.explode("rules").alias("rule")).filter(
            F.col("rule").isin([r.name for r in rules]))
        own = F.transform(F.filter("found", lambda s: s["rule"] == F.col("rule")), lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        # a scan that was repeated found the same
        once = one.select("blob", "rule", own.alias("found")).filter(F.size("found") > 0).groupBy("blob", "rule").agg(
            F.first("found").alias("found"))
        return once.groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))


def address(text: Column) -> Column:
    """Content address: the SHA-256 of the UTF-8 bytes."""
    return F.unhex(F.sha2(text, 256))


def listed(found: Column, kinds: Sequence[str]) -> Column:
    """kind:start:end of the spans of some kinds, by start, then by the order of the kinds."""
    order = F.array(*[F.lit(k) for k in kinds])
    kept = F.filter(found, lambda s: F.array_contains(order, s["kind"]))
    ranked = F.array_sort(F.transform(kept, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"),
        s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(
    df: DataFrame, id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = BASE + MORE,
    ledger: Ledger | None = None,
) -> DataFrame:
    """One row per row of ``df`` (a version at a path): id, ``blob`` (hex) and ``found``.

    Unseen contents are scanned first; ``ledger`` keeps what was scanned for later
    calls (without one, an empty ledger in the shared folder is used).  A null text
    counts as empty; rows may repeat ids and contents; other columns are ignored;
    an empty table gives no row.
    """
    if ledger is None:
        spark = df.sparkSession
        ledger = Ledger(spark, f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.scan(df, rules, text)
    paths = df.select(F.col(f"`{id}`").alias("id"), address(text_or_empty(text)).alias("blob"))
    # written first, so that the join stands alone and a blob with many paths can be split
    findings = freeze(ledger.findings(rules))
    found = findings.agg(F.sum(F.size("found"))).first()[0] or 0
    return paths.join(small(findings, found), "blob", "left").select(
        F.col("id").alias(id), F.lower(F.hex("blob")).alias("blob"),
        F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found"))


def _count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def secret_counts(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, their digest, and all spans as text."""
    base = [r.kind for r in BASE]
    kinds = base + [r.kind for r in MORE]
    found = F.col("found")
    return scan_documents(df, id, text).select(
        id,
        *[_count(found, k).alias(f"n_{k}") for k in base],
        F.sha2(listed(found, base), 256).alias("base_sha256"),
        listed(found, kinds).alias("spans"))
