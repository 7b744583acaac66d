"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger lists, for a blob and the version of the
rules, the spans found, and which paths (documents) ever held which blobs. Only pairs of blob and rule version that it lacks
are scanned, each blob once however many paths hold it, and findings are joined back to all paths, past ones too. A rule
version is a digest of the rules themselves, so other rules never meet findings that they didn't make. A scan reads its blob
from one path; which paths are read or left out is broadcast where that is few, so texts aren't shuffled.

Matches' places come from the pieces between them: splitting by a pattern gives the lengths between its leftmost
non-overlapping matches, and the matches give their own.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import chunked, free, let, named, only, run_through, scanned, scratch_path, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the pattern, the group whose length counts, and the least length; shorter matches are dropped.

    Where a match is a maximal run, the pattern itself can ask for the least length: a run that is too short has no part
    that is long enough.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str  # a pattern that any text with a match contains, cheap to look for


#: The base rules.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)
#: Rules that the method adds.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, r"PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
)
RULES = BASE + ADDED
#: The way of matching; to be raised when that changes, as a digest of the rules can't tell.
VERSION = 1
#: Spans (and blobs with spans, four times) that are broadcast at most, for redaction: some ten megabytes.
FEW_SPANS = 200_000
SPAN = "struct<start:long,rank:int,kind:string,end:long,least:boolean>"
LEDGER, PATHS = f"blob string, version string, spans array<{SPAN}>", "id long, blob string"


def version_of(rules: tuple[Rule, ...] = RULES, version: int = VERSION) -> str:
    return f"{version}:{hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()}"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in a text, by start: places in code points, end exclusive; `least`: whether the match is kept.

    The patterns are matched once a text (in the zipped arrays, outside the lambda, which would match them for each span).
    """
    length = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.length(m).cast("long"))
    kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda m: F.length(m) >= rule.least) if rule.group else F.transform(length, lambda n: n >= rule.least)
    before = F.transform(F.split(text, rule.pattern, -1), lambda m: F.length(m).cast("long"))
    none = F.array().cast(f"array<{SPAN}>")

    def span(at: Column, m: Column) -> Column:
        start = at + m["before"]
        found = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + m["length"]).alias("end"), m["kept"].alias("least"))
        return F.when(m["kept"], F.array(found)).otherwise(none)  # what follows the last match has no length and isn't kept

    matches = F.arrays_zip(before.alias("before"), length.alias("length"), kept.alias("kept"))
    found = run_through(matches, F.lit(0).cast("long"), lambda at, m: at + m["before"] + F.coalesce(m["length"], F.lit(0)), span, SPAN)
    return F.when(text.rlike(rule.hint), found).otherwise(none)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) for rows (blob, text)."""
    found = [spans(F.col("text"), r, i) for i, r in enumerate(rules)]
    return blobs.select("blob", F.array_sort(F.concat(*found)).alias("spans"))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class Ledger:
    """Append-only Parquet tables of scanned pairs and of paths; without a path, a ledger that lives for this run."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.kept = spark, path is not None
        self.path = path or scratch_path(spark, "ledger")
        self.paths = f"{self.path.rstrip('/')}.paths"
        for name, schema in ((self.path, LEDGER), (self.paths, PATHS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(name)

    def _of(self, version: str) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path).where(F.col("version") == version)

    def hits(self, rules: tuple[Rule, ...] = RULES, version: int = VERSION) -> DataFrame:
        """(blob, spans) of blobs in which these rules found spans; entries that were appended twice are equal."""
        return self._of(version_of(rules, version)).where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])

    def update(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, version: int = VERSION) -> DataFrame:
        """Scan what is unseen, append it; returns (id, blob, key) of all rows.

        Of the paths of an unseen blob, that of the smallest id is read. Paths are told apart by a hash of id and blob; if
        two paths share a hash, either both are read or neither need be.
        """
        text = F.coalesce(named(text_col).cast("string"), F.lit(""))
        rows = scanned(docs).select(named(id_col).cast("long").alias("id"), blob_of(text).alias("blob"), text.alias("text"))
        key, own = F.xxhash64("id", "blob"), version_of(rules, version)
        paths = stored(rows.select("id", "blob", key.alias("key")), "paths", narrow=True)
        unseen = paths.join(self._of(own).select("blob"), "blob", "left_anti")
        due = stored(unseen.groupBy("blob").agg(F.min("id").alias("id")).select(key.alias("key")), "due", narrow=True)
        rest = paths.select("key").join(due, "key", "left_anti").distinct()
        scan(only(rows, key, due, rest), rules).select("blob", F.lit(own).alias("version"), "spans").hint("rebalance").write.mode("append").parquet(self.path)
        if self.kept:
            known = self.history().withColumnRenamed("id", "i").withColumnRenamed("blob", "b")
            new = paths.select("id", "blob").distinct().join(known, F.col("id").eqNullSafe(F.col("i")) & (F.col("blob") == F.col("b")), "left_anti")
            new.hint("rebalance").write.mode("append").parquet(self.paths)
        return paths

    def history(self) -> DataFrame:
        """(id, blob): every version that any path of this ledger ever held."""
        return self.spark.read.schema(PATHS).parquet(self.paths).distinct()

    def ever_found(self, rules: tuple[Rule, ...] = RULES, version: int = VERSION) -> DataFrame:
        """(id, blob, spans) of all versions of all paths, past ones too, in which these rules found spans."""
        return self.history().join(self.hits(rules, version), "blob").select("id", "blob", "spans")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of `docs`: id, blob and spans (start, rank, kind, end) by start, then by the rules' order.

    A null text counts as empty and holds nothing; null ids stay null; repeated rows are repeated.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    paths = ledger.update(docs, id_col, text_col, rules)
    none = F.array().cast(f"array<{SPAN}>")
    return paths.join(ledger.hits(rules), "blob", "left").select("id", "blob", F.coalesce("spans", none).alias("spans"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """id, a count for each base kind, base_sha256 (of the base spans as listed) and all spans as text."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return findings(docs, id_col, text_col, ledger).select(F.col("id").alias(id_col), *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "blob")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of its texts replaced by the mask (overlapping spans by one); all rows and columns stay.

    Where a text changes and there is a column n_chars, that becomes the text's new length.
    """
    blob, spans_, new_ = (free(docs.columns, f"__secret_{x}") for x in ("blob", "spans", "text"))
    ledger = Ledger(docs.sparkSession)
    ledger.update(docs, id_col, text_col)
    hits = ledger.hits().select(F.col("blob").alias(blob), F.col("spans").alias(spans_))
    if hits.agg(F.coalesce(F.sum(F.size(spans_) + 4), F.lit(0))).first()[0] <= FEW_SPANS:
        hits = F.broadcast(hits)
    text, found = named(text_col).cast("string"), F.col(spans_)
    new = F.when(found.isNull(), text).otherwise(masked(text, found, mask))
    rows = scanned(docs).join(hits, blob_of(text) == F.col(blob), "left")
    rows = rows.withColumn(new_, new)  # a step of its own: a lambda must not see the new column for the old
    changed = {text_col: F.col(new_).cast(docs.schema[text_col].dataType).alias(text_col)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(found.isNull(), F.col("n_chars")).otherwise(F.length(new_)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*(changed.get(c, named(c)) for c in docs.columns))


def masked(text: Column, found: Column, mask: str) -> Column:
    """`text` with the mask for each stretch of spans (sorted by start) that overlap.

    Between the stretches lie pieces of the text. Taking a piece reads the text from its beginning, so a long list of
    pieces is taken from slices of the text, one for each chunk of the square root of their number.
    """
    between = "struct<b:long,e:long>"

    def piece(at: Column, s: Column) -> Column:
        return F.when(s["start"] >= at, F.array(F.struct(at.alias("b"), s["start"].alias("e")))).otherwise(F.array().cast(f"array<{between}>"))

    def part(of: Column, b: Column, e: Column) -> Column:
        return F.substring(of, (b + 1).cast("int"), (e - b).cast("int"))

    def cut(chunk: Column) -> Column:
        first, last = F.element_at(chunk, 1)["b"], F.element_at(chunk, -1)["e"]
        return let(part(text, first, last), lambda own: F.array_join(F.transform(chunk, lambda p: part(own, p["b"] - first, p["e"] - first)), mask))

    zero = F.lit(0).cast("long")
    end = F.aggregate(found, zero, lambda at, s: F.greatest(at, s["end"]))
    last = F.array(F.struct(end.alias("b"), F.length(text).cast("long").alias("e")))
    pieces = F.concat(run_through(found, zero, lambda at, s: F.greatest(at, s["end"]), piece, between), last)
    return F.array_join(F.transform(let(pieces, chunked), cut), mask)
