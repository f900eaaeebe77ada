"""Secret scan over an incremental ledger of blobs, DataFrame operations only.

Every version of every path is content-addressed (SHA-256 of its text).  The ledger is a table of (blob, rules, found): which rule versions have seen a
blob and what they found.  A scan reads the ledger, picks one text for each blob that some current rule version has not seen, runs just those rules on it, appends
the result, and joins the findings back to all paths.  A new rule version is run on all blobs, a new blob by all rules, everything else is never read again.

Spans are found by one pass of a pattern anchored at the end of the match before, `\\G(.*?)(rule)`: each piece is the gap and the match, so running sums of lengths
are the places, in code points, leftmost and without overlap for each rule.

A blob that holds a third of all rows is cut to one row per task before it is shuffled, and meets its paths in a join that the planner can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quantloom.llm.common import pick_columns

FOUND = "array<struct<rule: string, start: int, end: int>>"
LEDGER = f"blob binary, rules array<string>, found {FOUND}"


@dataclass(frozen=True)
class Rule:
    """A named pattern.  Matches count if the pattern's `group` (0: all of it) has `least` characters; `group` is a group of the rule's own pattern.

    `needle` is a literal and `guard` a pattern that every counted match holds: texts without them are not scanned by the rule, which saves time and changes nothing.
    """
    name: str
    pattern: str
    group: int = 0
    least: int = 1
    needle: str = ""
    guard: str = ""

    @property
    def version(self) -> str:
        """Changes with the rule, so that a changed rule has seen no blob."""
        return f"{self.name}@" + hashlib.sha256(f"{self.pattern}\n{self.group}\n{self.least}".encode()).hexdigest()[:12]


def either_case(word: str) -> str:
    """ASCII letters in either case, as classes: engines differ in what else they fold."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base rules, fixed by the contract.
BASE = (
    Rule("assign", f"({either_case('password')}|{either_case('passwd')}|{either_case('secret')}|{either_case('token')}|{either_case('api')}_?{either_case('key')})"
                   r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, guard=r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""),
    Rule("access", r"AKIA[A-Z0-9]{14,}", needle="AKIA"),       # a run that is too short fails wherever it starts, so the length may stand in the pattern
    Rule("hex", r"[0-9a-f]{16,}", guard="[0-9a-f]{16}"),
)
#: Rules of the method: public formats of keys and tokens.
MORE = (
    Rule("key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", needle="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", guard="gh[pousr]_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", needle="xox"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", needle="AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needle="eyJ"),
)
RULES = BASE + MORE


def spans(text: Column, rule: Rule) -> Column:
    """Array of (rule, start, end) of one rule's matches; code points, end exclusive."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?)({rule.pattern})"), F.lit(0))
    # a piece ends with its match; the pattern finds the same place in it, as nothing before it matched
    part = F.transform(pieces, lambda p: F.struct(F.char_length(p).alias("piece"), F.char_length(F.regexp_extract(p, rule.pattern, 0)).alias("match"),
                                                  F.char_length(F.regexp_extract(p, rule.pattern, rule.group)).alias("part")))
    done = lambda acc, p: F.struct(
        (acc["at"] + p["piece"]).alias("at"),
        F.when(p["part"] >= rule.least, F.concat(acc["out"], F.array(F.struct((acc["at"] + p["piece"] - p["match"]).alias("start"), (acc["at"] + p["piece"]).alias("end")))))
        .otherwise(acc["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    found = F.aggregate(part, start, done)["out"]
    found = F.transform(found, lambda s: F.struct(F.lit(rule.version).alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
    worth = [text.contains(rule.needle)] * bool(rule.needle) + [text.rlike(rule.guard)] * bool(rule.guard)
    return F.when(worth[0], found).otherwise(F.array().cast(FOUND)) if worth else found


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's rows; none where nothing has been written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(folder) if there else spark.createDataFrame([], LEDGER)


def unseen(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, text, seen): one row for each blob that not all rule versions have seen; `seen` are those that have."""
    now = F.array(*[F.lit(r.version) for r in rules])
    known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))        # as many rows a blob as it had scans
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    out = blobs.join(known, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    return out.where(F.size(F.array_except(now, "seen")) > 0)


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows of (blob, text, seen): each rule runs on the blobs that it has not seen."""
    none = F.array().cast(FOUND)
    new = [F.when(~F.array_contains("seen", r.version), spans(F.col("text"), r)).otherwise(none) for r in rules]
    return blobs.select("blob", F.array_except(F.array(*[F.lit(r.version) for r in rules]), "seen").alias("rules"), F.concat(*new).alias("found"))


def addressed(df: DataFrame, *paths: str, text: str = "text") -> DataFrame:
    """(paths..., blob, text) of every version; a null text is empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return pick_columns(df, *paths, text).select(*paths, F.unhex(F.sha2(whole, 256)).alias("blob"), whole.alias("text"))


def update_ledger(df: DataFrame, folder: str, *paths: str, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scans what the ledger in `folder` has not seen, appends it, and returns the ledger.  A scan that is cut short and repeated only adds rows that are there already."""
    spark = df.sparkSession
    todo = unseen(addressed(df, *paths, text=text).select("blob", "text"), read_ledger(spark, folder), rules)
    scan_blobs(todo, rules).write.mode("append").parquet(folder)
    return read_ledger(spark, folder)


def findings(df: DataFrame, ledger: DataFrame, *paths: str, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(paths..., found): for each row of `df` the (rule, start, end) that the current rule versions found in its blob, by start, then by the rules' order.

    `rule` is the rule's name.  Rows without findings have an empty array; equal texts have equal findings under every path; repeated rows and null paths stay.
    """
    number = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.version), F.lit(k))])
    name = F.array(*[F.lit(r.name) for r in rules])
    hits = ledger.where(F.size("found") > 0).select("blob", F.inline("found")).withColumn("k", F.try_element_at(number, "rule")).where("k IS NOT NULL")
    by_blob = hits.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "k", "end"))).alias("hits"))
    docs = addressed(df, *paths, text=text).drop("text")
    out = docs.join(by_blob, "blob", "left")
    ordered = F.transform("hits", lambda h: F.struct(F.get(name, h["k"]).alias("rule"), h["start"].alias("start"), h["end"].alias("end")))
    return out.select(*paths, F.coalesce(ordered, F.array().cast(FOUND)).alias("found"))


def scan_secrets(df: DataFrame, folder: str, *paths: str, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """`findings` of every row after the ledger in `folder` has been brought up to date.

    Null texts are empty; an empty text, like an empty table, has no findings.  Texts are scanned whole.  Further columns of `df` are ignored, whatever their names.
    """
    return findings(df, update_ledger(df, folder, *paths, text=text, rules=rules), *paths, text=text, rules=rules)


def joined(found: str, *names: str) -> Column:
    """name:start:end of the spans (of the named rules only, if any are named), comma-joined."""
    mine = F.filter(found, lambda s: s["rule"].isin(*names)) if names else F.col(found)
    return F.array_join(F.transform(mine, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: str, name: str) -> Column:
    return F.size(F.filter(found, lambda s: s["rule"] == name)).cast("long")
