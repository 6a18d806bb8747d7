"""Secret scans over an incremental ledger of blobs; built-in functions only.

Every version of every path is addressed by the SHA-256 of its text, its blob. The ledger
is a Parquet table in the shared folder, to which each run appends a row for each blob that
it scanned: the rules it ran, with their versions, and what they found. A run scans each
distinct text once, and only by the rules whose present version the ledger has not met for
that blob. Findings are joined back to all paths that hold the blob, those of earlier runs
with those of this one; findings of a rule's older versions stay in the ledger and are not
joined.

``digest`` keeps such a ledger itself: it takes the table's rows as two runs, half of the
paths each, the second against what the first has left, and joins both back to all rows.

Spans are code points, end exclusive; by start, and of one start by the rules' order. A
null text is the empty text; a null path keeps its row. Very long texts are scanned whole.
Rows may repeat: each gives its own row of the result. An empty table gives an empty
result. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh_path, whole_text, written

MARK, OTHER = "\x01", "\x02"
SPAN = "array<struct<start:int,end:int,kind:string>>"
LEDGER = f"blob string, rules array<string>, spans {SPAN}"


def either_case(word: str) -> str:
    """A pattern for ASCII letters in either case, alike in all regex engines."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match stays if ``group`` of it has ``least`` characters; raise
    ``version`` with any change, so that known blobs are scanned again by this rule."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds. The two runs of one class are maximal, so their least
#: length can stand in the pattern.
BASE = (
    Rule("assign", rf"""({'|'.join(map(either_case, ('password', 'passwd', 'secret', 'token')))}|{either_case('api')}_?{either_case('key')})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Added kinds: private key heads, signed web tokens, passwords in addresses.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url", r"\b[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D/:@]*:[^\x20\x09-\x0D/:@]+@", version=2),
)
RULES = BASE + MORE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(numbers: Column) -> Column:
    """The sums up to each number of an array, by doubling: in a round every place adds the
    sum that ends ``far`` places before it, so n numbers take log n rounds of n steps."""
    fars = F.array(*(F.lit(1 << k) for k in range(31)))

    def add(sums: Column, far: Column) -> Column:
        return F.transform(sums, lambda x, i: F.when(i >= far, x + F.get(sums, i - far)).otherwise(x))

    return let(numbers, lambda given: F.aggregate(F.filter(fars, lambda far: far < F.size(given)), given, add))


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of the leftmost non-overlapping matches of ``rule`` that are long enough.

    Matches are set between marks and the text is split at the marks: every second part
    is a match, and the running sums of the parts' lengths are where it ends.
    """
    none = F.array().cast(SPAN)

    def found(parts: Column) -> Column:
        placed = F.arrays_zip(parts.alias("part"), running_sums(F.transform(parts, F.length)).alias("end"))

        def span(x: Column, i: Column) -> Column:
            kept = (i % 2 == 1) & (F.length(F.regexp_extract(x["part"], rule.pattern, rule.group)) >= rule.least)
            return F.when(kept, F.struct((x["end"] - F.length(x["part"])).alias("start"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))

        return F.array_compact(F.transform(placed, span))

    parts = F.split(F.regexp_replace(text, rule.pattern, f"{MARK}$0{MARK}"), MARK)
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), let(parts, found).cast(SPAN)).otherwise(none)


def scan(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What a run adds to the ledger: (blob, rules, spans) of each distinct text that some
    rule has not met in its present version, by those rules alone."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    none = F.array().cast(SPAN)
    # marks in a text become another control character of the same length; no rule meets either
    clean = F.when(F.contains(whole_text(text), F.lit(MARK)), F.translate(whole_text(text), MARK, OTHER)).otherwise(whole_text(text))
    blobs = versions.select(F.sha2(whole_text(text), 256).alias("blob"), clean.alias("content")).dropDuplicates(["blob"])
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    todo = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    blobs = blobs.join(seen, "blob", "left").withColumn("rules", todo).where(F.size("rules") > 0)
    each = [F.when(F.array_contains("rules", r.key), spans_of(F.col("content"), r)).otherwise(none) for r in rules]
    return blobs.select("blob", "rules", F.concat(*each).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; an empty one if no run has written there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def run(versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One run: scan what the ledger at ``path`` lacks, append it, and return the ledger."""
    spark = versions.sparkSession
    scan(versions, read_ledger(spark, path), text, rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def current(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs with findings by the present versions of ``rules``, each
    blob once, in order; the spans of a rule are those of one run."""
    places = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    keys = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.key)))
    some = ledger.where(F.size("spans") > 0)
    valid = F.filter("spans", lambda s: F.array_contains("rules", F.coalesce(keys[s["kind"]], F.lit(""))))
    ranked = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), places[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    # two runs at one time may have scanned a blob alike; equal spans then lie together
    once = lambda spans: F.filter(spans, lambda x, i: (i == 0) | (x != F.get(spans, i - 1)))
    grouped = some.select("blob", ranked.alias("spans")).where(F.size("spans") > 0).groupBy("blob").agg(let(F.array_sort(F.flatten(F.collect_list("spans"))), once).alias("spans"))
    return grouped.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def to_paths(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``versions``, without its text, with its blob and the spans of that."""
    paths = versions.select(*(F.col(f"`{c}`") for c in versions.columns if c not in (text, "blob", "spans")), F.sha2(whole_text(text), 256).alias("blob"))
    # written, so that the join back is one of its own: few blobs have findings, and where
    # they are too many to broadcast, Spark can split the paths of a hot blob
    joined = paths.join(written(current(ledger, rules), "findings"), "blob", "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(documents: DataFrame) -> DataFrame:
    """The contract's columns for a table of (doc_id, text): two runs over a new ledger."""
    held = documents.select("doc_id", "text")
    path = fresh_path(documents.sparkSession, "ledger")
    earlier = F.xxhash64("doc_id") >= 0
    run(held.where(earlier), path)
    found = to_paths(held, run(held.where(~earlier), path))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same rows in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = ", ".join(f"string_split(regexp_replace(t, {quote(r.pattern)}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) as p{i}" for i, r in enumerate(RULES))

    def spans(i: int, r: Rule) -> str:
        found = f"""list_transform(range(2, len(p{i}) + 1, 2), lambda k: {{'s': cast(coalesce(list_sum(list_transform(p{i}[1:k - 1], lambda x: length(x))), 0) as bigint), 'r': {i}, 'e': cast(list_sum(list_transform(p{i}[1:k], lambda x: length(x))) as bigint), 'k': '{r.kind}', 'm': p{i}[k]}})"""
        return f"list_filter({found}, lambda x: length(regexp_extract(x.m, {quote(r.pattern)}, {r.group})) >= {r.least})" if r.least else found

    lists = ", ".join(f"{spans(i, r)} as s{i}" for i, r in enumerate(RULES))
    text = lambda s: f"coalesce(array_to_string(list_transform(list_sort({s}), lambda x: x.k || ':' || x.s || ':' || x.e), ','), '')"
    base, every = "s0 || s1 || s2", " || ".join(f"s{i}" for i in range(len(RULES)))
    return f"""with d as (select doc_id, replace(coalesce(text, ''), chr(1), chr(2)) as t from documents), p as (select doc_id, {parts} from d), s as (select doc_id, {lists} from p)
select doc_id, len(s0)::bigint as n_assign, len(s1)::bigint as n_access, len(s2)::bigint as n_hex, sha256({text(base)}) as base_sha256, {text(every)} as spans from s"""


ORACLE_SQL = _sql()
