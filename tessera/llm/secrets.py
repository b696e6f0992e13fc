"""Secret scans over an incremental ledger of blobs: built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle

#: Rules in the order in which their spans are listed; (kind, pattern).
RULES = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]{16,}"),
    ("hex", r"[0-9a-f]{24,}"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
BASE = ["assign", "access", "hex"]
#: The version of each rule. A rule that changes gets a new one, under which old blobs are scanned again by this rule alone.
VERSIONS = dict.fromkeys([k for k, _ in RULES], 1)
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: Values that a running total covers at a time.
STEP = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value being computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """For each of an array of non-negative integers the total of those before it, 0 for the first. Totals are taken over runs of STEP values, then
    of STEP runs and so on, as an array that grows value by value would be copied each time."""

    def direct(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, start, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def split(a: Column) -> Column:
        n = F.ceil(F.size(a) / STEP).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(a, i * STEP + 1, STEP))).otherwise(F.array().cast("array<array<int>>"))

    if not levels:
        return direct(values)

    def parts(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), add))
        return F.flatten(F.zip_with(runs, running(totals, add, levels - 1), lambda r, before: F.transform(direct(r), lambda x: add(before, x))))

    return let(values, lambda v: F.when(F.size(v) <= STEP, direct(v)).otherwise(let(split(v), parts)))


def _found(text: Column, kind: str, pattern: str) -> Column:
    """All matches of one rule as (start, rank, kind, end), in code points; empty unless the text matches at all. Matches stand between
    the parts into which the pattern splits the text."""
    rx, rank = F.lit(pattern), [k for k, _ in RULES].index(kind)
    size = F.char_length
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, rx, F.lit(0)), lambda gap, hit: F.struct(size(gap).alias("gap"), F.coalesce(size(hit), F.lit(0)).alias("hit"), _fits(hit, kind).alias("fits")))

    def spans(p: Column) -> Column:
        at = running(F.transform(p, lambda x: x["gap"] + x["hit"]), lambda a, b: a + b)
        all_ = F.zip_with(p, at, lambda x, before: F.struct((before + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (before + x["gap"] + x["hit"]).alias("end"), x["fits"].alias("fits")))
        return F.transform(F.filter(all_, lambda x: x["fits"]), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))

    return F.when(text.rlike(pattern), let(pieces, spans)).otherwise(F.array().cast(SPANS))


def _fits(hit: Column, kind: str) -> Column:
    """Whether a match counts: what follows the first separator of an assign match must be long enough."""
    return F.coalesce(F.char_length(F.regexp_extract(hit, RULES[0][1], 2)) >= 6, F.lit(False)) if kind == "assign" else hit.isNotNull()


def scan(docs: DataFrame, ledger: DataFrame | None = None, versions: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): findings holds (doc_id, blob, spans) for each row of docs, ledger what was known and is known now: (blob, rules,
    spans), rules being the "kind:version" under which a blob has been scanned. versions: the rules to scan by, each with its version.

    A blob's address is the SHA-256 of its text, so every version of every path with the same content is one blob. Pairs of a blob
    and a rule's version that the ledger does not hold are scanned, each once; which blobs have such pairs is told from addresses alone
    before any text travels. Findings are then joined back to all rows. A null text is the empty blob; rows keep null or repeated ids; a very
    long text is read whole, in time proportional to its length and matches; spans is an empty array where nothing is found. No
    rows give no rows; extra columns are ignored."""
    versions = VERSIONS if versions is None else versions
    rules = {f"{k}:{v}": (k, p) for k, p in RULES for v in [versions.get(k)] if v is not None}
    wanted = F.array(*map(F.lit, rules))
    address = F.sha2(F.coalesce("text", F.lit("")), 256)
    seen = docs.select(F.coalesce("text", F.lit("")).alias("text"), address.alias("blob"))
    if ledger is not None:
        known = ledger.select("blob", "rules", "spans")
        had = docs.select(address.alias("blob")).distinct().join(known, "blob", "left")
        todo = had.select("blob", F.array_except(wanted, F.coalesce("rules", F.array().cast("array<string>"))).alias("todo"), "rules", "spans").filter("size(todo) > 0")
        # written, so that Spark knows its size: a small one is sent to the texts, which else travel to it
        todo = settle(todo, "unseen")
        blobs = seen.join(todo.select("blob"), "blob").groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    else:
        blobs = seen.groupBy("blob").agg(F.first("text").alias("text")).select("*", wanted.alias("todo"), F.array().cast("array<string>").alias("rules"), F.array().cast(SPANS).alias("spans"))
    found = [_found(F.col("text"), k, p) if ledger is None else F.when(F.array_contains("todo", name), _found(F.col("text"), k, p)).otherwise(F.array().cast(SPANS)) for name, (k, p) in rules.items()]
    again = F.transform("todo", lambda x: F.substring_index(x, ":", 1))  # an older version's spans and mark go
    old_spans = F.filter(F.coalesce("spans", F.array().cast(SPANS)), lambda s: ~F.array_contains(again, s["kind"]))
    old_rules = F.filter(F.coalesce("rules", F.array().cast("array<string>")), lambda r: ~F.array_contains(again, F.substring_index(r, ":", 1)))
    new = settle(blobs.select("blob", F.concat(old_rules, "todo").alias("rules"), F.array_sort(F.concat(old_spans, *found)).alias("spans")), "ledger")
    known = new if ledger is None else known.join(todo.select("blob"), "blob", "left_anti").unionByName(new)
    kinds = [k for k, _ in rules.values()]
    hits = known.select("blob", F.filter("spans", lambda s: s["kind"].isin(kinds)).alias("spans")).filter(F.size("spans") > 0)
    back = docs.select("doc_id", address.alias("blob")).join(hits, "blob", "left")
    return back.select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), known


def digest(findings: DataFrame) -> DataFrame:
    """Counts and listings of the findings' spans, base kinds apart."""
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return findings.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


#: What follows a private key's first line: all up to its last line, or without one the letters, digits and breaks that a key has.
KEY_BODY = r"^[\s\S]*?-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----"
KEY_REST = r"^[A-Za-z0-9+/=\\\s]*"


def _covered(text: Column, spans: Column) -> Column:
    """The spans by start with the ends of what is taken out: a private key's span reaches over the key."""

    def end(s: Column) -> Column:
        rest = F.substr(text, s["end"] + 1)
        body = F.when(F.regexp_extract(rest, KEY_BODY, 1) == "END", F.regexp_extract(rest, KEY_BODY, 0)).otherwise(F.regexp_extract(rest, KEY_REST, 0))
        return F.when(s["kind"] == "pem", s["end"] + F.char_length(body)).otherwise(s["end"])

    return F.transform(F.array_sort(spans), lambda s: F.struct(s["start"].alias("start"), end(s).alias("end"), s["kind"].alias("kind")))


def redact(text: Column, spans: Column) -> Column:
    """The text with <redacted:kind> in place of each span, or of spans that overlap, named by the first of them. No rule matches the mark."""

    def joined(own: Column) -> Column:
        """Each first span of those that overlap, with the end of the last."""
        reach = running(F.transform(own, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        heads = F.filter(F.zip_with(own, reach, lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), r.alias("reach"))), lambda x: (x["start"] >= x["reach"]))
        last = F.array_max(F.transform(own, lambda s: s["end"]))
        return let(heads, lambda h: F.zip_with(h, F.concat(F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x: x["reach"]), F.array(last)), lambda x, end: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["reach"].alias("from"), end.alias("end"))))

    def cut(part: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
        def put(cuts: Column) -> Column:
            marked = F.transform(cuts, lambda x: F.concat(part(x["from"], x["start"] - x["from"]), F.lit("<redacted:"), x["kind"], F.lit(">")))
            end = F.get(cuts, F.size(cuts) - 1)["end"]
            return F.concat(F.array_join(marked, ""), part(end, F.char_length(text) - end))

        return put

    few = cut(lambda at, n: F.substr(text, at + 1, n))
    # a part of a text is found by counting its characters from the start: with many parts the characters are told apart once
    many = lambda cuts: let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: cut(lambda at, n: F.array_join(F.slice(c, at + 1, n), ""))(cuts))
    return let(let(_covered(text, spans), joined), lambda cuts: F.when(F.size(cuts) > 64, many(cuts)).otherwise(few(cuts)))


def redact_found(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """docs with all spans of the findings taken out of their texts, of whatever kind; n_chars, where there is one, becomes the new length. All
    rows and columns stay."""
    found = findings.filter(F.size("spans") > 0).select(F.col("blob").alias("found"), "spans").dropDuplicates(["found"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    hit = F.col("found").isNotNull()
    marked = rows.join(found, F.col("key") == F.col("found"), "left").withColumn("new", F.when(hit, redact(F.col("row")["text"], F.col("spans"))))
    put = {"text": F.col("new")} | ({"n_chars": F.char_length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return marked.select(*[(F.when(hit, put[c]).otherwise(F.col("row")[c]) if c in put else F.col("row")[c]).alias(c) for c in docs.columns])
