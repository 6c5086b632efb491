"""Secrets in texts, and credentials whose parts only tell together.

Strong parts are reported by themselves: assignments of a value to a secret's name, access identifiers, long
hexadecimal strings. Weak parts (an account name, a value assigned to a lesser name, an address) are everywhere and
reported only where complementary parts meet: a secret with an identifier or an address, an identifier or an
address with a secret, with not more than `SCOPE` code points from the end of the earlier to the start of the later
one. Strong parts count as partners, and so do weak parts that overlap a strong one, which are not reported themselves.
The meeting is an interval join on (document, bin of SCOPE places), as a semi join: no pair is spelled out, a part is
in every bin that it touches, and a bin holds no more parts than fit in its places.

Everything is DataFrame expressions. Texts are scanned once, into a written table of spans; only documents with
weak parts take part in the join.

Defined cases: null text is empty, with no span and the digest of the empty string; ids may be null or repeat (rows
are told apart by a row number of the written table, not by id); equal rows give equal rows; an empty table gives
an empty table; other columns are neither read nor returned by `find`, and kept by `redact`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kinfold.session import staged

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i:\b(client_?id|user_?name|user_?id|login|account(?:_?id)?|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
LESSER = r"""(?i:\b(pwd|pass|passphrase|credentials?|auth|private_?key|key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})"""
ENDPOINT = r"""[a-z][a-z0-9+.-]*://[^\s"'<>]+"""
SCOPE = 200

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "ident", "lesser", "endpoint"]  # the order of kinds that start at one place
ROLES = {"assign": "secret", "hex": "secret", "lesser": "secret", "access": "name", "ident": "name", "endpoint": "name"}
SPANS = "array<struct<start:int,stop:int>>"
MARK = "[removed]"


def spans(text: Column, pattern: str, likely: Column, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as code point spans; those whose group is shorter than `least` are dropped.

    The pieces between the matches and the matches themselves, laid end to end, are the text: their lengths add up to
    the places.
    """
    parts = F.arrays_zip(
        F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {SPANS})").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(F.coalesce(x["match"], F.lit("")))
        own = F.array(F.struct(begin.alias("start"), end.alias("stop")))
        keep = F.length(x["value"]) >= least  # null after the last match
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["found"], own)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(parts, start, step, lambda acc: acc["found"])
    return F.when(likely & text.rlike(pattern), found).otherwise(F.expr(f"CAST(array() AS {SPANS})"))


def scanned(docs: DataFrame, columns: list[str], label: str) -> DataFrame:
    """The named columns, a row number, and an array of spans for each kind, as a written table."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    arrays = {
        "assign": spans(text, ASSIGN, named, 2, 6),
        "access": spans(text, ACCESS, F.contains(text, F.lit("AKIA")), 0, 20),
        "hex": spans(text, HEX, F.lit(True)),
        "ident": spans(text, IDENT, named),
        "lesser": spans(text, LESSER, named),
        "endpoint": spans(text, ENDPOINT, F.contains(text, F.lit("://"))),
    }
    kept = docs.select(*[F.col(f"`{c}`") for c in columns], F.struct(*[a.alias(k) for k, a in arrays.items()]).alias("__spans"), F.monotonically_increasing_id().alias("__row"))
    return staged(kept, label)


def _listed(kinds: list[str]) -> Column:
    """One array of (start, kind number, stop, kind) over several kinds."""

    def named(kind: str) -> Column:
        return F.transform(F.col(f"__spans.{kind}"), lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))

    return F.concat(*map(named, kinds))


def _joined(listed: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(listed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def linked(scan: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(__row, __weak): the weak parts of a row that meet a complementary part; they never overlap a strong one."""
    weak_kinds = [k for k in KINDS if k not in BASE]
    some = scan.where(reduce(lambda a, b: a | b, [F.size(f"__spans.{k}") > 0 for k in weak_kinds])).select("__row", "__spans")
    strong = _listed(BASE)
    free = F.filter(_listed(weak_kinds), lambda w: ~F.exists(strong, lambda s: (s["start"] < w["stop"]) & (w["start"] < s["stop"])))
    role = F.coalesce(*[F.when(F.col("p.kind") == k, F.lit(r)) for k, r in ROLES.items()])

    def bins(more: int) -> Column:
        return F.explode(F.sequence(F.floor(F.col("p.start") / scope) - more, F.floor(F.col("p.stop") / scope) + more))

    weak = some.select("__row", F.explode(free).alias("p")).select("__row", "p", role.alias("role"), bins(0).alias("bin"))
    others = some.select("__row", F.explode(_listed(KINDS)).alias("p")).select(
        F.col("__row").alias("row_b"), F.col("p.start").alias("start_b"), F.col("p.stop").alias("stop_b"), role.alias("role_b"), bins(1).alias("bin_b"))
    near = (F.col("p.start") - F.col("stop_b") <= scope) & (F.col("start_b") - F.col("p.stop") <= scope)
    meets = (F.col("__row") == F.col("row_b")) & (F.col("bin") == F.col("bin_b")) & (F.col("role") != F.col("role_b")) & near
    return weak.join(others, meets, "left_semi").groupBy("__row").agg(F.collect_set("p").alias("__weak"))


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, counts and digest of the strong spans, and all reported spans."""
    scan = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], "secrets")
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,stop:int,kind:string>>)")
    found = scan.join(linked(scan, scope), "__row", "left")
    return found.select(
        "doc_id", *[F.size(f"__spans.{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(_listed(BASE)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(_listed(BASE), F.coalesce("__weak", none))).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = MARK) -> DataFrame:
    """The documents with every reported span replaced by `mark`; other columns stay, n_chars (if there) is counted anew."""
    scan = scanned(docs, docs.columns, "redact")
    weak_rows = reduce(lambda a, b: a | b, [F.size(f"__spans.{k}") > 0 for k in KINDS if k not in BASE])
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,stop:int,kind:string>>)")
    rows = scan.where(~weak_rows).withColumn("__weak", none).unionByName(
        scan.where(weak_rows).join(linked(scan, scope), "__row", "left").withColumn("__weak", F.coalesce("__weak", none)))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    listed = F.array_sort(F.concat(_listed(BASE), F.col("__weak")))
    cut = F.aggregate(listed, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))
    rows = rows.withColumn("text", F.when(F.size(listed) > 0, cut).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(listed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
