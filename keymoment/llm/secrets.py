"""Operator 11: secrets by corpus-wide ownership frequency, in DataFrame functions only.

Kinds of spans are listed in KINDS. The base kinds count by their pattern alone; the added kinds (private keys, signed web tokens,
tokens with a provider's prefix, opaque strings) are candidates that stay only if the corpus says that one owner has them. A candidate's
value is hashed (SHA-256; values themselves never leave the first scan) and its hash is aggregated by (owner, repository), then by owner, then over
the corpus. A value that COPIED owners or more hold is an example everybody copies; one of a single owner that looks random
(entropy, no placeholder word, no run or keyboard row) is live-looking; one of several owners is shared; all else is plain.

Spans are found without a scan for positions: the pieces between a kind's matches and the matches add up to them. Matches become rows,
positions a window's running sum by text and kind, so a text of thousands of matches costs no more than its matches. The frequency table joins the rows by hash:
hashes with more than a thousandth of all rows (fewer than HOT of them by counting) are broadcast, the others joined by a shuffle that
has no larger key; rows without a candidate or with a hot one are dealt by their own number there. Distinct (hash, owner, repository) are
pre-aggregated in map tasks.

Defined cases: a null or empty text has no spans and keeps its row; a null owner or repository is one owner or repository of its own; rows that repeat a doc_id, null ones too, are
judged each; spans of one start are ordered by KINDS; patterns know ASCII letters only; a text of any length is matched whole; extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import written

COPIED, HOT = 3, 1000
#: Bits a character of a value that looks random: of 16 digits, of any characters.
HEX_BITS, ANY_BITS = 3.0, 3.3


class Kind(NamedTuple):
    name: str
    pattern: str
    least: int  # characters of the value
    base: bool
    group: int = 0  # of the pattern, the value


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))
#: The three base patterns, then the added ones. Runs of a class with a least length are matched as such a run, which is
#: the same as matching every run and leaving out short ones; assignments aren't, as a short value hides what it overlaps.
KINDS = [
    Kind("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, True, 2),
    Kind("access", "AKIA[A-Z0-9]{16,}", 20, True),
    Kind("hex", "[0-9a-f]{24,}", 24, True),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+", 60, False),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30, False),
    Kind("prefixed", r"(?:ghp|gho|ghs|ghu|github_pat|glpat|xoxb|xoxp|xoxa|xoxr|sk_live|rk_live|npm|hf)[_-][A-Za-z0-9_-]{16,}", 20, False),
    Kind("opaque", r"[A-Za-z0-9_-]{32,}", 32, False),
]
#: What placeholders contain, in lower case.
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|change_me|your_|your-|yourpassword|redacted|xxxx|0000|1111|12345|abcdef|qwerty|test|foobar|deadbeef|todo|insert|none"


def _matches(kind: Kind) -> Column:
    return F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))


def _entropy(value: Column) -> Column:
    """Shannon entropy of a value's characters in bits; there are at most a few dozen distinct ones."""
    n = F.length(value)
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.transform(F.array_distinct(F.split(value, "")), lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c)))), F.lit(0.0), lambda s, x: s + x)


def _looks_random(value: Column) -> Column:
    bits = F.when(value.rlike("^[0-9a-f]+$"), HEX_BITS).otherwise(ANY_BITS)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return mixed & ~F.lower(value).rlike(PLACEHOLDERS) & ~value.rlike(r"(.)\1{5}") & (_entropy(value) >= bits)


def _in_place(i: int, kind: Kind) -> Column:
    """A text's matches of a kind, each with its number and the length of the piece before it."""
    gaps = F.transform(F.split("text", kind.pattern, -1), F.length)  # one piece more than matches; it goes
    both = F.zip_with(F.transform(F.col(kind.name), lambda m, j: F.struct(j.alias("j"), m.alias("match"))), gaps, lambda m, g: F.struct(F.lit(i).alias("kind"), m["j"].alias("j"), g.alias("gap"), m["match"].alias("match")))
    none = F.array().cast("array<struct<kind:int,j:int,gap:int,match:string>>")
    return F.when(F.size(kind.name) > 0, F.slice(both, 1, F.size(kind.name))).otherwise(none)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """A row for each match of each kind, in its place, and one for each text without any: (row, doc_id, owner, repository, kind, j, gap, size, h, random).

    kind is a place in KINDS, j the match's number in its text, gap the code points before it since the match before, h the hash of its value
    (null if the value is too short to count) and random whether it looks so.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(owner.cast("string"), F.lit("\0")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("\0")).alias("repository"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({k.name: _matches(k) for k in KINDS})
    found = [_in_place(i, k) for i, k in enumerate(KINDS)]
    rows = rows.select("row", "doc_id", "owner", "repository", F.explode_outer(F.flatten(F.array(*found))).alias("m"))
    value = F.col("m.match")
    for i, k in enumerate(KINDS):
        if k.group:
            value = F.when(F.col("m.kind") == i, F.regexp_extract("m.match", k.pattern, k.group)).otherwise(value)
    rows = rows.withColumn("value", value)
    least = F.element_at(F.array(*(F.lit(k.least) for k in KINDS)), F.col("m.kind") + 1)
    mixed = (F.col("m.kind") != len(KINDS) - 1) | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]"))  # opaque strings
    rows = rows.withColumn("ok", (F.length("value") >= least) & mixed)
    return rows.select("row", "doc_id", "owner", "repository", "m.kind", "m.j", "m.gap", F.length("m.match").alias("size"), F.when(F.col("ok"), F.unhex(F.sha2(F.col("value").cast("binary"), 256))).alias("h"), F.when(F.col("ok"), _looks_random(F.col("value"))).alias("random"))


def ownership(found: DataFrame) -> DataFrame:
    """(h, rows, owners, repositories) of each candidate value over the whole corpus."""
    by_repository = found.where("h is not null").groupBy("h", "owner", "repository").agg(F.count("*").alias("rows"))
    by_owner = by_repository.groupBy("h", "owner").agg(F.sum("rows").alias("rows"), F.count("*").alias("repositories"))
    return by_owner.groupBy("h").agg(F.sum("rows").alias("rows"), F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def _verdict() -> Column:
    return F.when(F.col("h").isNull(), None).when(F.col("owners") >= COPIED, "example").when(~F.col("random"), "plain").when(F.col("owners") == 1, "live").otherwise("shared")


def judged(found: DataFrame) -> DataFrame:
    """candidates() with owners, repositories and a verdict: example, plain, live or shared."""
    frequency = written(ownership(found), "owners")
    most = found.where("h is not null").count() // HOT
    # Fewer than HOT hashes can have more than a thousandth of the rows each, so this side is bounded.
    hot = frequency.where(F.col("rows") > max(most, 1)).select("h", F.col("owners").alias("hot_owners"), F.col("repositories").alias("hot_repositories"))
    rows = found.join(F.broadcast(hot), "h", "left")
    rows = rows.withColumn("at", F.when(F.col("h").isNull() | F.col("hot_owners").isNotNull(), F.unhex(F.md5(F.concat_ws(":", "row", "kind", "j")))).otherwise(F.col("h")))
    rest = frequency.where(F.col("rows") <= max(most, 1)).select(F.col("h").alias("at"), "owners", "repositories")
    rows = rows.join(rest, "at", "left")
    rows = rows.withColumns({c: F.coalesce(c, f"hot_{c}") for c in ("owners", "repositories")})
    return rows.withColumn("verdict", _verdict()).drop("at", "hot_owners", "hot_repositories")


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Per document: counts and digest of base spans, all spans (added ones only of one owner), their verdicts and numbers of owners."""
    rows = judged(written(candidates(docs, owner, repository), "candidates"))
    before = Window.partitionBy("row", "kind").orderBy("j")
    rows = rows.repartition(F.col("row")).withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(before))
    base = F.col("kind") < sum(k.base for k in KINDS)
    keep = F.col("h").isNotNull() & (base | (F.col("verdict") == "live"))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end", "verdict", "owners")
    per = rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *(F.count(F.when(F.col("h").isNotNull() & (F.col("kind") == i), 1)).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base),
        F.sort_array(F.collect_list(F.when(keep, span))).alias("s"),
    )
    names = F.array(*(F.lit(k.name) for k in KINDS))
    said = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    first = sum(k.base for k in KINDS)
    return per.select(
        "doc_id", *(f"n_{k.name}" for k in KINDS if k.base),
        F.sha2(F.array_join(F.transform(F.filter("s", lambda s: s["kind"] < first), said), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("s", said), ",").alias("spans"),
        F.array_join(F.transform("s", lambda s: s["verdict"]), ",").alias("verdicts"),
        F.array_join(F.transform("s", lambda s: s["owners"].cast("string")), ",").alias("owners"),
    )
