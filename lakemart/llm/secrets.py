"""Secrets in texts, judged by how many owners share them.

Patterns find candidates: assignments to a telling name, access keys, long runs of hex
digits, and other long tokens that mix letters and digits. A pattern can't tell a
leaked credential from an example that everyone copies, but the corpus can: the hash of
each candidate's value is counted over distinct repositories and distinct owners. What
is shared by more than a few owners is an example; what stays with its owner looks live.

Everything is built from DataFrame operations. Only texts with a candidate go further
than a filter, each different one once. Places come from cutting the text at the
matches and summing up lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemart.llm.common import col, fresh, written


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that is the secret itself, and how long the group must be."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool = True


TOKEN = "[A-Za-z0-9+/_=-]"
KINDS = (
    Kind(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
        2,
        6,
    ),
    # a run of 20 and 24 at least is all that is left of shorter ones dropped
    Kind("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", "[0-9a-f]{24,}", 0, 24),
    Kind("owned", f"(?<!{TOKEN}){TOKEN}{{20,}}", 0, 20, base=False),
)
# Tokens outside the base patterns must mix letters and digits, and not repeat few characters.
LIVE_LOOKING = r"^(?=.*[0-9])(?=.*[A-Za-z])"
DISTINCT_CHARACTERS = 8
MAX_OWNERS = 2
MASK = "[secret]"

_FINDING = (
    "struct<start:int,rank:int,kind:string,end:int,value_start:int,"
    "repositories:bigint,owners:bigint,live:boolean>"
)


def has_candidate(text: Column) -> Column:
    """Whether any pattern matches; false for null."""
    found = F.lit(False)
    for kind in KINDS:
        found = found | F.coalesce(text.rlike(kind.pattern), F.lit(False))
    return found


def _matches(text: Column, kind: Kind) -> Column:
    """The gaps before each match, the matches and their secrets, in order."""
    pattern = F.lit(kind.pattern)
    return F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
        F.regexp_extract_all(text, pattern, F.lit(kind.group)).alias("value"),
    )


def spans(texts: DataFrame) -> DataFrame:
    """(key, rank, kind, start, end, value_start, value) of every candidate in (key, text)."""
    each = F.array(
        *[F.struct(F.lit(i).alias("rank"), _matches(F.col("text"), kind).alias("all")) for i, kind in enumerate(KINDS)]
    )
    rows = texts.select("key", F.explode(each).alias("k"))
    rows = rows.select("key", "k.rank", F.posexplode("k.all").alias("at", "m"))
    rows = rows.select("key", "rank", "at", "m.gap", "m.found", "m.value")
    here = Window.partitionBy("key", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    length = F.coalesce(F.char_length("found"), F.lit(0))
    rows = rows.withColumn("end", F.sum(F.char_length("gap") + length).over(here).cast("int"))
    # the piece behind the last match has no match
    rows = rows.where("found is not null").select(
        "key",
        "rank",
        F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("rank") + 1).alias("kind"),
        (F.col("end") - F.char_length("found")).alias("start"),
        "end",
        (F.col("end") - F.char_length("value")).alias("value_start"),
        "value",
    )
    long_enough = F.lit(False)
    for i, kind in enumerate(KINDS):
        fits = (F.col("rank") == i) & (F.char_length("value") >= kind.least)
        if not kind.base:
            mixed = F.size(F.array_distinct(F.split("value", ""))) >= DISTINCT_CHARACTERS
            fits = fits & F.col("value").rlike(LIVE_LOOKING) & mixed
        long_enough = long_enough | fits
    return rows.where(long_enough)


def ownership(found: DataFrame, holders: DataFrame) -> DataFrame:
    """(hash, repositories, owners): over how many of each a value is spread.

    ``found`` has (key, hash), ``holders`` (key, repository, owner). A null repository
    or owner is not counted.
    """
    held = found.select("key", "hash").distinct().join(holders.distinct(), "key")
    return held.groupBy("hash").agg(
        F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners")
    )


def scan(
    docs: DataFrame,
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str | None = None,
    max_owners: int = MAX_OWNERS,
    alias: str = "secrets",
) -> DataFrame:
    """Add an array of findings, sorted by start and kind.

    A finding is (start, rank, kind, end, value_start, repositories, owners, live) in
    code points, end exclusive; ``rank`` is the place of the kind in :data:`KINDS`. It
    is live if at most ``max_owners`` owners have its value, in however many of their
    repositories; where no owner is known, repositories count in their place. Matches of
    the base kinds
    are always listed; a token of the kind ``owned`` only if it is live and overlaps
    none of them.

    Null and empty texts have no findings; texts may have any length. Null owners and
    repositories are not counted, so a value without any of them is live. Ids play no part, and repeated rows add nothing to the
    counts. An empty table gives an empty table. All columns stay; one named like
    ``alias`` is replaced. ``repository_col`` is the owner's column if not given.
    """
    text = col(text_col)
    if alias in docs.columns and alias not in (text_col, owner_col, repository_col):
        docs = docs.drop(alias)
    key = fresh(docs, "text_key")
    # the few texts with a candidate are written, so that the patterns look for them once
    hits = written(docs.where(has_candidate(text)).withColumn(key, F.sha2(text, 256)), "secrets-hits")
    texts = hits.groupBy(F.col(key).alias("key")).agg(F.min(text).alias("text"))
    found = spans(texts).withColumn("hash", F.sha2("value", 256)).drop("value")
    found = written(found, "secrets")
    holders = hits.select(
        F.col(key).alias("key"),
        col(repository_col or owner_col).alias("repository"),
        col(owner_col).alias("owner"),
    )
    # written, so that the join starts from a shuffle on both sides and a hot value is split
    owned = written(ownership(found, holders), "secrets-owners")
    spread = F.when(F.col("owners") > 0, F.col("owners")).otherwise(F.col("repositories"))
    judged = found.join(owned, "hash").withColumn("live", spread <= max_owners)
    finding = F.struct("start", "rank", "kind", "end", "value_start", "repositories", "owners", "live")
    lists = judged.groupBy("key").agg(F.array_sort(F.collect_list(finding)).alias("all"))
    # written, so that the join below starts from a shuffle on both sides and hot texts are split
    lists = written(lists.select("key", _listed("all").alias(alias)), "secrets")
    lists = lists.withColumnRenamed("key", key)
    none = F.array().cast(f"array<{_FINDING}>")
    without = docs.where(~has_candidate(text)).withColumn(alias, none)
    with_ = hits.join(lists, key, "left").withColumn(alias, F.coalesce(F.col(alias), none)).drop(key)
    return without.unionByName(with_)


def _listed(name: str) -> Column:
    """Base findings, and live tokens that overlap none of them."""
    first_added = next(i for i, kind in enumerate(KINDS) if not kind.base)

    def fits(x: Column) -> Column:
        overlaps = F.exists(
            F.filter(name, lambda b: b["rank"] < first_added),
            lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]),
        )
        return (x["rank"] < first_added) | (x["live"] & ~overlaps)

    return F.filter(name, fits)


def as_text(findings: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(
        F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


def masked(text: Column, findings: Column, mask: str = MASK) -> Column:
    """The text with the values of live findings replaced; what everyone copies stays."""
    live = F.array_sort(
        F.transform(
            F.filter(findings, lambda x: x["live"]),
            lambda x: F.struct(x["value_start"].alias("start"), x["end"].alias("end")),
        )
    )

    def step(done: Column, x: Column) -> Column:
        before = F.substring(text, done["at"] + 1, F.greatest(x["start"] - done["at"], F.lit(0)))
        out = F.concat(done["out"], before, F.when(x["start"] >= done["at"], mask).otherwise(""))
        grown = F.struct(x["end"].alias("at"), out.alias("out"))
        return F.when(x["end"] <= done["at"], done).otherwise(grown)

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.char_length(text)))
    return F.when(F.size(live) > 0, F.aggregate(live, begin, step, rest)).otherwise(text)


def mask_secrets(docs: DataFrame, text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """The documents with live secrets replaced by :data:`MASK`; all columns stay as they are."""
    name = fresh(docs, "secrets")
    scanned = scan(docs, text_col, owner_col, alias=name)
    return scanned.withColumn(text_col, masked(col(text_col), F.col(name))).select(*[col(c) for c in docs.columns])
