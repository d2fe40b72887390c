"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Matches of each kind are found in whole texts: the parts between matches come from a split by the pattern, and
running sums of their lengths give the places in code points. Kinds ``assign``, ``access`` and ``hex`` make the
base spans. ``bare`` are long mixed tokens outside these, which alone prove nothing.

Only digests of the candidate values leave the scan. They are counted over the corpus by distinct repository and
owner, in steps, so a value copied into a third of all rows is summed before it is shuffled. A value held by at
least ``copied_owners`` owners is a widely copied example; a filler has two different characters at most, or, where
it is longer, one for every eight of its characters, but never more than four; any other is specific to its owners
and looks live. Bare tokens become spans only if they are specific.

Nulls: a null text is empty; a null owner or repository counts as one of its own; a null id stays null. Rows that
are alike get alike results. Empty tables give no rows. Extra columns are not read, or kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhazard.session import cut_lineage

#: (kind, pattern, group that holds the value, least length of the value)
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("bare", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
PART = 256  # running sums are taken within parts of so many entries, and over the parts


def running(values: Column, join) -> Column:
    """Running results of a two-place function over an array of longs that starts from 0, each with its own entry."""
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(values) / PART).cast("int") - 1))
    cut = lambda p: F.slice(values, p * PART + 1, F.lit(PART))
    fold = lambda a: F.aggregate(a, F.lit(0).cast("long"), join)
    totals = F.transform(parts, lambda p: fold(cut(p)))
    return F.flatten(F.transform(parts, lambda p: F.transform(
        cut(p), lambda _, i: join(fold(F.slice(totals, F.lit(1), p)), fold(F.slice(cut(p), F.lit(1), i + 1))))))


def between(hit: Column, gap: Column) -> Column:
    """Distance in code points from the start of each match to that of the one before, or of the text."""
    before = lambda i: F.when(i > 0, F.length(F.element_at(hit, F.greatest(i, F.lit(1))))).otherwise(0)
    return F.transform(hit, lambda _, i: (F.length(F.element_at(gap, i + 1)) + before(i)).cast("long"))


def long_enough(matches: Column, kind: int, least: int) -> Column:
    made = F.transform(matches, lambda x: F.struct(
        x["at"].alias("start"), F.lit(kind).alias("kind"), (x["at"] + F.length(x["hit"])).alias("end"), x["value"].alias("value")))
    return F.filter(made, lambda x: F.length(x["value"]) >= least)


def scan(docs: DataFrame, id_col, text_col, owner, repo) -> DataFrame:
    """(row_key, id, owner, repo, found): found holds (start, kind, end, digest, varied) of base spans and bare tokens in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.to_json(F.struct(F.col(id_col).alias("i"), owner.alias("o"), repo.alias("r")), {"ignoreNullFields": "false"})
    rows = docs.select(
        F.md5(F.concat(mark, F.md5(text))).alias("row_key"), F.col(id_col).alias("id"), owner.alias("owner"), repo.alias("repo"), text.alias("text"))
    none = F.array().cast("array<string>")
    for name, pattern, group, _ in KINDS:
        seen = F.col("text").rlike(pattern)
        rows = rows.withColumn(f"{name}_hit", F.when(seen, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
        rows = rows.withColumn(f"{name}_gap", F.when(F.size(f"{name}_hit") > 0, F.split("text", pattern, -1)).otherwise(none))
        if group:
            rows = rows.withColumn(f"{name}_value", F.when(F.size(f"{name}_hit") > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(none))
    rows = rows.drop("text")
    for k, (name, _, group, least) in enumerate(KINDS):
        hit, gap, value = F.col(f"{name}_hit"), F.col(f"{name}_gap"), F.col(f"{name}_value" if group else f"{name}_hit")
        rows = rows.withColumn(f"{name}_step", between(hit, gap)).withColumn(f"{name}_at", running(F.col(f"{name}_step"), lambda a, b: a + b))
        rows = rows.withColumn(name, long_enough(F.arrays_zip(F.col(f"{name}_at").alias("at"), hit.alias("hit"), value.alias("value")), k, least))
    base = F.concat(*(F.col(k[0]) for k in KINDS[:3]))
    rows = rows.select("row_key", "id", "owner", "repo", F.array_sort(base).alias("base"), "bare")
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]")
    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    rows = rows.select("row_key", "id", "owner", "repo", F.array_sort(F.concat("base", F.filter(F.filter("bare", mixed), free))).alias("found"))
    plain = lambda v: F.greatest(F.lit(2), F.least(F.lit(4), F.floor(F.length(v) / 8)))
    digest = F.transform("found", lambda x: F.struct(
        x["start"], x["kind"], x["end"], F.unhex(F.md5(x["value"])).alias("digest"), (F.size(F.array_distinct(F.split(x["value"], ""))) > plain(x["value"])).alias("varied")))
    return rows.select("row_key", "id", "owner", "repo", digest.alias("found"))


def owned(scanned: DataFrame) -> DataFrame:
    """(digest, repos, owners): in how many different repositories and with how many owners a value occurs."""
    held = scanned.filter(F.size("found") > 0).select(F.explode("found.digest").alias("digest"), "owner", "repo")
    per_owner = held.distinct().groupBy("digest", "owner").agg(F.count("*").alias("repos"))
    return per_owner.groupBy("digest").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def judged(scanned: DataFrame, copied_owners) -> DataFrame:
    """(row_key, spans) of the rows with candidates: spans in order as (start, kind, end, owners, verdict), specific bare tokens among them."""
    verdict = F.when(F.col("owners") >= copied_owners, "example").when(~F.col("span.varied"), "filler").otherwise("specific")
    each = scanned.filter(F.size("found") > 0).select("row_key", F.explode(F.array_distinct("found")).alias("span")).distinct()
    each = each.join(owned(scanned), F.col("span.digest") == F.col("digest"))
    kept = each.select("row_key", F.struct("span.start", "span.kind", "span.end", "owners", verdict.alias("verdict")).alias("span"))
    kept = kept.filter((F.col("span.kind") < 3) | (F.col("span.verdict") == "specific"))
    return kept.groupBy("row_key").agg(F.array_sort(F.collect_list("span")).alias("spans"))  # the spans of one text


def find_secrets(docs: DataFrame, owner: Column, repo: Column, id_col="doc_id", text_col="text", copied_owners=3) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_specific, n_example."""
    scanned = cut_lineage(scan(docs, id_col, text_col, owner, repo))
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    count = lambda column, test: F.size(F.filter(column, test)).cast("long")
    of_kind = lambda k: lambda x: x["kind"] == k
    base = scanned.select(
        "row_key", F.col("id").alias(id_col), *(count("found", of_kind(k)).alias(f"n_{KINDS[k][0]}") for k in range(3)),
        F.sha2(told(F.filter("found", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), (F.size("found") > 0).alias("any"))
    with_any = base.filter("any").join(judged(scanned, copied_owners), "row_key", "left").select(
        id_col, "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(told(F.col("spans")), F.lit("")).alias("spans"),
        F.coalesce(count("spans", lambda x: x["verdict"] == "specific"), F.lit(0).cast("long")).alias("n_specific"),
        F.coalesce(count("spans", lambda x: x["verdict"] == "example"), F.lit(0).cast("long")).alias("n_example"))
    zero = F.lit(0).cast("long")
    without = base.filter("not any").select(
        id_col, "n_assign", "n_access", "n_hex", "base_sha256", F.lit("").alias("spans"), zero.alias("n_specific"), zero.alias("n_example"))
    return with_any.union(without)


def redact(docs: DataFrame, owner: Column, repo: Column, id_col="doc_id", text_col="text", copied_owners=3, mask="[secret]") -> DataFrame:
    """All documents, all columns as they are but the text, in which specific secrets are replaced by the mask."""
    scanned = cut_lineage(scan(docs, id_col, text_col, owner, repo))
    specific = F.filter("spans", lambda x: x["verdict"] == "specific")
    spans = cut_lineage(judged(scanned, copied_owners).select("row_key", specific.alias("spans")).filter(F.size("spans") > 0))
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.to_json(F.struct(F.col(id_col).alias("i"), owner.alias("o"), repo.alias("r")), {"ignoreNullFields": "false"})
    rows = docs.select(F.struct("*").alias("row"), F.md5(F.concat(mark, F.md5(text))).alias("own_key"), text.alias("own_text"))
    rows = rows.join(spans.withColumnRenamed("row_key", "own_key"), "own_key", "left")
    rows = rows.withColumn("ends", running(F.transform("spans", lambda x: x["end"]), lambda a, b: F.greatest(a, b)))
    before = lambda i: F.when(i > 0, F.element_at("ends", F.greatest(i, F.lit(1)))).otherwise(0)
    piece = lambda x, i: F.when(x["start"] >= before(i), F.concat(
        F.substring(F.col("own_text"), (before(i) + 1).cast("int"), (x["start"] - before(i)).cast("int")), F.lit(mask))).otherwise("")
    tail = F.substring(F.col("own_text"), (F.element_at("ends", -1) + 1).cast("int"), F.length("own_text"))
    masked = F.when(F.col("spans").isNull(), F.col(f"row.{text_col}")).otherwise(F.concat(F.array_join(F.transform("spans", piece), ""), tail))
    return rows.select(*(masked.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
