"""Secrets in documents, told apart by how widely their values are owned.

Three kinds are found by their form: ``assign`` (a value assigned to a name like password or token), ``access`` (access key ids) and
``hex`` (runs of hexadecimal digits). A fourth kind, ``opaque``, is any other long run of key signs with letters and digits, which is a
secret only if the corpus says so: every value's hash is aggregated over all documents by distinct repositories and owners; a value
of one owner in few repositories looks live, a widely copied one is an example. Spans of the first three kinds are always
returned; those of ``opaque`` only if they look live and their value is nowhere found as another kind.

Matches are leftmost and non-overlapping for each kind, and those that are too short are dropped afterwards. Places are code points,
ends exclusive. Null and empty texts have none. Repeated rows each get their result; a null owner or repository isn't counted.

Only DataFrame functions are used. Places come from the lengths of the pieces between the matches, summed by a window over the
matches of one document. A value that a third of all rows hold is combined before the shuffle that counts its owners, and is on the
wide side of the join that brings the counts back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Forms of secrets, in the order of their kinds; group 2 is the value of an assignment.
KINDS = ["assign", "access", "hex", "opaque"]
FORMS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",  # the runs of hexadecimal digits that are long enough
    "opaque": r"(?<![A-Za-z0-9+/_=-])(?=[A-Z0-9+/_=-]*[a-z])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{24,}",
}
LEAST = {"assign": 12, "access": 18, "hex": 16, "opaque": 24}
#: Cheaper signs that a form may be there at all.
HINTS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": FORMS["hex"], "opaque": FORMS["opaque"]}
#: A value that looks live has so many owners and repositories at most.
LIVE_OWNERS, LIVE_REPOSITORIES = 1, 3
ROW = ["id", "row"]
OPAQUE = KINDS.index("opaque")


def pieces(text: Column, kind: str) -> Column:
    """An array with an entry for each match: the length of the text before it, its own length, and its value."""
    form = F.lit(FORMS[kind])
    gaps = F.transform(F.split(text, FORMS[kind], -1), F.char_length)
    whole = F.regexp_extract_all(text, form, F.lit(0))
    value = F.regexp_extract_all(text, form, F.lit(2)) if kind == "assign" else whole
    zipped = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.char_length).alias("size"), value.alias("value"))
    named = F.transform(
        F.filter(zipped, lambda x: x["size"].isNotNull()),
        lambda x: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.char_length(x["value"]).alias("chars"), F.md5(F.encode(x["value"], "UTF-8")).alias("digest")),
    )
    return F.when(text.rlike(HINTS[kind]), named)


def candidate_spans(docs: DataFrame) -> DataFrame:
    """A row (``id``, ``row``, ``owner``, ``repository``, ``kind``, ``start``, ``end``, ``digest``) for each match of ``docs``
    (``id``, ``text``, ``owner``, ``repository``) that is long enough."""
    kinds = F.array(*[F.struct(F.lit(no).alias("kind"), pieces(F.col("text"), k).alias("found")) for no, k in enumerate(KINDS)])
    found = docs.select(
        "id", F.xxhash64("text").alias("row"), "owner", "repository", F.filter(kinds, lambda x: F.size(x["found"]) > 0).alias("kinds")
    ).where(F.size("kinds") > 0)
    # repeated rows are looked at once, with an owner of each
    found = found.groupBy(*ROW, "owner", "repository").agg(F.first("kinds").alias("kinds"))
    each = found.select(*ROW, "owner", "repository", F.explode("kinds").alias("k"))
    each = each.select(*ROW, "owner", "repository", "k.kind", F.posexplode("k.found").alias("no", "x"))
    order = Window.partitionBy(*ROW, "owner", "repository", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap").cast("long") + F.col("x.size")).over(order)
    spans = each.select("*", end.alias("end"))
    least = F.element_at(F.array(*[F.lit(LEAST[k]) for k in KINDS]), F.col("kind") + 1)
    return spans.where(F.col("x.chars") >= least).select(
        *ROW, "owner", "repository", "kind", (F.col("end") - F.col("x.size")).alias("start"), "end", F.col("x.digest").alias("digest")
    )


def ownership(spans: DataFrame) -> DataFrame:
    """How many distinct owners and repositories hold each value, whether it looks live, and whether a form of its own finds it."""
    counts = spans.groupBy("digest").agg(
        F.count_distinct("owner").alias("owners"),
        F.count_distinct("repository").alias("repositories"),
        F.min("kind").alias("first_kind"),
    )
    return counts.withColumn("live", (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id`` and the array ``spans`` of (start, kind number, end, kind, live, owners, repositories),
    sorted by start, then by kind."""
    source = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.col(owner).alias("owner"), F.col(repository).alias("repository")
    )
    spans = candidate_spans(source)
    judged = spans.join(ownership(spans), "digest").where((F.col("kind") < OPAQUE) | F.col("live") & (F.col("first_kind") == OPAQUE))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    by_row = judged.groupBy(*ROW).agg(
        F.sort_array(F.collect_set(F.struct("start", "kind", "end", name.alias("name"), "live", "owners", "repositories"))).alias("spans")
    )
    all_rows = source.select("id", F.xxhash64("text").alias("row"))
    found = by_row.withColumnsRenamed({"id": "i", "row": "r"})
    joined = all_rows.join(found, all_rows["id"].eqNullSafe(found["i"]) & (all_rows["row"] == found["r"]), "left")
    return joined.select(F.col("id").alias("doc_id"), F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))
