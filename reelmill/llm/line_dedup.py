"""Repeated lines, found with levelled sorted runs of line hashes.

Batches of documents arrive from the largest ids to the smallest. A run is a sorted table of line hashes: in how many documents of
the batch a line was found, and its keeper (the largest document id) if no earlier batch had it. Each new batch is merge-anti-joined
with the runs, which tells the lines that are new and so get their keeper, and adds its own run. When ``FAN_OUT`` runs of a level
have come together they are compacted into one run of the next level, so a hash is rewritten once per level only.

A line's key is the line without white space (space, tab to carriage return) at its ends, A to Z as small letters. Keys of at least
``least_chars`` code points found in at least ``least_documents`` documents lose all their lines but those in the keeper. Keys are
told apart by 128 bits of hash. A null text is one empty line. Each row counts as a document; rows of one id that differ are kept
apart, and a null id is smaller than any other.

Only DataFrame operations are used, on lines dealt by hash: a line that a third of all documents hold is combined before its hash
is shuffled, and its occurrences are on the wide side of a join that adaptive execution splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm.store import forget, stored

WHITE = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCHES, FAN_OUT = 4, 2
KEY = ["h1", "h2"]


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), CAPITALS, SMALL)


def row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class LineRuns:
    """The runs so far, newest last in each level."""

    def __init__(self, fan_out: int = FAN_OUT):
        self.levels: list[list[DataFrame]] = []
        self.fan_out = fan_out

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def sorted_run(rows: DataFrame) -> DataFrame:
        return stored(rows.repartition(*KEY).sortWithinPartitions(*KEY), "run")

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def add(self, lines: DataFrame) -> None:
        """Take in a batch: a row (``h1``, ``h2``, ``id``) for each different line of each document."""
        batch = lines.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        if not self.runs():
            run = batch
        else:
            known = reduce(DataFrame.unionByName, [r.where("keeper is not null").select(*KEY) for r in self.runs()])
            fresh = batch.join(known, KEY, "left_anti")
            seen = batch.join(known, KEY, "left_semi").withColumn("keeper", F.lit(None).cast(batch.schema["keeper"].dataType))
            run = fresh.unionByName(seen)
        self.put(0, self.sorted_run(run))

    def put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_out:
            full, self.levels[level] = self.levels[level], []
            self.put(level + 1, self.sorted_run(self.merged(full)))
            for old in full:
                forget(old)

    def repeated(self, least: int) -> DataFrame:
        """Lines found in at least ``least`` documents, with their keepers."""
        return self.merged(self.runs()).where(F.col("n") >= least).select(*KEY, "keeper")


def long_lines(docs: DataFrame, id: Column, text: Column, least_chars: int) -> DataFrame:
    """A row (``id``, ``row``, ``h1``, ``h2``, ``line_no``, ``first``) for each line whose key is long enough; ``first`` marks a
    line's first place in its document."""
    keyed = docs.select(
        id.alias("id"),
        row_hash(text).alias("row"),
        F.filter(
            F.transform(line_array(text), lambda line, i: F.struct(line_key(line).alias("k"), i.alias("line_no"))),
            lambda x: F.char_length(x["k"]) >= least_chars,
        ).alias("lines"),
    ).where(F.size("lines") > 0)
    hashed = keyed.select(
        "id", "row",
        F.sort_array(
            F.transform("lines", lambda x: F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit(1), x["k"]).alias("h2"), x["line_no"].alias("line_no")))
        ).alias("lines"),
    )
    flat = hashed.select("id", "row", F.posexplode("lines").alias("place", "x"), F.col("lines"))
    before = F.get("lines", F.col("place") - 1)
    first = F.coalesce((before["h1"] != F.col("x.h1")) | (before["h2"] != F.col("x.h2")), F.lit(True))
    return flat.select("id", "row", "x.h1", "x.h2", "x.line_no", first.alias("first"))


def cuts_between(docs: DataFrame, doc_id: str, parts: int, error: float) -> list[float]:
    """Ids between about equal ranges of documents; none for an empty table."""
    return docs.select(doc_id).where(F.col(doc_id).isNotNull()).approxQuantile(doc_id, [i / parts for i in range(parts + 1)], error)[1:-1]


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 40, least_documents: int = 5, batches: int = BATCHES
) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines (a null text stays null if it loses nothing), and the columns ``n_lines``
    (before) and ``n_dropped``, which replace input columns of those names."""
    kept = docs.select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    lines = long_lines(kept, F.col(doc_id), F.col(text), least_chars)
    cuts = cuts_between(kept, doc_id, batches, 0.01)
    batch = reduce(lambda x, cut: x - F.when(F.col("id") > cut, 1).otherwise(0), cuts, F.lit(len(cuts)))
    lines = stored(lines.withColumn("batch", batch), "lines", "batch")

    runs = LineRuns()
    for b in range(len(cuts) + 1):  # from the largest ids on
        runs.add(lines.where((F.col("batch") == b) & F.col("first")).select(*KEY, "id"))
    repeated = runs.repeated(least_documents)
    doomed = lines.join(repeated, KEY).where(~F.col("id").eqNullSafe(F.col("keeper")))
    doomed = doomed.groupBy("id", "row").agg(F.collect_set("line_no").alias("__dropped")).withColumnsRenamed({"id": "__id", "row": "__row"})

    marked = kept.withColumn("__hash", row_hash(F.col(text)))
    joined = marked.join(doomed, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__row")), "left")
    all_lines = line_array(F.col(text))
    rest = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__dropped"))
    cleaned = F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(rest, lambda i: F.get(F.col("__lines"), i)), "\n")
    )
    out = joined.withColumn("__lines", all_lines)
    return out.select(
        *[cleaned.alias(c) if c == text else F.col(c) for c in kept.columns],
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__dropped").isNull(), 0).otherwise(F.size("__dropped")).cast("long").alias("n_dropped"),
    )
