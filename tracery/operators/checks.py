"""Rules on records and their counts: what counts as a candidate, a label, a bound task, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracery.functions.text import url_key

#: The reviewed roles that are no authorship, and the form of a year that stands alone.
NO_AUTHOR = ("publisher", "commissioned", "mention", "unrelated")
LONE_YEAR = r"^\s*\(?(18|19|20)[0-9]{2}[a-z]?\)?\s*$"


def numbers_of_marker(marker: Column, numbers: Column, labels: Column) -> Column:
    """The marker's numbers; none for a year alone, unless an entry has that label. Null labels are none."""
    known = F.coalesce(F.arrays_overlap(numbers, labels), F.lit(False))
    return F.when(marker.rlike(LONE_YEAR) & ~known, F.slice(numbers, 1, 0)).otherwise(numbers)


def is_candidate(identity: Column, role: Column, catalogued: Column, mixed: Column, link_status: Column) -> Column:
    """Whether a link to a reference counts; a null role, flag or status does not speak against it or for it."""
    author = ~F.coalesce(role.isin(*NO_AUTHOR), F.lit(False)) | F.coalesce(catalogued, F.lit(False))
    whole = ~F.coalesce(mixed, F.lit(False)) | link_status.eqNullSafe(F.lit("needs_reference_split"))
    return identity.isNotNull() & author & whole


def download_problem(status: Column, location: Column, digest: Column, known: list[str]) -> Column:
    """Why a download cannot be registered; null if it can."""
    said, place = F.lower(F.trim(F.coalesce(digest, F.lit("")))), F.trim(F.coalesce(location, F.lit("")))
    there = (place != "") & said.rlike("^[0-9a-f]{64}$")
    return F.when(~F.coalesce(status.isin(*known), F.lit(False)), "unknown status").when((status == "available") & ~there, "no location or digest")


def evidence_issues(pages: DataFrame, candidates: DataFrame, paper: str) -> DataFrame:
    """(paper, issue, n) of what a reader would miss; pages: page, text, parser_pages; candidates: sentence, coordinates.

    A paper without candidates is told by its pages alone; blank text is no text.
    """
    def blank(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""

    seen = pages.groupBy(paper).agg(F.count_if(blank("text")).alias("no_text_layer"), F.when(F.coalesce(F.max("parser_pages"), F.lit(-1)) != F.count("*"), 1).otherwise(0).cast("long").alias("page_count_differs"))
    found = candidates.groupBy(paper).agg(F.count_if(blank("sentence")).alias("no_sentence"), F.count_if(blank("coordinates")).alias("no_coordinates"))
    kinds = ["no_text_layer", "page_count_differs", "no_sentence", "no_coordinates"]
    return seen.join(found, paper, "full").unpivot([paper], kinds, "issue", "n").where("n > 0")


def structure_summary(parts: DataFrame, key: str, kind: str, text: str) -> DataFrame:
    """Parts, kinds, empty parts and characters of each key, and of all keys in the row whose key is null."""
    return parts.where(F.col(key).isNotNull()).rollup(key).agg(
        F.count("*").alias("parts"),
        F.count_distinct(kind).alias("kinds"),
        F.count_if(F.coalesce(F.length(text), F.lit(0)) == 0).alias("empty"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"),
    )


def linked_hits(hits: DataFrame, references: DataFrame, keys: list[str], mixed: Column) -> DataFrame:
    """``hits`` with the number of references under their keys and the link's status; no hit is multiplied."""
    targets = references.groupBy(*keys).agg(F.count("*").alias("targets"), F.bool_or(mixed).alias("__mixed"))
    status = F.when(F.col("targets").isNull(), "unlinked").when(F.col("__mixed"), "needs split").when(F.col("targets") == 1, "unique").otherwise("ambiguous")
    return hits.join(targets, keys, "left").withColumn("status", status).withColumn("targets", F.coalesce("targets", F.lit(0))).drop("__mixed")


def report_id(url: Column) -> Column:
    """a report's id from its URL's key."""
    return F.substring(F.sha2(url_key(url), 256), 1, 16)


def merged_totals(rows: DataFrame, by: list[str], totals: str) -> DataFrame:
    """maps added up name by name: (by, name, total)."""
    return rows.select(*by, F.explode(totals).alias("name", "n")).groupBy(*by, "name").agg(F.sum("n").alias("total"))


def best_rows(rows: DataFrame, keys: list[str], score: str, ties: list[Column]) -> DataFrame:
    """Of each key the row of the highest score, then of the highest ``ties``; one aggregation, no sort of a group."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), *ties)).alias("best"))
    return best.select(*keys, "best.*")


def numbering_problems(assigned: DataFrame, settings: DataFrame) -> DataFrame:
    """Q3: (kind, problem, n) of assignments (kind, key, number) under settings (kind, current, width), a row a kind."""
    used = assigned.groupBy("kind", "number").agg(F.count("*").alias("uses"), F.count_if(F.coalesce(F.col("key"), F.lit("")) == "").alias("without_key"))
    beyond = F.col("number").isNull() | (F.col("number") < 1) | (F.col("number") > F.col("current"))
    per = used.join(F.broadcast(settings), "kind").groupBy("kind").agg(  # a row for each kind of number
        F.sum("without_key").alias("without key"),
        F.sum(F.when(beyond, F.col("uses")).otherwise(0)).alias("out of range"),
        F.sum(F.when(F.col("number").isNotNull(), F.col("uses") - 1).otherwise(0)).alias("number used twice"),
    )
    wrong = settings.where("width < 1 or width > 18 or current < 0").select("kind", F.lit("settings").alias("problem"), F.lit(1).cast("long").alias("n"))
    return per.unpivot(["kind"], ["without key", "out of range", "number used twice"], "problem", "n").where("n > 0").unionByName(wrong)


def hash_agreement(source: DataFrame, parsed: DataFrame, key: str, digest: str) -> DataFrame:
    """Q6: each source with what its parser's digest says: equal, differs or missing. Keys are unique on both sides."""
    other = parsed.select(key, F.col(digest).alias("__parsed"))
    said = F.when(F.col("__parsed").isNull(), "missing").when(F.col("__parsed") == F.col(digest), "equal").otherwise("differs")
    return source.join(other, key, "left").withColumn("agreement", said).drop("__parsed")


def single_target(rows: DataFrame, batch: str, target: str) -> DataFrame:
    """Q7: per batch the number of its targets and whether it may run; null targets count as none."""
    return rows.groupBy(batch).agg(F.count_distinct(target).alias("targets")).withColumn("may_run", F.col("targets") <= 1)


def bound_tasks(tasks: DataFrame, profiles: DataFrame, keys: list[str], config: list[str]) -> DataFrame:
    """The tasks of profiles with the same keys and the same fingerprint of ``config``; changed profiles get none."""
    own = profiles.select(*keys, fingerprint(config).alias("fingerprint")).distinct()
    return tasks.join(own, [*keys, "fingerprint"], "left_semi")


def fingerprint(config: list[str]) -> Column:
    """A digest of settings in which nulls and borders between values count."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in config]), 256)


def result_metrics(tasks: DataFrame, results: DataFrame, key: str, record: str, status: str, order: str) -> DataFrame:
    """``tasks`` with their records and the statuses of these as sorted JSON; a record's first row decides, no result is 0 and {}."""
    first = results.withColumn("__s", F.coalesce(F.col(status), F.lit("unknown"))).groupBy(key, record).agg(F.min_by("__s", F.struct(order, "__s")).alias("__s"))
    counts = first.groupBy(key, "__s").agg(F.count("*").alias("__n"))
    per = counts.groupBy(key).agg(F.sum("__n").alias("records"), F.array_sort(F.collect_list(F.struct("__s", "__n"))).alias("__all"))  # an entry a status
    out = tasks.join(per, key, "left")
    return out.withColumn("records", F.coalesce("records", F.lit(0))).withColumn("statuses", F.coalesce(F.to_json(F.map_from_entries("__all")), F.lit("{}"))).drop("__all")
