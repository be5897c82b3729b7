"""Bibliography operators: entries from lines, equality up to an edit, notes that point to notes, identities, votes.

J22, J25, J27, J31 to J34, J47 to J49, J51, W6, F16 to F18, F24, A15, A18, A20, F42.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracery.functions.text import any_alias, expand_numbers, in_domain, word_list

#: What opens a numbered entry; a bullet line; a note that names another or the one before.
PRINTED_LABEL = r"^\s*(?:\[\d{1,4}\]|\d{1,4}[.)])\s+\S"
BULLET = r"^\s*[•●▪]\s*"
SUPRA = r"(?i)\b(?:supra|above)\s+n(?:ote)?\.?\s*(\d{1,3})"
IBID = r"(?i)^\s*(?:ibid|id)\b\.?"
STOP = ("the", "and", "for", "from", "with", "that", "this", "into", "are", "was", "report")


def entries(lines: DataFrame, starts: Column) -> DataFrame:
    """Lines (doc_id, seq, page, text) as entries that open where ``starts`` holds or the document begins."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    opened = F.when(starts | (F.row_number().over(w) == 1), 1).otherwise(0)
    rows = lines.withColumn("__open", opened).withColumn("entry", F.sum("__open").over(w))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    joined = F.array_join(F.transform(ordered, lambda x: F.trim(x["text"])), " ")
    return rows.groupBy("doc_id", "entry").agg(joined.alias("raw"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.collect_set("page").alias("pages"))


def numbered_entries(lines: DataFrame) -> DataFrame:
    return entries(lines, F.col("text").rlike(PRINTED_LABEL))


def bullet_entries(lines: DataFrame, names: list[str]) -> DataFrame:
    """Entries that bullets bound, within a page, whose text before the first year names the target."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    turned = F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(False))
    flagged = lines.withColumn("__turn", turned)
    rows = entries(flagged, F.col("text").rlike(BULLET) | F.col("__turn"))
    signed = F.regexp_extract("raw", rf"{BULLET}(.*?)\b(?:19|20)\d{{2}}[a-z]?\b", 1)
    return rows.where(F.col("raw").rlike(BULLET) & (signed != "") & signed.rlike(any_alias(names)))


def entry_key(raw: Column) -> Column:
    """An entry's letters and digits without its printed label."""
    return F.regexp_replace(F.lower(F.regexp_replace(raw, r"^\s*(?:\[\d+\]|\d+[.)])\s*", "")), r"[^\p{L}\p{N}]", "")


def almost_equal(a: Column, b: Column, least: int = 20) -> Column:
    """Equal keys, or keys of ``least`` or more that one edit parts and whose digits agree."""
    x, y = entry_key(a), entry_key(b)
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    near = (F.least(F.length(x), F.length(y)) >= least) & (F.levenshtein(x, y, 1) == 1) & (digits(x) == digits(y))
    return F.coalesce((x == y) | near, F.lit(False))


def present_entries(new: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, new_id, known_id) where exactly one known entry is the same. The first letters bring pairs together."""
    lead = F.substring(entry_key(F.col("raw")), 1, 10)
    tail = F.substring(F.reverse(entry_key(F.col("raw"))), 1, 10)  # half of the least length each: one edit leaves one end as it is
    both = lambda df, name: df.select("doc_id", F.col("id").alias(name), F.col("raw").alias(f"{name}_raw"), F.explode(F.array(F.concat(F.lit("<"), lead), F.concat(F.lit(">"), tail))).alias("end"))
    pairs = both(new, "new_id").join(both(known, "known_id"), ["doc_id", "end"]).where(almost_equal(F.col("new_id_raw"), F.col("known_id_raw")))
    found = pairs.groupBy("doc_id", "new_id").agg(F.count_distinct("known_id").alias("n"), F.min("known_id").alias("known_id"))
    return found.where("n = 1").drop("n")


def resolved_notes(notes: DataFrame, depth: int = 20) -> DataFrame:
    """(doc_id, page, number, source): the text that each note stands for.

    A note that names a smaller, unique number is that note; ``ibid`` is the note before it, on its page. Rounds follow
    the pointers all at once and double their reach, so chains of 2^k take k rounds, and a cycle never ends in a source.
    """
    unique = F.count("*").over(Window.partitionBy("doc_id", "number")) == 1
    named = F.regexp_extract("text", SUPRA, 1).try_cast("int")
    to = F.when(named < F.col("number"), named).when(F.col("text").rlike(IBID), F.col("number") - 1)
    rows = notes.withColumns({"__unique": unique, "to": to, "__ibid": F.col("text").rlike(IBID) & named.isNull()})
    ends = rows.where("__unique").select("doc_id", F.col("number").alias("to"), F.col("to").alias("next"), F.col("page").alias("next_page"), F.when(F.col("to").isNull() & ~F.col("text").rlike(SUPRA), F.col("text")).alias("next_source"), F.col("text").contains(";").alias("mixed"))
    own = F.when(F.col("to").isNull() & ~F.col("text").rlike(SUPRA), F.col("text"))
    state = rows.withColumn("source", own)
    first = state.join(ends, ["doc_id", "to"], "left")
    allowed = ~F.col("__ibid") | ((F.col("next_page") == F.col("page")) & ~F.col("mixed"))
    state = first.select("doc_id", "page", "number", F.coalesce("source", F.when(allowed, F.col("next_source"))).alias("source"), F.when(F.col("source").isNull() & allowed, F.col("next")).alias("to"))
    hops = 1
    while hops < depth:
        ends = state.groupBy("doc_id", F.col("number").alias("to")).agg(F.count("*").alias("n"), F.min("source").alias("next_source"), F.min("to").alias("next")).where("n = 1").drop("n")
        state = state.join(ends, ["doc_id", "to"], "left").select("doc_id", "page", "number", F.coalesce("source", "next_source").alias("source"), F.when(F.coalesce("source", "next_source").isNull(), F.col("next")).alias("to"))
        hops *= 2
    return state.drop("to")


def bracket_ranges(mentions: DataFrame) -> DataFrame:
    """(doc_id, paragraph_id, ordinal, numbers): two bracketed numbers with nothing but a dash between are a range.

    mentions: (doc_id, paragraph_id, ordinal, raw_marker, start, end, text), text being the paragraph's.
    """
    w = Window.partitionBy("doc_id", "paragraph_id").orderBy("start")
    rows = mentions.withColumns({"n_start": F.lead("start").over(w), "n_end": F.lead("end").over(w), "n_marker": F.lead("raw_marker").over(w)})
    between = F.expr("substring(text, end + 1, n_start - end)")
    whole = F.expr("substring(text, start + 1, n_end - start)")
    single = r"^\[\d+\]$"
    ok = F.col("raw_marker").rlike(single) & F.col("n_marker").rlike(single) & between.rlike(r"^\s*[‐-―−-]\s*$")
    numbers = expand_numbers(F.concat(F.lit("["), F.regexp_replace(whole, r"[\[\]\s]", ""), F.lit("]")))
    return rows.where(ok).select("doc_id", "paragraph_id", "ordinal", numbers.alias("numbers")).where(F.size("numbers") > 0)


def _below(domain: str):
    return lambda host: in_domain(host, domain)


def organization_evidence(references: DataFrame, names: list[str], domains: list[str]) -> DataFrame:
    """Each reference with the kinds of evidence that name an organization, and whether it mixes entries.

    A name within a title is no evidence of authorship: only what stands before the year is.
    """
    pattern = any_alias(names)
    signature = F.regexp_extract("raw", r"^(.*?)\b(?:19|20)\d{2}[a-z]?\b", 1)
    urls = F.regexp_extract_all("raw", F.lit(r"https?://[^\s<>\"]+"), 0)
    hosts = F.transform(urls, lambda u: F.lower(F.try_parse_url(u, F.lit("HOST"))))
    own = F.lit(False)
    for d in domains:
        own = own | F.exists(hosts, _below(d))
    evidence = F.array_compact(
        F.array(
            F.when(signature.rlike(pattern), "signature"),
            F.when(F.col("raw").rlike(rf"(?i)(?:published by|publisher:|:)\s*(?:{pattern})"), "publisher"),
            F.when(F.col("raw").rlike(r"(?i)\b(?:commissioned|prepared) (?:by|for)\b") & F.col("raw").rlike(pattern), "commissioned"),
            F.when(own, "domain"),
        )
    )
    starts = F.regexp_extract_all("raw", F.lit(r",\s*(?:19|20)\d{2}[a-z]?\.\s+\p{Lu}"), 0)
    return references.select("*", evidence.alias("evidence"), (F.size(starts) > 1).alias("needs_reference_split"))


def names_edition(catalog_title: Column, title: Column, cited_year: Column, catalog_date: Column, minor: list[str], added: list[str], least: int = 4, most: int = 8) -> Column:
    """Whether a cited title is a catalogue title of the same year with nothing of its own after it.

    The target's configuration says which words are ``minor`` (a catalogue title needs ``least`` others to be told from
    a phrase) and which may be ``added`` after the title, ``most`` words in all, without naming another work.
    """
    whole, cited, year = word_list(catalog_title), word_list(title), F.regexp_extract(cited_year, r"^\d{4}", 0)
    minor_, added_ = (F.array(*[F.lit(w) for w in words]).cast("array<string>") for words in (minor, added))
    opens = F.startswith(F.array_join(F.concat(cited, F.array(F.lit(""))), " "), F.array_join(F.concat(whole, F.array(F.lit(""))), " "))
    told_apart = F.size(F.filter(whole, lambda w: ~F.array_contains(minor_, w))) >= least
    rest = F.slice(cited, F.size(whole) + 1, F.greatest(F.size(cited) - F.size(whole), F.lit(0)))
    own = F.size(F.array_except(rest, F.array_append(added_, year)))
    return F.coalesce(told_apart & opens & (own == 0) & (F.size(rest) <= most) & (year != "") & F.contains(catalog_date, year), F.lit(False))


def significant_words(text: Column) -> Column:
    """a text's words of three letters or more, each once, without the common ones."""
    return F.array_distinct(F.filter(word_list(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOP)))


def conflicts(prose: DataFrame, references: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, paragraph_id, reference_id): prose that names all of one title's words, but links elsewhere.

    prose: (doc_id, paragraph_id, text); references: (doc_id, id, title); edges: (doc_id, paragraph_id, reference_id).
    Titles meet prose on their longest word.
    """
    titles = references.select("doc_id", F.col("id").alias("reference_id"), significant_words(F.col("title")).alias("t")).where("size(t) >= 3")
    titles = titles.withColumn("w", F.array_max(F.transform("t", lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"])
    words = prose.select("doc_id", "paragraph_id", significant_words(F.col("text")).alias("p"))
    met = words.withColumn("w", F.explode("p")).join(titles, ["doc_id", "w"]).where(F.size(F.array_except("t", "p")) == 0)
    one = met.groupBy("doc_id", "paragraph_id").agg(F.count_distinct("reference_id").alias("n"), F.min("reference_id").alias("reference_id")).where("n = 1").drop("n")
    linked = edges.select("doc_id", "paragraph_id").distinct()
    return one.join(linked, ["doc_id", "paragraph_id"], "left_semi").join(edges, ["doc_id", "paragraph_id", "reference_id"], "left_anti")


def reconciled(findings: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Findings with the one occurrence of their paragraph that encloses them, or none."""
    f, o = findings.alias("f"), occurrences.alias("o")
    inside = (F.col("f.paragraph_id") == F.col("o.paragraph_id")) & (F.col("o.start") <= F.col("f.start")) & (F.col("f.end") <= F.col("o.end"))
    hits = f.join(o, inside).groupBy("f.finding_id").agg(F.count("*").alias("n"), F.min("o.location_id").alias("location_id"))
    return findings.join(hits, "finding_id", "left").select("finding_id", F.when(F.col("n") == 1, F.col("location_id")).alias("resolved_by"), F.coalesce(F.col("n") == 1, F.lit(False)).alias("resolved"))


#: Frequent short words by language.
COMMON = {
    "en": "the of and to in is that for with as are this by be on from",
    "fr": "le la les des et est une dans pour que qui sur par avec du au",
    "de": "der die das und ist nicht ein eine mit von zu den auf für im",
    "es": "el los las que y una en por con para del se es como más",
}


def _one_of(words: list[str]):
    return lambda w: w.isin(*words)


def language_of(text: Column) -> Column:
    """(lang, confidence) by the share of each language's frequent words; no detector library is needed."""
    words = word_list(F.regexp_replace(text, r"https?://\S+", " "))
    scored = []
    for lang, common in COMMON.items():
        held = F.size(F.filter(words, _one_of(common.split())))
        scored.append(F.struct(held.alias("n"), F.lit(lang).alias("lang")))
    best = F.array_max(F.array(*scored))
    total = sum((s["n"] for s in scored), F.lit(0))
    return F.struct(F.when(total > 0, best["lang"]).alias("lang"), F.when(total > 0, best["n"] / total).otherwise(0.0).alias("confidence"))


def page_vote(pages: DataFrame, sure: float = 0.9, english: float = 0.8, other: float = 0.5, least: int = 200) -> DataFrame:
    """Per document, a vote of its pages (doc_id, page, text); body pages alone vote if there are two."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    votes = pages.where(letters >= least).select("doc_id", "page", language_of(F.col("text")).alias("v"))
    body = F.count_if(F.col("page") > 1).over(Window.partitionBy("doc_id"))
    used = votes.withColumn("__body", body).where((F.col("__body") < 2) | (F.col("page") > 1))
    confident = F.col("v.confidence") >= sure
    shares = used.groupBy("doc_id").agg((F.count_if(confident & (F.col("v.lang") == "en")) / F.count("*")).alias("en"), (F.count_if(confident & (F.col("v.lang") != "en")) / F.count("*")).alias("non_en"))
    status = F.when(F.col("en") >= english, "english").when(F.col("non_en") > other, "non_english").otherwise("uncertain")
    return pages.select("doc_id").distinct().join(shares, "doc_id", "left").select("doc_id", F.coalesce(status, F.lit("uncertain")).alias("status"))


def main_size(spans: DataFrame) -> DataFrame:
    """The font size that most text of a page has; spans: (doc_id, page, size, text)."""
    sizes = spans.groupBy("doc_id", "page", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return sizes.groupBy("doc_id", "page").agg(F.max_by("size", F.struct("n", "size")).alias("main_size"))
