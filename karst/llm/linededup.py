"""Line deduplication over overlapping three-line windows.

Lines are cut into runs of at most RUN words, so that a passage of more than three
times as many less one holds three runs even where it stands in one line or two; a
shorter line is one run.  Every three consecutive runs of a text are hashed (128
bits).  Of equal windows anywhere in the corpus the first, by doc_id and then place,
stays; all later ones are marked, the runs they cover are merged per document, and
those go; what is left of a line stays a line.  Each run that goes has an equal one
earlier, so a passage is never lost whole.  A passage that begins inside a run is cut
at other words than its copies and is only found from the next line on.

Windows are shuffled as hashes and pre-aggregated; only documents' texts are
joined to what goes from them.

Defined results: a null text stays null; texts of fewer than three runs have no
window and stay; a text whose runs all go becomes empty, and its row stays; rows
with the same doc_id and text are one document and each gets its result; null
doc_ids come first; the columns of the input, whatever their names, are kept, and
where one has the name of the result, the result's gets a line beneath more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.llm.common import free_name, stored

WIDTH = 3
RUN = 17
_NULL_ID = -(1 << 63)
#: Blanks and tabs part words; the blanks around a run go with it.
_RUNS = rf"[ \t]*[^ \t]+(?:[ \t]+[^ \t]+){{0,{RUN - 1}}}(?:[ \t]+$)?"


def _key(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL_ID)), F.xxhash64(docs["text"])


def runs(text: Column) -> Column:
    """Array of (line, run) of a text."""
    # fewer than two characters a word cannot make more words than a run holds
    cut = lambda line: F.when(F.length(line) > 2 * RUN, F.regexp_extract_all(line, F.lit(_RUNS), F.lit(0)))
    whole = lambda line: F.coalesce(F.nullif(cut(line), F.array().cast("array<string>")), F.array(line))
    return F.flatten(F.transform(F.split(text, "\n"), lambda line, i: F.transform(whole(line), lambda r: F.struct(i.alias("line"), r.alias("run")))))


def hashes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """k_id, k_text, a, b: two hashes of each run of each text that has a window; stored, so that texts are cut once."""
    doc, text = _key(docs)
    cut = docs.select(doc.alias("k_id"), text.alias("k_text"), runs(docs["text"]).alias("l")).where(F.size("l") >= width)
    return stored(cut.select("k_id", "k_text", F.transform("l", lambda r: F.xxhash64(r["run"])).alias("a"), F.transform("l", lambda r: F.xxhash64(F.lit(1), r["run"])).alias("b")), "runs")


def windows(hashed: DataFrame, width: int = WIDTH) -> DataFrame:
    """k_id, k_text, at, h1, h2: each window of each text."""
    each = F.transform(
        F.sequence(F.lit(0), F.size("a") - width),
        lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get("a", i + k) for k in range(width)]).alias("h1"), F.xxhash64(*[F.get("b", i + k) for k in range(width)]).alias("h2")),
    )
    return hashed.select("k_id", "k_text", F.explode(each).alias("w")).select("k_id", "k_text", "w.at", "w.h1", "w.h2")


def _deduped(docs: DataFrame, width: int) -> DataFrame:
    """k_row (the columns of docs), text, n_lines, n_removed."""
    found = windows(hashes(docs, width), width)
    here = F.struct("k_id", "k_text", "at")
    first = found.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(first, ["h1", "h2"]).where(here > F.col("first"))
    cover = later.groupBy("k_id", "k_text").agg(F.collect_set("at").alias("k_at"))
    doc, text = _key(docs)
    keyed = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("k_row"), doc.alias("k_id"), text.alias("k_text"))
    joined = keyed.join(cover, ["k_id", "k_text"], "left").withColumn("k_runs", F.when(F.col("k_at").isNotNull(), runs(F.col("k_row.text"))))
    gone = F.flatten(F.transform("k_at", lambda p: F.sequence(p, p + (width - 1))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("k_runs") - 1), gone)
    # a run begins a line unless the run that stays before it is of the same line
    joined = joined.withColumn("k_stay", F.transform(stay, lambda i: F.get("k_runs", i)))
    joint = lambda r, i: F.when((i == 0) | (F.get("k_stay", i - 1)["line"] == r["line"]), r["run"]).otherwise(F.concat(F.lit("\n"), r["run"]))
    kept = F.when(F.col("k_at").isNull(), F.col("k_row.text")).otherwise(F.array_join(F.transform("k_stay", joint), ""))
    n = F.when(F.col("k_row.text").isNull(), 0).otherwise(F.size(F.split("k_row.text", "\n"))).cast("long")
    removed = F.when(F.col("k_at").isNull(), 0).otherwise(F.size("k_runs") - F.size("k_stay")).cast("long")
    return joined.select("k_row", kept.alias("text"), n.alias("n_lines"), removed.alias("n_removed"))


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs with line_dedup: struct of text (what stays), n_lines and n_removed (runs)."""
    return _deduped(docs, width).select("k_row.*", F.struct("text", "n_lines", "n_removed").alias(free_name(docs, "line_dedup")))


def replaced(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs with what stays as their text, and n_chars, where there is such a column, after it."""
    out = _deduped(docs, width)
    n_chars = lambda c: F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("k_row")[c])
    return out.select(*[(F.col("text") if c == "text" else n_chars(c) if c == "n_chars" else F.col("k_row")[c]).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
q AS (SELECT doc_id, i, a[i] AS t FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM l)),
u AS (SELECT doc_id, i, unnest(CASE WHEN len(regexp_extract_all(t, '[^ \t]+')) <= 17 THEN [t] ELSE regexp_extract_all(t, '[ \t]*[^ \t]+(?:[ \t]+[^ \t]+){0,16}(?:[ \t]+$)?') END) AS t, unnest(range(1, greatest(1, (len(regexp_extract_all(t, '[^ \t]+')) + 16) // 17) + 1)) AS k FROM q),
r AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS p FROM u),
w AS (SELECT * FROM (SELECT doc_id, p, t || chr(10) || lead(t) OVER d || chr(10) || lead(t, 2) OVER d AS k FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY p)) WHERE k IS NOT NULL),
f AS (SELECT k, min(doc_id * 1000000 + p) AS m FROM w GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM w JOIN f USING (k) WHERE doc_id * 1000000 + p > m),
e AS (SELECT r.doc_id, i, string_agg(t, '' ORDER BY r.p) AS line FROM r LEFT JOIN c ON c.doc_id = r.doc_id AND c.p = r.p WHERE c.p IS NULL GROUP BY r.doc_id, i),
s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM e GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN l.text IS NOT NULL THEN coalesce(s.text, '') END AS text, coalesce(len(a), 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed
FROM l LEFT JOIN s ON s.doc_id = l.doc_id LEFT JOIN g ON g.doc_id = l.doc_id
"""
