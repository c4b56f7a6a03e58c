"""Secret scan with corpus-wide ownership frequency, in DataFrame functions alone.

Three kinds of spans are found by patterns in every whole text.  A fourth kind,
generic (a token of 20 or more characters that mixes digits, upper and lower
case, outside the other spans), is added by the method: candidates' values are
hashed, and counted over the corpus by distinct owners and distinct repositories.  A
value that EXAMPLE_OWNERS owners or EXAMPLE_REPOSITORIES repositories have is a copied
example; a generic value of one owner in fewer repositories looks live and its span
is added.  Spans of the patterns always stay.

Values leave their row as hashes only.  Counting goes by (value, owner) and (value,
repository), then value, each pre-aggregated.

Places are code points, end exclusive: the pieces between matches (split) and the
matches themselves give them by running sums, in runs of RUN matches and over these,
so that a text full of matches takes no time that grows as its square.

Defined results: a null text counts as empty; a null owner or repository counts as
one of its own; repeated rows are each reported; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.llm.common import stored

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are matched whole from their first place on, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
GENERIC = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "generic")
#: A value with so many owners, or in so many repositories, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 2, 8
RUN = 128


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once: what a lambda function refers to outside itself is worked out in every call."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, stop, value) for each match; value: the group, of `least` characters or more."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.transform(whole, lambda x: F.length(x)).alias("n"), F.transform(gaps, lambda x: F.length(x)).alias("gap"), value.alias("value"))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,value:string>>")
    run = lambda some: F.aggregate(
        some,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["n"], F.lit(0))).alias("at"),
            F.when(F.length(x["value"]) >= max(least, 1), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["gap"] + x["n"]).alias("stop"), x["value"].alias("value"))))).otherwise(acc["out"]).alias("out"),
        ),
    )
    runs = _once(rows, lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / RUN).cast("int")), lambda i: run(F.slice(r, i * RUN + 1, RUN))))
    begins = lambda p: F.aggregate(p, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
    moved = lambda x, by: F.struct((x["start"] + by).alias("start"), x["kind"].alias("kind"), (x["stop"] + by).alias("stop"), x["value"].alias("value"))
    placed = _once(runs, lambda p: F.flatten(F.zip_with(p, F.slice(begins(p), 1, F.size(p)), lambda some, by: F.transform(some["out"], lambda x: moved(x, by)))))
    return F.when(text.rlike(pattern), placed).otherwise(none)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_generic, n_live, n_example for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), text.alias("text"))
    base = F.array_sort(F.concat(_spans(F.col("text"), ASSIGN, 0, 2, 6), _spans(F.col("text"), ACCESS, 1), _spans(F.col("text"), HEX, 2)))
    found = slim.select("doc_id", "owner", "repository", base.alias("base"), _spans(F.col("text"), GENERIC, 3).alias("more"))
    hashed = F.transform(F.concat("base", "more"), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), F.xxhash64(x["value"]).alias("h1"), F.xxhash64(F.lit(1), x["value"]).alias("h2")))
    rows = stored(found.select("doc_id", "owner", "repository", hashed.alias("all")).withColumn("row", F.monotonically_increasing_id()), "candidates")

    each = rows.select("row", "owner", "repository", F.explode("all").alias("c")).select("row", "owner", "repository", "c.*")
    # a generic span that overlaps one of the others is none
    own, back = (Window.partitionBy("row").orderBy(*order) for order in (("start", "kind", "stop"), (F.desc("start"), F.desc("kind"), F.desc("stop"))))
    base_of = lambda c: F.when(F.col("kind") < 3, F.col(c))
    each = each.withColumns({"left": F.max(base_of("stop")).over(own.rowsBetween(Window.unboundedPreceding, -1)), "right": F.min(base_of("start")).over(back.rowsBetween(Window.unboundedPreceding, -1))})
    each = stored(each.where((F.col("kind") < 3) | (F.coalesce("left", F.lit(0)) <= F.col("start")) & (F.coalesce("right", F.col("stop")) >= F.col("stop"))).drop("left", "right"), "spans")
    owners = each.groupBy("h1", "h2", "owner").agg(F.lit(1)).groupBy("h1", "h2").agg(F.count("*").alias("owners"))
    repositories = each.groupBy("h1", "h2", "repository").agg(F.lit(1)).groupBy("h1", "h2").agg(F.count("*").alias("repositories"))
    # only what is an example needs to be met again
    spread = owners.join(repositories, ["h1", "h2"]).where((F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)).select("h1", "h2", F.lit(True).alias("example"))
    judged = each.join(spread, ["h1", "h2"], "left").select("row", F.struct("start", "kind", "stop", F.coalesce("example", F.lit(False)).alias("example")).alias("c"))
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list("c")).alias("judged"))
    kept = F.filter("judged", lambda x: (x["kind"] < 3) | ~x["example"])
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,example:boolean>>")
    told = rows.join(per_row, "row", "left").select("doc_id", F.coalesce(kept, none).alias("kept"), F.coalesce("judged", none).alias("judged"))
    count = lambda test: F.size(F.filter("kept", test)).cast("long")
    of_kind = lambda k: count(lambda x: x["kind"] == k)
    return told.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.sha2(_written(F.filter("kept", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        _written(F.col("kept")).alias("spans"),
        of_kind(3).alias("n_generic"),
        count(lambda x: ~x["example"]).alias("n_live"),
        F.size(F.filter("judged", lambda x: x["example"])).cast("long").alias("n_example"),
    )
