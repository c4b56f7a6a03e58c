"""Logs and documents: topic-filtered messages, aligned binary records, landmark and map documents, tables with fixed precision."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOLES = "origin array<double>, up array<double>, mode string, resolution double, source_path string, holes array<struct<id:long,centroid:array<double>,radius:double,area:double,n_cells:long,semi_major:double,semi_minor:double,orientation:double>>"
MAP = "elements array<struct<type:string,id:long,lat:double,lon:double,nodes:array<long>>>"


def messages(log: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Messages of some topics; the filter reaches the scan."""
    return log.where(F.col("topic").isin(*topics))


def keyword_messages(log: DataFrame, text: str, words: Sequence[str], most: int, key: str) -> DataFrame:
    """Rows whose text holds a word, in any case, the first `most` for each word."""
    from pyspark.sql import Window

    found = log.withColumn("word", F.explode(F.array(*map(F.lit, words)))).where(F.lower(F.col(text)).contains(F.col("word")))
    return found.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy(key))).where(F.col("k") <= most).drop("k")


def holes(spark: SparkSession, path: str) -> DataFrame:
    """A row for each hole of a landmark document; missing ellipses are circles."""
    read = spark.read.json(path, schema=HOLES, multiLine=True)
    h = read.select("mode", "resolution", F.explode("holes").alias("h")).select("mode", "resolution", "h.*")
    return h.withColumns({"semi_major": F.coalesce("semi_major", "radius"), "semi_minor": F.coalesce("semi_minor", "radius"), "orientation": F.coalesce("orientation", F.lit(0.0)), "x": F.get("centroid", 0), "y": F.get("centroid", 1), "z": F.get("centroid", 2)}).drop("centroid")


def ways(documents: DataFrame) -> DataFrame:
    """way, pos, lat, lon: the ordered points of each way of map documents (column json)."""
    e = documents.select(F.explode(F.from_json("json", MAP)["elements"]).alias("e")).select("e.*")
    nodes = e.where("type = 'node'").select(F.col("id").alias("node"), "lat", "lon")
    steps = e.where("type = 'way'").select(F.col("id").alias("way"), F.posexplode("nodes").alias("pos", "node"))
    return steps.join(nodes, "node").select("way", "pos", "lat", "lon")


def decode(log: DataFrame, data: str, layout: str, names: Sequence[str]) -> DataFrame:
    """Columns of aligned little-endian records after a 4-byte head; layout: i, I, B, d or s (counted text) for each name."""
    kinds = {"i": "int", "I": "long", "B": "int", "d": "double", "s": "string"}
    size = {"i": 4, "I": 4, "d": 8, "B": 1, "s": 4}

    def record(raw: bytes) -> dict:
        out, at = {}, 4
        try:
            for name, k in zip(names, layout, strict=True):
                at += -(at - 4) % size[k]
                if k == "s":
                    (n,) = struct.unpack_from("<I", raw, at)
                    out[name] = raw[at + 4 : at + 4 + n].rstrip(b"\0").decode("utf-8", "replace")
                    at += 4 + n
                else:
                    (out[name],) = struct.unpack_from(f"<{k}", raw, at)
                    at += size[k]
        except struct.error:
            return dict.fromkeys(names)
        return out

    schema = ", ".join([*(f"{c} {t}" for c, t in log.dtypes if c != data), *(f"{n} {kinds[k]}" for n, k in zip(names, layout, strict=True))])
    kept = [c for c in log.columns if c != data]
    arrow = pa.schema([(n, {"i": pa.int32(), "I": pa.int64(), "B": pa.int32(), "d": pa.float64(), "s": pa.string()}[k]) for n, k in zip(names, layout, strict=True)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.Table.from_pylist([record(x) if x is not None else dict.fromkeys(names) for x in b.column(data).to_pylist()], schema=arrow)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(rows.column(n).combine_chunks() for n in names)], [*kept, *names])

    return log.mapInArrow(work, schema)


def fixed(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """Columns rounded half to even as a table with fixed decimals shows them; what reads the table reads these."""
    return df.withColumns({c: F.bround(c, n) for c, n in places.items()})


def number(c: str | Column) -> Column:
    """A text cell as a number: blank, nan and anything else that is no number become null."""
    v = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(v), v)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as text; more than `most` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = [df.columns, ["---"] * len(df.columns), *([("" if v is None else str(v)) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def latex(df: DataFrame, most: int = 1000) -> str:
    """A small table as a tabular; more than `most` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    # fixed values: what LaTeX reads as a command, and how it is written plainly
    plain = str.maketrans({"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"})
    lines = [" & ".join(("" if v is None else str(v)).translate(plain) for v in r) + r" \\" for r in (df.columns, *rows)]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}"])
