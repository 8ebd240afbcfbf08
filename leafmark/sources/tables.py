"""Sources: the Parquet tables, and canonical row sets made from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions.text import NARROW, WIDE, width
from leafmark.operators.glyphs import CHARS, observations

#: Where a page begins, how far its lines are apart, and the size of its characters.
LEFT, TOP, LEADING, SIZE = 40, 60, 16.8, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 0, line, line_width) of every line of the texts; null texts have none."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.withColumn("line_width", width(F.col("line")))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew where its files have fewer splits than there are cores: a small input, whose shuffle is small too."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def line_spans(docs: DataFrame, blanks: bool = True) -> DataFrame:
    """Each line of the texts that isn't empty as a span: doc_id, line_no, size, chars (glyphs.CHARS), font and paint.

    A character stands where the advances before it end.  Without blanks,
    spaces move what follows but are no characters.  Positions are running
    sums over whole texts, so they are made in Arrow batches.
    """
    import pyarrow as pa

    names = ("code", "glyph_id", "x0", "y0", "x1", "y1", "origin_x", "origin_y")

    def lay(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, texts = part.column("doc_id"), part.column("text").to_pylist()
                code = np.frombuffer("".join((t or "") + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.int32)
                ends = np.flatnonzero(code == 10)
                start = np.concatenate([[0], ends[:-1] + 1])
                text_end = np.cumsum([len(t or "") + 1 for t in texts])
                text_of = np.searchsorted(text_end, start, side="right")
                first = np.searchsorted(start, np.concatenate([[0], text_end[:-1]]))
                line = np.repeat(np.arange(len(ends)), ends - start + 1)
                advance = np.where(code < 128, NARROW, WIDE).astype(float)
                to = np.cumsum(advance)
                before = (to - advance)[start]
                shown = (code != 10) & ((code != 32) | blanks)
                at, line = np.flatnonzero(shown), line[shown]
                number = np.arange(len(ends)) - first[text_of]
                base = TOP + number * LEADING
                x1 = to[at] - before[line] + LEFT
                columns = [code[at], code[at], x1 - advance[at], (base - SIZE)[line], x1, (base + 2)[line], x1 - advance[at], base[line]]
                counts = np.bincount(line, minlength=len(ends))
                kept = np.flatnonzero(counts)
                offsets = np.concatenate([[0], np.cumsum(counts[kept])])
                chars = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int32() if k < 2 else pa.float64()) for k, c in enumerate(columns)], names))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text_of[kept])), pa.array(number[kept], pa.int32()), chars], ["doc_id", "line_no", "chars"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spread(docs.select("doc_id", "text")).mapInArrow(lay, f"doc_id {kind}, line_no int, chars {CHARS}")
    style = {"font": F.lit("plain"), "size": F.lit(float(SIZE)), "direction": F.array(F.lit(1.0), F.lit(0.0)), "paint_type": F.lit(0), "color": F.array(F.lit(0.0)), "opacity": F.lit(1.0), "wmode": F.lit(0), "layer": F.lit("")}
    return rows.withColumns(style)


def glyphs(docs: DataFrame) -> DataFrame:
    """One row a character of line_spans(): doc_id, line_no, ord, ch, code, advance, x0, x1, baseline and the thirteen observed attributes."""
    rows = observations(line_spans(docs), ["doc_id", "line_no"])
    return rows.withColumns({"ch": F.col("unicode"), "advance": F.col("advance_bbox"), "x0": F.col("bbox")[0], "x1": F.col("bbox")[2], "baseline": F.col("origin")[1]})


def tags(pages: DataFrame) -> DataFrame:
    """One row a tag of the html: page_id, ord from 0, name (lower case), kind (open, close, void)."""
    tokens = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<(/?[A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("ord", "tag"))
    name = F.lower(F.regexp_replace("tag", "/", ""))
    void = name.isin("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
    kind = F.when(F.col("tag").startswith("/"), F.lit("close")).when(void, F.lit("void")).otherwise(F.lit("open"))
    return tokens.select("page_id", "ord", name.alias("name"), kind.alias("kind"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records with a closed schema: rows that don't fit are an error."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def faces(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".ttf", ".otf", ".ttc")) -> DataFrame:
    """Files below a folder, in the order of their paths, with a digest of their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    wanted = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    return files.where(wanted).select("path", "length", F.sha2("content", 256).alias("digest")).orderBy("path")
