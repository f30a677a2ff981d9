"""Text reports of lookups: BED, wiggle tracks and existence tables, as text files in the order of the records.

Records are ordered by seq_idx, where the rows have it, else by name; a record without a name is written with an empty one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ids(df: DataFrame) -> list[str]:
    return [c for c in ("seq_idx", "ident") if c in df.columns]


def _name():
    return F.coalesce(F.col("ident").cast("string"), F.lit(""))


def write_bed(found: DataFrame, path: str, files: int = 64) -> None:
    """ident<tab>begin<tab>end[<tab>label] from ([seq_idx,] ident, begin, end[, label])."""
    label, key = ["label"] if "label" in found.columns else [], _ids(found)[0]
    line = F.concat_ws("\t", _name(), *[F.col(c).cast("string") for c in ("begin", "end", *label)])
    found.repartitionByRange(files, key, "begin").sortWithinPartitions(key, "begin", *label).select(line.alias("line")).write.text(path)


def _wig(batches):
    last = None
    for batch in batches:
        out = []
        for key, ident, pos, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key,) != last:
                out.append(f"variableStep chrom={ident}")
                last = (key,)
            if pos is not None:
                out.append(f"{pos}\t{value}")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["line"])


def wig_rows(track: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """(key, ident, pos, value) of a track; with the sequences, each of them has a row without a position, too."""
    key = _ids(track)[0]
    rows = track.select(F.col(key).alias("key"), _name().alias("ident"), "pos", "value")
    if sequences is None:
        return rows
    none = F.lit(None).cast("long")
    return rows.unionByName(sequences.select(F.col(key).alias("key"), _name().alias("ident"), none.alias("pos"), none.alias("value")))


def write_wig(track: DataFrame, path: str, files: int = 64, sequences: DataFrame | None = None) -> None:
    """A step line for each sequence, then pos<tab>value, from ([seq_idx,] ident, pos from 1, value).

    With the sequences given, those without a hit have a step line, too.  A sequence whose positions
    go on in another file has a step line there, too.
    """
    wig_rows(track, sequences).repartitionByRange(files, "key", "pos").sortWithinPartitions("key", "pos").mapInArrow(_wig, "line string").write.text(path)


def existence_lines(found: DataFrame) -> DataFrame:
    """([seq_idx,] ident, line): ident<tab>n_kmers, and <tab>db_kmers<tab>found for each dataset, from lookup.existence()."""
    ids = _ids(found)
    each = F.array_sort(F.collect_list(F.struct("db", "db_kmers", "found")))  # a row for each dataset given
    per = found.groupBy(*ids, "n_kmers").agg(each.alias("x"))
    counts = F.array_join(F.transform("x", lambda x: F.concat_ws("\t", x["db_kmers"], x["found"])), "\t")
    return per.select(*ids, F.concat_ws("\t", _name(), F.col("n_kmers").cast("string"), counts).alias("line"))


def write_existence(found: DataFrame, path: str, files: int = 64) -> None:
    key = _ids(found)[0]
    existence_lines(found).repartitionByRange(files, key).sortWithinPartitions(key).select("line").write.text(path)
