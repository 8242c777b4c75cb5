"""What the two vector operators share: valid vectors, classes of equal ones, blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless, keep, release

VALID = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(embedding, x -> x <> 0)"


def classes(rows: DataFrame, lean: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """(members: vec_id, rep), (classes: rep, low, copies, v), and the dimension, of valid vectors.

    Equal vectors form one class; low is its smallest vec_id, and rep its name: low too, or, where
    some id has several vectors, so that two classes could get one name, a number in the order of low.
    Members has a row for each valid row. Vectors of another length than most, null, zero or with
    null or non-finite components, and null ids, are left out. ``lean`` keeps floats as floats, and
    the vectors in the classes alone.
    """
    kind = rows.schema["embedding"].dataType.simpleString() if lean else ""
    kind = kind if kind == "array<float>" else "array<double>"
    ok = rows.where("vec_id IS NOT NULL").where(F.coalesce(F.expr(VALID), F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    ok = vectors = keep(ok, "vectors")
    common = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 0
    ok = ok.where(F.size("v") == dim)
    own = keep(ok.groupBy("v").agg(F.min("vec_id").alias("rep"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies")), "classes")
    if own.groupBy("low").count().where("count > 1").limit(1).count():
        several = keep(gapless(own.drop("rep"), [], ["low"], "rep").select("rep", "low", "copies", "v"), "numbered")
        release(*[own] * lean)
        own = several
    else:
        several = own.where("copies > 1")
    if several.limit(1).count():
        named = several.select("rep", F.col("v").alias("_v"))
        members = keep(ok.join(named, F.col("v") == F.col("_v"), "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep")), "members")
    else:
        members = ok.select("vec_id", F.col("vec_id").alias("rep"))
        members = keep(members, "members") if lean else members
    release(*[vectors] * lean)
    return members, own, dim


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column of one length as a matrix; floats as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, max(dim, 1))
    return out.astype(np.float64) if out.dtype == np.float32 else out
