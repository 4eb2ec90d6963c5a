"""Duplicates hidden by formatting differences (problem 3).

Records are made canonical (sorted words of name and title), range-partitioned by the full key *and* the id, sorted
outside memory by Spark's sorter, and scanned once: adjacent rows with equal full keys form a run. A run that a partition
boundary cuts is joined again through the first and last run of every partition, two short rows per partition, so a group
that holds a third of all rows is spread over many tasks like any other rows.

Edge cases: a null or blank name or title equals no words; repeated ids give one row each beyond the first; an empty table
gives an empty result; very long texts are compared whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.residue import keep_real_names
from millrace.session import checkpoint, input_partitions

_RUNS = "first_id long, copy_id long, run_head boolean, part int, edge string, gkey string"


def sorted_words(c: Column) -> Column:
    """The words (maximal runs of letters and digits, lower case) in order, joined by blanks; null counts as none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.array_sort(words), " ")


def canonical(people: DataFrame) -> DataFrame:
    """(id, company_id, gkey): the full canonical key of every row whose name is real."""
    rows = keep_real_names(people.select("id", "company_id", "name", "title"))
    return rows.select("id", "company_id", F.concat_ws("\u0002", F.coalesce(F.col("company_id").cast("string"), F.lit("-")), sorted_words(F.col("name")), sorted_words(F.col("title"))).alias("gkey"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one sorted partition: rows of runs of two or more, and the heads of the first and the last run."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    key, first, head_out, is_first_run = None, None, False, True

    def rows(firsts, copies, heads, edges, keys):
        n = len(firsts)
        return pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(copies, pa.int64()), pa.array(heads, pa.bool_()), pa.array([part] * n, pa.int32()), pa.array(edges, pa.string()), pa.array(keys, pa.string())], names=["first_id", "copy_id", "run_head", "part", "edge", "gkey"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_pylist()
        keys = batch.column(1)
        same = [False] + pc.equal(keys.slice(1), keys.slice(0, batch.num_rows - 1)).to_pylist() if batch.num_rows > 1 else [False]
        same[0] = key is not None and keys[0].as_py() == key
        out = ([], [], [], [], [])
        for i, equal in enumerate(same):
            if equal:
                # Rows of a partition's first run may belong to a run begun before: they carry the key for the stitching.
                out[0].append(first), out[1].append(ids[i]), out[2].append(False), out[3].append("first" if is_first_run else None), out[4].append(None)
            else:
                if key is not None:
                    is_first_run = False
                first = ids[i]
                if key is None:
                    key_here = keys[i].as_py()
                    out[0].append(first), out[1].append(first), out[2].append(True), out[3].append("first"), out[4].append(key_here)
                key = True
        key = keys[batch.num_rows - 1].as_py()
        if out[0]:
            yield rows(*out)
    if key is not None:
        yield rows([first], [first], [True], ["last"], [key])


def find_copies(people: DataFrame) -> DataFrame:
    """(first_id, copy_id): one row per copy other than the one with the smallest id of its group."""
    keyed = canonical(people).select("id", "gkey")
    n = input_partitions(keyed)
    ordered = keyed.repartitionByRange(n, "gkey", "id").sortWithinPartitions("gkey", "id")
    runs = checkpoint(ordered.mapInArrow(_scan, _RUNS))
    # At most two edge rows per partition: a bound by construction, so they may be sorted in one task and broadcast.
    edges = runs.where("run_head")
    order = Window.orderBy("part", "edge")  # 'first' sorts before 'last'
    starts = edges.select("part", "edge", "first_id", "gkey", F.when(F.lag("gkey").over(order) != F.col("gkey"), True).otherwise(F.lag("gkey").over(order).isNull()).alias("begins"))
    stitched = starts.withColumn("run", F.sum(F.col("begins").cast("int")).over(order)).withColumn("global_first", F.first("first_id").over(Window.partitionBy("run").orderBy("part", "edge")))
    mapping = stitched.where("edge = 'first'").select("part", "global_first")
    inner = runs.where("not run_head or edge = 'first'").join(F.broadcast(mapping), "part", "left")
    first = F.when(F.col("edge") == "first", F.col("global_first")).otherwise(F.col("first_id"))
    return inner.select(first.alias("first_id"), F.col("copy_id")).where("copy_id <> first_id")


def collapse(people: DataFrame) -> DataFrame:
    """(first_id, n_copies): one representative per group of copies and the exact number of its rows (1 for singles)."""
    pairs = find_copies(people)
    counts = pairs.groupBy("first_id").agg(F.count(F.lit(1)).alias("extra"))
    rows = keep_real_names(people.select("id", "name"))
    copies = pairs.select(F.col("copy_id").alias("id"))
    return rows.join(copies, "id", "left_anti").join(counts, F.col("id") == F.col("first_id"), "left").select(F.col("id").alias("first_id"), (F.coalesce("extra", F.lit(0)) + 1).alias("n_copies"))
