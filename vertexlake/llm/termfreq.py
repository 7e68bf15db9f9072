"""How often every distinct value occurs, in how many records, and whether it is too rare or too common to be useful.

Last-seen counters: the values are hash-partitioned and ordered by record within a partition, and each value keeps
its occurrences, its records and the last record it was seen in, so no set of records is held. A value's rows are
spread over `salts` partitions by a hash of the record (all of a record's rows of one value meet), which makes the
counts of the parts disjoint: their sums are the result, and no task gathers a hot value.

Cases: a record with a null id counts as one record of its own for each row; a null or empty cell has no values; an
empty table gives an empty result; a record delivered again counts once, with the occurrences of its latest delivery
if `version` is given (of all deliveries otherwise).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.session import cut

#: Fixed values, in upper case: what stands for a missing value.
MISSING = ("", "NA", "N/A")


def values_of(cell: Column) -> Column:
    """The values of a cell: cut at comma, semicolon and bar, stripped of blanks and tabs, upper case, none missing."""
    parts = F.transform(F.split(cell, "[,;|]"), lambda x: F.upper(F.trim(x, F.lit(" \t"))))
    return F.filter(parts, lambda x: ~x.isin(*MISSING))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters over rows that come ordered by record: one entry for each (field, value) of the partition.

    Records are numbered as they come: a row that differs from the one before it in its id begins the next record.
    """
    number: dict[tuple[str, str], int] = {}
    seen, records, last = (np.zeros(0, np.int64) for _ in range(3))
    now, before_ = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        codes, keys = pd.MultiIndex.from_arrays([b.column("field").to_pandas(), b.column("value").to_pandas()]).factorize()
        own = np.fromiter((number.setdefault(k, len(number)) for k in keys), np.int64, len(keys))[codes]
        ids, nulls = b.column("id"), b.column("own_")
        other = pc.or_(pc.not_equal(ids[1:], ids[:-1]), pc.not_equal(nulls[1:], nulls[:-1])).to_numpy(zero_copy_only=False)
        first = (ids[0].as_py(), nulls[0].as_py())
        rec = now + np.cumsum(np.append(first != before_, other))
        now, before_ = int(rec[-1]), (ids[-1].as_py(), nulls[-1].as_py())
        if len(number) > len(seen):
            more = max(len(number), 2 * len(seen)) - len(seen)
            seen, records = (np.append(x, np.zeros(more, np.int64)) for x in (seen, records))
            last = np.append(last, np.full(more, -1, np.int64))
        order = np.argsort(own, kind="stable")  # keeps the order by record within a value
        v, r = own[order], rec[order]
        head = np.append(True, v[1:] != v[:-1])
        before = np.append(np.int64(-1), r[:-1])
        before[head] = last[v[head]]
        np.add.at(seen, v, 1)
        np.add.at(records, v[r != before], 1)
        tail = np.append(head[1:], True)
        last[v[tail]] = r[tail]
    if number:
        f, x = zip(*number)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(x, pa.string()), pa.array(seen[: len(f)]), pa.array(records[: len(f)])], ["field", "value", "n", "records"])


def frequencies(df: DataFrame, record: str, fields: list[str], version: str | None = None, min_records: int = 3, max_share: float = 0.05, salts: int = 16) -> DataFrame:
    """(field, value_norm, n_occurrences, n_records, mark): mark is 'rare', 'common' or null.

    Ids are compared as they are (numbers as numbers, all else as text); own_ is 0 for a row with an id and a number of its own
    for one without.
    """
    id_ = F.col(record) if dict(df.dtypes)[record] in ("bigint", "int") else F.col(record).cast("string")
    rows = df.select(id_.alias("id"), *([F.col(version).alias("version_")] if version else []), *[F.col(f).alias(f"f{k}_") for k, f in enumerate(fields)])
    rows = rows.withColumn("own_", F.when(F.col("id").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)))
    if version:
        w = Window.partitionBy("id", "own_").orderBy(F.col("version_").desc_nulls_last(), *[F.col(f"f{k}_") for k in range(len(fields))])
        rows = rows.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), values_of(F.col(f"f{k}_")).alias("values")) for k, f in enumerate(fields)])
    none = "" if dict(rows.dtypes)["id"] == "string" else 0
    rows = cut(rows.select(F.coalesce("id", F.lit(none)).alias("id"), "own_", cells.alias("cells")))
    # With a version each record has one row; without, repeated ids are one record.
    total = (rows if version else rows.select("id", "own_").distinct()).count()
    tokens = rows.select("id", "own_", F.explode("cells").alias("c")).select("id", "own_", "c.field", F.explode("c.values").alias("value"))
    salt = F.pmod(F.xxhash64("id", "own_"), F.lit(salts))
    parts = tokens.repartition("field", "value", salt).sortWithinPartitions("id", "own_").mapInArrow(_count, "field string, value string, n bigint, records bigint")
    out = parts.groupBy("field", "value").agg(F.sum("n").alias("n_occurrences"), F.sum("records").alias("n_records"))
    mark = F.when(F.col("n_records") < min_records, "rare").when(F.col("n_records") > max_share * F.lit(float(total)), "common")
    return out.select("field", F.col("value").alias("value_norm"), "n_occurrences", "n_records", mark.alias("mark"))
