"""References to records that do not exist, by compressed bitmaps per key range and period.

Keys are integers (ids as they are, text ids by the number they denote: an order-preserving
dictionary that needs no table). A key is split into its range (the bits above 16) and its place
in the range, a period is a calendar month. Every task packs what it reads into one container per
(space, range, table, month): sorted 16-bit places while they are few, a bitmap of 65,536 bits beyond. Parents
are packed by range and turned into bitmaps for every month that is referred to.
Containers of a range and month meet in one partition, where they are read in order one after another:
reference AND NOT parent leaves the orphans, whose bits are decoded. Months in which a key's
own state changes can't be decided by month; only references of such keys in such months are compared by
timestamp: they are picked out before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import checked_broadcast, cut_lineage, shuffle_width

RANGE_BITS = 16
RANGE = 1 << RANGE_BITS
#: Places above which a bitmap is smaller than a sorted list.
DENSE = 4096
#: Rows packed at a time by a task.
PACK_ROWS = 2_000_000
#: Stands for "not removed" in a parent's last month.
OPEN = np.int16(32767)
PACKED = "space int, hi long, kind int, month int, body binary"


def number_key(text: str | Column) -> Column:
    """The whole number that a text id denotes, as LONG; null where it denotes none. 007, ' 7' and 7.0 are one key."""
    text = F.col(text) if isinstance(text, str) else text
    number = F.regexp_replace(text, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "").try_cast("decimal(38,10)")
    return F.when(number == F.floor(number), number).try_cast("long")


def month_of(at: str | Column) -> Column:
    """Months since January of year 0."""
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def month_name(month: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"))


def encode_places(places: np.ndarray) -> bytes:
    """A container: one byte for the kind, then sorted places or a bitmap. places: sorted, distinct."""
    if len(places) <= DENSE:
        return b"\0" + places.astype("<u2").tobytes()
    bits = np.zeros(RANGE, dtype=bool)
    bits[places] = True
    return b"\1" + np.packbits(bits).tobytes()


def decode_bits(body: bytes) -> np.ndarray:
    """The packed bitmap of a container."""
    if body[0] == 1:
        return np.frombuffer(body, dtype=np.uint8, offset=1)
    bits = np.zeros(RANGE, dtype=bool)
    bits[np.frombuffer(body, dtype="<u2", offset=1)] = True
    return np.packbits(bits)


def _pack_references(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(space, table_no, month, key) rows to containers, PACK_ROWS at a time."""

    def flush(frames: list[pd.DataFrame]) -> pd.DataFrame:
        all_rows = pd.concat(frames, ignore_index=True).astype("int64").drop_duplicates()
        key = all_rows["key"].to_numpy()
        all_rows["hi"], all_rows["lo"] = key >> RANGE_BITS, key & (RANGE - 1)
        all_rows = all_rows.sort_values(["space", "hi", "table_no", "month", "lo"], kind="stable")
        heads = all_rows[["space", "hi", "table_no", "month"]].to_numpy()
        places = all_rows["lo"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (heads[1:] != heads[:-1]).any(axis=1)]) if len(heads) else np.array([], dtype=int)
        ends = np.r_[starts[1:], len(heads)]
        top = heads[starts]
        return pd.DataFrame({"space": top[:, 0].astype("int32"), "hi": top[:, 1], "kind": (top[:, 2] + 1).astype("int32"), "month": top[:, 3].astype("int32"), "body": [encode_places(places[a:b]) for a, b in zip(starts, ends)]})

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= PACK_ROWS:
            yield flush(held)
            held, n = [], 0
    if n:
        yield flush(held)


def _pack_parents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(space, key, first, last) rows, months of being added and removed, to one array per range."""
    for batch in batches:
        batch = batch.astype("int64").drop_duplicates()
        key = batch["key"].to_numpy()
        hi = key >> RANGE_BITS
        rows = np.empty(len(batch), dtype=[("lo", "<u2"), ("first", "<i4"), ("last", "<i4")])
        rows["lo"], rows["first"], rows["last"] = key & (RANGE - 1), batch["first"], batch["last"]
        out = [(int(space), int(h), rows[at].tobytes()) for (space, h), at in pd.DataFrame({"s": batch["space"].to_numpy(), "h": hi}).groupby(["s", "h"]).indices.items()]
        yield pd.DataFrame({"space": pd.Series([x[0] for x in out], dtype="int32"), "hi": pd.Series([x[1] for x in out], dtype="int64"), "kind": pd.Series(0, index=range(len(out)), dtype="int32"), "month": pd.Series(0, index=range(len(out)), dtype="int32"), "body": [x[2] for x in out]})


ROW = [("lo", "<u2"), ("first", "<i4"), ("last", "<i4")]
BYTES = RANGE // 8


def _packed_bits(places: np.ndarray) -> bytes:
    bits = np.zeros(RANGE, dtype=bool)
    bits[places] = True
    return np.packbits(bits).tobytes()


def _parent_bitmaps(months: list[int]):
    """Packed parents in order of (space, hi) to one row per range and month: known, live throughout, changing within, removed before."""

    def of_range(space: int, hi: int, bodies: list[bytes]) -> pd.DataFrame:
        rows = np.unique(np.frombuffer(b"".join(bodies), dtype=ROW))
        lo, first, last = rows["lo"], rows["first"], rows["last"]
        known = _packed_bits(lo)
        body = [known + _packed_bits(lo[(first < m) & (last > m)]) + _packed_bits(lo[(first == m) | (last == m)]) + _packed_bits(lo[last < m]) for m in months]
        return pd.DataFrame({"space": np.int32(space), "hi": np.int64(hi), "kind": np.int32(0), "month": np.array(months, dtype=np.int32), "body": body})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, bodies = None, []
        for batch in batches:
            for space, hi, body in zip(batch["space"], batch["hi"], batch["body"]):
                if at is not None and at != (space, hi):
                    yield of_range(*at, bodies)
                    bodies = []
                at = space, hi
                bodies.append(body)
        if at is not None:
            yield of_range(*at, bodies)

    return work


def _subtract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Containers in order of (space, hi, month, kind), the parents' first: AND NOT against them."""
    none = (np.zeros(BYTES, dtype=np.uint8),) * 4
    at, parents, now, bits = None, none, None, None

    def survivors() -> Iterator[pd.DataFrame]:
        known, live, changing, removed = parents
        left = bits & ~live
        for verdict, part in (("missing", left & ~known), ("changing", left & changing), ("deleted", left & ~changing & removed), ("late", left & known & ~changing & ~removed)):
            places = np.flatnonzero(np.unpackbits(part))
            if len(places):
                yield pd.DataFrame({"space": np.int32(now[0]), "table_no": np.int32(now[3] - 1), "month": np.int32(now[2]), "key": (np.int64(now[1]) << RANGE_BITS) + places, "verdict": verdict})

    for batch in batches:
        for space, hi, kind, month, body in zip(batch["space"], batch["hi"], batch["kind"], batch["month"], batch["body"]):
            if now is not None and now != (space, hi, month, kind):
                yield from survivors()
                now = None
            if at != (space, hi, month):
                at, parents = (space, hi, month), none
            if kind == 0:
                parents = tuple(np.frombuffer(body, dtype=np.uint8).reshape(4, BYTES))
                continue
            bits = decode_bits(body) if now is None else bits | decode_bits(body)
            now = (space, hi, month, kind)
    if now is not None:
        yield from survivors()


def orphan_references(references: list[tuple[str, int, DataFrame]], parents: list[DataFrame]) -> DataFrame:
    """Distinct orphan cases (table_name, month, key, reason) of references against parents live at that time.

    references: (table_name, space, df) with df's columns key LONG and at TIMESTAMP, where space is the place in
    `parents` of the parents it refers to. parents: dfs with key LONG, added_at and removed_at TIMESTAMP (null: still
    there). A key is live while added_at <= t < removed_at in some row. reason is `missing` (the key is in no parent row),
    else `deleted` (some row has removed_at <= t), else `late`; a key may have several reasons within a month.
    References with a null key or a null time are no cases; parent rows with a null key are ignored, and one with a null
    added_at makes its key known but never live. Duplicate rows change nothing; empty tables give no cases. Columns
    besides those named are dropped.
    """
    names = [name for name, _, _ in references]
    refs = None
    for no, (_, space, df) in enumerate(references):
        part = df.select(F.lit(space).alias("space"), F.lit(no).alias("table_no"), F.col("key").cast("long").alias("key"), F.col("at").cast("timestamp").alias("at")).where(F.col("key").isNotNull() & F.col("at").isNotNull())
        refs = part if refs is None else refs.unionAll(part)
    olds = None
    for space, df in enumerate(parents):
        part = df.select(F.lit(space).alias("space"), F.col("key").cast("long").alias("key"), F.col("added_at").cast("timestamp").alias("added_at"), F.col("removed_at").cast("timestamp").alias("removed_at")).where(F.col("key").isNotNull())
        olds = part if olds is None else olds.unionAll(part)

    months = olds.select("space", "key", F.coalesce(month_of("added_at"), F.lit(int(1e6))).alias("first"), F.coalesce(month_of("removed_at"), F.lit(int(1e7))).alias("last"))
    width = shuffle_width(refs.sparkSession)
    containers = cut_lineage(refs.select("space", "table_no", month_of("at").alias("month"), "key").mapInPandas(_pack_references, PACKED))
    asked = sorted(r["month"] for r in containers.select("month").distinct().collect())  # as many as there are months
    bitmaps = months.mapInPandas(_pack_parents, PACKED).repartition(width, "space", "hi").sortWithinPartitions("space", "hi").mapInPandas(_parent_bitmaps(asked), PACKED)
    containers = containers.unionAll(bitmaps).repartition(width, "space", "hi", "month").sortWithinPartitions("space", "hi", "month", "kind")
    decided = cut_lineage(containers.mapInPandas(_subtract, "space int, table_no int, month int, key long, verdict string"))

    changing = decided.where(F.col("verdict") == "changing").select("space", "table_no", "month", "key")
    # references of those keys and months, before they are shuffled
    open_ = refs.withColumn("month", month_of("at")).join(checked_broadcast(changing), ["space", "table_no", "month", "key"], "left_semi").distinct()
    intervals = changing.join(olds, ["space", "key"])
    exact = (
        open_.join(intervals, ["space", "table_no", "month", "key"])
        .groupBy("table_no", "month", "key", "at")
        .agg(F.max(F.coalesce((F.col("added_at") <= F.col("at")) & (F.col("removed_at").isNull() | (F.col("at") < F.col("removed_at"))), F.lit(False))).alias("live"), F.max(F.coalesce(F.col("removed_at") <= F.col("at"), F.lit(False))).alias("gone"))
        .where(~F.col("live"))
        .select("table_no", "month", "key", F.when(F.col("gone"), "deleted").otherwise("late").alias("reason")).distinct()
    )
    cases = decided.where(F.col("verdict") != "changing").select("table_no", "month", "key", F.col("verdict").alias("reason")).unionAll(exact)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("table_no") + 1)
    return cases.select(name.alias("table_name"), month_name(F.col("month")).alias("load_month"), "key", "reason")


def orphan_report(cases: DataFrame) -> DataFrame:
    """Orphan keys per table, month and reason."""
    return cases.groupBy("table_name", "load_month", "reason").agg(F.count(F.lit(1)).alias("n_keys"))
