"""Sharding by histogram sort: exact byte counts below probe keys refine the splitters, then one exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bits of the key range that one counting round resolves.
BITS = 10


def _splitters(keys: DataFrame, shards: int, tolerance: float, whole: float) -> list[tuple[int, int | None]]:
    """shards - 1 boundaries (h, d): what sorts before (h, d) lies below; d None: all of hash h lies above.

    Each round counts the bytes in 2^BITS equal cells of every range that still holds an unsettled target; only
    those counts (at most shards * 2^BITS rows) come to the driver, whatever the input's size. keys: (h, d, size), h and d
    being unsigned 64-bit numbers held in a long with the top bit flipped, so that longs sort as they do."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    mean = total / shards
    out: dict[int, tuple[int, int | None]] = {}
    # (first hash, hash of a hot text or None, first key of the range, log2 of its width) -> (bytes below the range, targets in it)
    ranges = {(None, -(1 << 63), 64): (0, [total * (j + 1) / shards for j in range(shards - 1)])}
    while ranges:
        counts: dict[tuple, dict[int, int]] = {k: {} for k in ranges}
        listed = list(ranges)
        for level in ("h", "d"):
            own = [(i, k) for i, k in enumerate(listed) if (k[0] is None) == (level == "h")]
            if not own:
                continue
            cell, which = F.lit(None).cast("long"), F.lit(None).cast("int")
            for i, (hot, first, log) in own:
                x = F.col(level)
                inside = F.lit(True) if log == 64 else x.between(first, first + (1 << log) - 1)
                inside = inside if hot is None else inside & (F.col("h") == hot)
                step = max(log - BITS, 0)
                # flipping the top bit back makes the difference an unsigned offset
                at = F.shiftrightunsigned(x.bitwiseXOR(F.lit(-(1 << 63))) if log == 64 else x - F.lit(first), step)
                which, cell = F.when(inside, F.lit(i)).otherwise(which), F.when(inside, at).otherwise(cell)
            found = keys.select(which.alias("range"), cell.alias("cell"), "size").where("range is not null").groupBy("range", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
            for r in found.collect():
                counts[listed[r["range"]]][r["cell"]] = r["bytes"]
        following: dict[tuple, tuple[int, list]] = {}
        for (hot, first, log), (below, targets) in ranges.items():
            step, sums = max(log - BITS, 0), sorted(counts[(hot, first, log)].items())
            for t in targets:
                at, before = 0, below
                for cell, n in sums:  # the cell in which the target lies
                    if before + n >= t:
                        break
                    before += n
                else:
                    cell, n = (1 << min(log, BITS)) - 1, 0
                j = round(t * shards / total) if total else 0
                start = first + (cell << step)
                lower, upper = t - before, before + n - t
                at_end = start + (1 << step)
                if min(lower, upper) <= tolerance * mean or step == 0 and (hot is not None or n <= whole * mean):
                    key = start if lower <= upper else at_end
                    out[j] = (key, None) if hot is None else (hot, key)
                elif step == 0:  # one text holds more than a shard may be off by: refine within it, by document
                    k = (start, -(1 << 63), 64)
                    following.setdefault(k, (before, []))[1].append(t)
                else:
                    following.setdefault((hot, start, step), (before, []))[1].append(t)
        ranges = following
    return [out[j] for j in sorted(out)]


def histogram_shards(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", tolerance: float = 0.001, whole: float = 0.1) -> DataFrame:
    """All rows of docs with shard (0 to shards - 1, near equal in bytes) and slot (gapless from 0 within its shard).

    Rows sort by (hash of the text, hash of the key), so equal texts lie together. A boundary falls between two texts
    wherever that keeps it within `tolerance` of a mean shard; a text whose copies hold at most `whole` of a mean
    shard is never cut, more frequent ones are cut between copies. So a boundary is off by at most half of `whole` (or by `tolerance`), and a
    shard holds between 1 - whole and 1 + whole of a mean one, if no single row is larger than that. A row's bytes are those of its UTF-8 text plus 8.
    Null texts count as empty, null keys are allowed, rows that agree in text and key lie together, in any order; an
    empty table gives an empty result. Columns named shard or slot are replaced."""
    docs = docs.drop("shard", "slot")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    h, d = F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.xxhash64(F.lit(7), F.col(key))
    keys = materialize(docs.select(h.alias("h"), d.alias("d"), size.alias("size")), "keys")
    shard = F.lit(0)
    for hash_, doc in _splitters(keys, shards, tolerance, whole):
        if hash_ >= 1 << 63:
            continue
        above = F.col("_h") >= F.lit(hash_) if doc is None else (F.col("_h") > F.lit(hash_)) | ((F.col("_h") == F.lit(hash_)) & (F.col("_d") >= F.lit(doc)) if doc < 1 << 63 else F.lit(False))
        shard = shard + above.cast("int")
    order = ["shard", "_h", "_d"]
    dealt = docs.withColumns({"_h": h, "_d": d}).withColumn("shard", shard).repartitionByRange(*order).sortWithinPartitions(*order)
    # the one exchange; a row's place in its task is in the id's low 33 bits
    placed = materialize(dealt.withColumn("_id", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_id", 33)).drop("_h", "_d"), "shards")
    runs = placed.groupBy("shard", "_task").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    before = F.expr("coalesce(sum(n) over (partition by shard order by _task rows between unbounded preceding and 1 preceding), 0)")
    runs = runs.select("shard", "_task", (before - F.col("first")).alias("_shift"))
    # runs has at most a row for each task and shard boundary, so it is bounded by the number of tasks
    return placed.join(F.broadcast(runs), ["shard", "_task"]).withColumn("slot", F.col("_id") + F.col("_shift")).select(*docs.columns, "shard", "slot")
