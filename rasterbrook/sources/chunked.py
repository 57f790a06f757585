"""Entropy segments without restart markers, decoded by as many tasks as they have chunks.

`entropy` tells how chunks are brought into step; here a chunk is a row. Each is
read from its first bit; where a chunk's start isn't where its neighbour left
off, it is read again from there, up to a block start that it has passed
before; this goes on until all agree. Chunks then know their blocks, running
sums over chunks give each its first block and the DC values before it, and all
are decoded for good. Between these steps stands a small row for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterbrook.operators import scan
from rasterbrook.operators.lineage import cut
from rasterbrook.sources import entropy
from rasterbrook.sources.images import _scan_of

#: Bytes of a chunk; of what follows it, the longest block is added.
CHUNK = 1024
EXTRA = entropy.LONGEST_BLOCK + 8
#: Block starts that a chunk remembers lie in so many of its first bytes.
REMEMBERED = 1024
#: Blocks that a task holds in decoded form.
HELD_BLOCKS = 1 << 16
_STATE = "chunk int, entry long, entry_block int, exit long, exit_block int, n long, sums array<long>, pattern array<int>, lost boolean, passed binary"


def chunks(segments: DataFrame, by: list[str], chunk: int = CHUNK) -> DataFrame:
    """(by, seg, chunk, is_last, mcu_start, mcu_count, head, bytes) of restart segments: a row for each chunk of their bytes."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / chunk)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk"), (i == count - 1).alias("is_last"), F.substring(F.col("bytes"), i * chunk + 1, F.when(i == count - 1, chunk).otherwise(chunk + EXTRA)).alias("bytes")))
    return segments.filter("error IS NULL").select(*by, "seg", "mcu_start", "mcu_count", "head", F.explode(cuts).alias("c")).select(*by, "seg", "c.chunk", "c.is_last", "mcu_start", "mcu_count", "head", "c.bytes")


class _Batch:
    """Chunks of an Arrow batch as lanes."""

    def __init__(self, batch: pa.RecordBatch, chunk: int):
        own = {c: batch.column(c).to_pylist() for c in ("bytes", "head", "is_last")}
        scans = [_scan_of(h) for h in own["head"]]
        self.patterns = [tuple(p) for p, _, _ in scans]
        self.streams = entropy.Streams(own["bytes"], self.patterns, [d for _, d, _ in scans], [a for _, _, a in scans])
        self.all = np.arange(len(scans))
        self.is_last = np.array(own["is_last"])
        self.end = np.where(self.is_last, self.streams.limit, self.streams.first + chunk * 8)

    def passed(self, data: list[bytes | None]) -> entropy.Passed:
        """What the lanes remember."""
        width = self.streams.pattern.shape[1]
        codes, blocks, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, width), np.int64)]
        for lane, raw in enumerate(data):
            if raw:
                rows = np.frombuffer(raw, "<i8").reshape(-1, 2 + len(self.patterns[lane]))
                codes.append(entropy.Passed.codes(np.int64(lane), self.streams.first[lane] + (rows[:, 0] >> 5), rows[:, 0] & 31))
                blocks.append(rows[:, 1])
                sums.append(np.pad(rows[:, 2:], ((0, 0), (0, width - rows.shape[1] + 2))))
        return entropy.Passed(np.concatenate(codes), np.concatenate(blocks), np.concatenate(sums)).sorted()

    def remembered(self, passed: entropy.Passed) -> list[bytes]:
        lane = passed.code >> 43
        bit = (passed.code >> 5 & (1 << 38) - 1) - self.streams.first[lane]
        near = bit < REMEMBERED * 8
        cuts = np.searchsorted(lane[near], np.arange(len(self.all) + 1))
        table = np.column_stack((bit[near] << 5 | passed.code[near] & 31, passed.blocks[near], passed.sums[near]))
        return [table[a:b, : 2 + len(p)].astype("<i8").tobytes() for a, b, p in zip(cuts, cuts[1:], self.patterns, strict=False)]


def _measured(rows: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """States of chunks; rows may have entry, entry_block, and the state that was there before (n, exit, exit_block, sums, passed)."""
    again = "entry" in rows.columns
    fields = [*keys, "chunk", "is_last", "head", "bytes", *(("entry", "entry_block", "exit", "exit_block", "passed") if again else ())]
    source = rows.select(*fields)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keys).schema), _STATE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _Batch(batch, chunk)
            lanes = entropy.prepared(own.streams, own.all, own.streams.first, own.end)
            known = None
            if again:
                lanes.bit += batch.column("entry").to_numpy()
                lanes.block[:] = batch.column("entry_block").to_numpy()
                # relative to the next chunk's start, as neighbours see it
                lanes.exit[:] = own.streams.first + chunk * 8 + batch.column("exit").to_numpy()
                lanes.exit_block[:] = batch.column("exit_block").to_numpy()
                known = own.passed(batch.column("passed").to_pylist())
            new = entropy.measure(own.streams, lanes, own.all, known)
            found = new.sorted() if known is None else known.without(lanes.alone).with_(new)
            sums = [x[: len(p)].tolist() for x, p in zip(lanes.sums, own.patterns, strict=True)]
            columns = [
                batch.column("chunk"),
                pa.array(lanes.bit - own.streams.first),
                pa.array(lanes.block.astype(np.int32)),
                pa.array(lanes.exit - own.streams.first - chunk * 8),
                pa.array(lanes.exit_block.astype(np.int32)),
                pa.array(lanes.blocks),
                pa.array(sums, pa.list_(pa.int64())),
                pa.array([list(p) for p in own.patterns], pa.list_(pa.int32())),
                pa.array(lanes.lost),
                pa.array(own.remembered(found), pa.binary()),
            ]
            yield pa.record_batch([*(batch.column(k) for k in keys), *columns], names=[*keys, "chunk", "entry", "entry_block", "exit", "exit_block", "n", "sums", "pattern", "lost", "passed"])

    return source.mapInArrow(run, schema)


def states(parts: DataFrame, by: list[str], chunk: int = CHUNK) -> DataFrame:
    """Where each chunk's blocks start, and how many they are: chunks in step."""
    keys = [*by, "seg"]
    found = cut(_measured(parts, keys, chunk))
    while True:
        left = found.select(*keys, (F.col("chunk") + 1).alias("chunk"), F.col("exit").alias("new"), F.col("exit_block").alias("new_block"))
        moved = found.join(left, [*keys, "chunk"]).filter((F.col("new") != F.col("entry")) | (F.col("new_block") != F.col("entry_block")))
        moved = cut(moved.select(*keys, "chunk", F.col("new").alias("entry"), F.col("new_block").alias("entry_block"), "exit", "exit_block", "passed"))
        if moved.isEmpty():
            return found
        again = _measured(parts.join(moved, [*keys, "chunk"]), keys, chunk)
        found = cut(found.join(moved.select(*keys, "chunk"), [*keys, "chunk"], "left_anti").unionByName(again))


def _placed(found: DataFrame, keys: list[str]) -> DataFrame:
    """States with first, the blocks before a chunk, and c0 to c2, the sums of the DC differences before it by component."""
    counted = scan.running_sum(found.drop("passed"), keys, "chunk", {"first": "n"}, inclusive=False)
    own = lambda c: F.expr(f"aggregate(sequence(0, size(pattern) - 1), 0L, (a, j) -> a + IF(pattern[CAST((first + j) % size(pattern) AS INT)] = {c}, sums[j], 0L))")
    return scan.running_sum(counted.withColumns({f"_c{c}": own(c) for c in range(3)}), keys, "chunk", {f"c{c}": f"_c{c}" for c in range(3)}, inclusive=False).drop("_c0", "_c1", "_c2", "sums", "pattern")


def _read(batch: pa.RecordBatch, chunk: int) -> tuple[_Batch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """(lanes, first, count, coefficients of all lanes' blocks, the bits behind, what is wrong with each)."""
    own = _Batch(batch, chunk)
    first, n, entry = (batch.column(c).to_numpy() for c in ("first", "n", "entry"))
    left = batch.column("mcu_count").to_numpy().astype(np.int64) * own.streams.length[own.streams.kind] - first
    count = np.where(own.is_last, left, np.minimum(n, left)).clip(0)
    bit = own.streams.first + entry
    short = own.is_last & (count * 2 > own.streams.limit - bit)
    count = np.where(short, 0, count)
    out = np.zeros((int(count.sum()), 64), np.int16)
    behind, failed = entropy.read_blocks(own.streams, own.all, bit, first, count, np.cumsum(count) - count, out)
    over = own.is_last & (left < 0) | own.is_last & ~short & (failed == 0) & (own.streams.limit - behind >= 8)
    wrong = ["a segment is cut short" if s else entropy.REASONS.get(int(f)) or ("bytes are left in a segment" if o else None) for s, f, o in zip(short, failed, over, strict=True)]
    return own, first, count, out, behind, wrong


def decode_chunks(segments: DataFrame, by: list[str], chunk: int = CHUNK) -> DataFrame:
    """A row per block of restart segments, of any length: by, seg, mcu, comp, block, coef (zigzag), as decode_restart_segments gives them; a broken segment is one row with its first mcu and error.

    by names the columns that tell files apart; none is null. Rows of segments with an error of their own are passed on.
    """
    if chunk <= EXTRA:
        raise ValueError("chunks are too small")
    keys = [*by, "seg"]
    # so many tasks, however few the bytes: they are dear to decode
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(chunks(segments, by, chunk).repartition(n, *keys, "chunk"))
    found = states(parts, by, chunk)
    placed = cut(parts.select(*keys, "chunk", "is_last").join(_placed(found, keys), [*keys, "chunk"]))
    mine = ["chunk", "is_last", "head", "bytes", "mcu_start", "mcu_count", "entry", "first", "n", "c0", "c1", "c2"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*keys).schema)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([*(batch.column(k) for k in keys), pa.array(_read(batch, chunk)[-1], pa.string())], names=[*keys, "error"])

    # a segment is whole if no chunk but its last lost its way, and its last ends where it should
    joined = parts.repartition(n, *keys, "chunk").join(placed.drop("is_last"), [*keys, "chunk"])
    lost = placed.filter("lost AND NOT is_last").select(*keys, F.lit(entropy.REASONS[2]).alias("error"))
    ends = joined.filter("is_last").select(*keys, *mine).mapInArrow(check, f"{kinds}, error string").filter("error IS NOT NULL")
    wrong = cut(lost.unionByName(ends).groupBy(*keys).agg(F.min("error").alias("error")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(batch.column("n").to_numpy())
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + HELD_BLOCKS)))
                yield decoded(batch.slice(a, b - a))
                a = b

    def decoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, first, count, out, _, _ = _read(batch, chunk)
        comp = entropy.components(own.streams, own.all, first, count)
        lane = np.repeat(own.all, count)
        before = np.column_stack([batch.column(f"c{c}").to_numpy() for c in range(3)])
        coef = out.astype(np.int32)
        coef[:, 0] = entropy.dc_values(out[:, 0].astype(np.int64), count, comp) + before[lane, comp]
        place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(lane))
        length = own.streams.length[own.streams.kind[lane]]
        # which of its component's blocks of the MCU it is
        pattern = own.streams.pattern
        same = (pattern[:, :, None] == pattern[:, None, :]) & np.tri(pattern.shape[1], k=-1, dtype=bool)[None]
        turn = same.sum(2)[own.streams.kind[lane], place % length].astype(np.int32)
        mcu = batch.column("mcu_start").to_numpy()[lane] + place // length
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lane) + 1, dtype=np.int32) * 64), pa.array(coef.ravel()))
        at = pa.array(lane)
        return pa.record_batch([*(batch.column(k).take(at) for k in keys), pa.array(mcu.astype(np.int32)), pa.array(comp.astype(np.int32)), pa.array(turn), lists], names=[*keys, "mcu", "comp", "block", "coef"])

    fine = joined.join(wrong.select(*keys), keys, "left_anti").select(*keys, *mine)
    blocks = fine.mapInArrow(run, f"{kinds}, mcu int, comp int, block int, coef array<int>").withColumn("error", F.lit(None).cast("string"))
    first_mcu = parts.filter("chunk = 0").select(*keys, F.col("mcu_start").alias("mcu")).join(wrong, keys)
    failed = segments.filter("error IS NOT NULL").select(*keys, F.col("mcu_start").alias("mcu"), "error").unionByName(first_mcu)
    return blocks.unionByName(failed, allowMissingColumns=True)
