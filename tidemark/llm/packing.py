"""Best-fit packing of documents into sequences by exact-complement hashing.

Documents longer than a sequence are cut into full pieces and a rest. How the pieces of each length are put
together is decided on the histogram of lengths, which has one entry for each length up to the sequence's,
however many pieces there are. Single lengths and the sums of two and of three are indexed by their value; taking
lengths from the longest down, the plan looks the remaining gap up in the three indexes and uses the available
combination that fills the gap exactly as often as the counts allow. What no combination completes is packed
by best fit, longest first, many equal pieces at a time.

The plan is a list of segments: so many pieces of one length, by rank among that length, go to consecutive
sequences at one offset. A step of the plan uses up a length (or halves it), so segments are bounded by the
sequence's length too. Pieces are ranked within (length, partition) and the partitions' counts are summed up
in order, so the pieces of a popular length never meet in one task.

Cases: null text counts as empty; an empty document is its end token alone; equal documents are packed each;
a document that fills a sequence exactly is one piece; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import treebpe
from tidemark.llm.common import checkpointed, quoted

LENGTH = 4096
END = 1


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids, the end token, cut every ``length`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = treebpe.forms(path, "packed"), END.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join(cache.of(t.as_py())) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Sums:
    """Sums of one, two and three lengths, each indexed by its value with the combination whose longest length is the
    longest. Counts only fall, so an entry is looked at again when it is used and a part has run out, and
    a sum that has no combination any more never has one again."""

    def __init__(self, have: np.ndarray) -> None:
        """have: how many pieces there are of each length. It is read as it changes."""
        self.have, size = have, len(have)
        self.pair, self.triple = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)  # the longest length of each, 0 for none
        lengths = np.flatnonzero(have)
        for a in lengths.tolist():
            sums = a + lengths[lengths <= a]
            self.pair[sums[sums < size]] = a
        pairs = np.flatnonzero(self.pair)
        for a in lengths.tolist():
            sums = a + pairs[self.pair[pairs] <= a]
            self.triple[sums[sums < size]] = a

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One to three available lengths that sum to gap."""
        if gap <= 0:
            return None
        if self.have[gap]:
            return (gap,)
        return self._pair(gap) or self._triple(gap)

    def _pair(self, gap: int) -> tuple[int, int] | None:
        a = int(self.pair[gap])
        if a and not (self.have[a] and self.have[gap - a] > (2 * a == gap)):
            there = self.have[:gap] > 0
            both = np.flatnonzero(there[1:] & there[:0:-1]) + 1  # a and gap - a are there
            both = both[(2 * both != gap) | (self.have[both] > 1)]
            a = self.pair[gap] = int(both[-1]) if len(both) else 0
        return (a, gap - a) if a else None

    def _triple(self, gap: int) -> tuple[int, int, int] | None:
        first = int(self.triple[gap])
        for a in np.flatnonzero(self.have[: first + 1])[::-1].tolist():
            if 3 * a < gap:  # a is the longest of the three
                break
            if not self.pair[gap - a]:
                continue
            self.have[a] -= 1
            before = int(self.pair[gap - a])
            rest = self._pair(gap - a)
            self.have[a] += 1
            if rest:
                self.triple[gap] = a
                return (a, *rest)
            self.pair[gap - a] = before  # it may be there without this a
        self.triple[gap] = 0
        return None


def complements(have: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One to three lengths, each available (have is the counts by length), that sum to gap."""
    return Sums(have).complement(gap)


Plan = list[tuple[list[tuple[int, int]], int]]


def plan(counts: dict[int, int], length: int = LENGTH) -> Plan:
    """What sequences to make: ([(length, how many in a row)...], how many such sequences).

    Exact combinations first, then best fit; where a handful of pieces makes that worse than best fit alone, the latter.
    """
    have = np.zeros(length + 1, dtype=np.int64)
    for n, k in counts.items():
        have[n] = k
    full: Plan = [([(length, 1)], int(have[length]))] if have[length] else []
    have[length] = 0
    plain = _best_fit(have, length)
    exact = _exact(have, length)
    both = exact + _best_fit(have, length)
    return full + min(both, plain, key=lambda made: sum(times for _, times in made))


def _exact(have: np.ndarray, length: int) -> Plan:
    """Sequences filled exactly by up to four pieces, longest lengths first; takes what it uses from have."""
    made, sums = [], Sums(have)
    for n in range(length - 1, 0, -1):
        while have[n]:
            have[n] -= 1
            found = sums.complement(length - n)
            have[n] += 1
            if not found:
                break
            parts: dict[int, int] = {}
            for x in (n, *found):
                parts[x] = parts.get(x, 0) + 1
            times = min(int(have[x]) // k for x, k in parts.items())
            for x, k in parts.items():
                have[x] -= times * k
            made.append((sorted(parts.items(), reverse=True), times))
    return made


def _best_fit(have: np.ndarray, length: int) -> Plan:
    """All pieces by best fit, longest first, as many equal ones at a time as fit in equal sequences."""
    room: dict[int, Plan] = {}  # by what is left in the sequence
    for n in np.flatnonzero(have)[::-1].tolist():
        left = int(have[n])
        while left:
            fits = min((r for r, x in room.items() if r >= n and x), default=None)
            if fits is None:
                each = min(length // n, left)
                times, left = left // each, left % each
                room.setdefault(length - n * each, []).append(([(n, each)], times))
                continue
            held, times = room[fits].pop()
            each = min(fits // n, max(1, left // times))
            take = min(times, left // each)
            if take < times:
                room[fits].append((held, times - take))
            room.setdefault(fits - n * each, []).append(([*held, (n, each)], take))
            left -= take * each
    return [x for group in room.values() for x in group]


def segments(made: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, how many in a sequence, sequences, first sequence, offset), by length and rank."""
    rows, used, sequence = [], {}, 0
    for parts, times in made:
        offset = 0
        for n, each in parts:
            rows.append((n, used.get(n, 0), each, times, sequence, offset))
            used[n] = used.get(n, 0) + each * times
            offset += n * each
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """cut with sequence_id and offset. cut has the columns of ``pieces``."""
    kept = checkpointed(cut.withColumn("__at", F.monotonically_increasing_id()))
    kept = kept.withColumn("__part", F.shiftright("__at", 33))
    each = checkpointed(kept.groupBy("length", "__part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = each.select("length", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    table = segments(plan(counts, length))
    names = cut.columns
    local = F.row_number().over(Window.partitionBy("length", "__part").orderBy("__at")) - 1
    ranked = kept.withColumn("__rank", local).join(first, ["length", "__part"]).withColumn("__rank", F.col("__rank") + F.col("__first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 40) + table[:, 1]
        for batch in batches:
            n, rank = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "__rank"))
            row = table[np.searchsorted(keys, (n << 40) + rank, side="right") - 1] if batch.num_rows else table[:0]
            at = rank - row[:, 1]
            sequence, offset = row[:, 4] + at // np.maximum(row[:, 2], 1), row[:, 5] + at % np.maximum(row[:, 2], 1) * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.select(*names, "__rank").mapInArrow(run, types + ", sequence_id long, offset long")
