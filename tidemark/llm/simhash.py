"""SimHash near-duplicate grouping by multi-index hashing.

A text's 64-bit fingerprint is the majority vote over the XXH64 hashes of its word shingles. Two
fingerprints link at two or fewer differing bits. Halves of 32 bits are indexed: when two fingerprints
differ in at most two bits, either their high halves differ in at most one bit or their low halves are
equal. So each fingerprint looks up the 33 values of the radius-1 Hamming ball round its high half and the
one value of its low half, and verifies the complete distance of what it finds.

A bucket of more than ``bucket_limit`` distinct fingerprints would give a number of pairs that grows with
its square. Everything that looks such a bucket up instead enumerates the 65 values of the radius-1 ball
round the whole fingerprint: two fingerprints within two bits share a centre, those that share a centre are
within two bits of each other, and a centre has at most 65 members, so linking each member to the least one
connects exactly the same groups with a linear number of links.

Cases: null text counts as empty; a text with no words has fingerprint zero, which links like any other;
fewer words than a shingle make one shingle of the whole sequence; exact copies share a fingerprint and are
handled once. Rows with a null id get a component too; its id is the least id that is not null, or null.
Repeated rows stay repeated. Other columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, checkpointed, quoted, unused

SEED = 42
SHINGLE = 3
BUCKET_LIMIT = 64
SALTS = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text. bytes.split() knows just the six ASCII white-space bytes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    grams = [words] if len(words) < shingle else zip(*(words[i:] for i in range(shingle)))
    digest, joined = xxhash.xxh64_intdigest, b" ".join
    return vote(np.array([digest(joined(g), SEED) for g in grams], dtype="<u8"))


def vote(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounds the memory that a very long text takes
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "text_hash", "fp"])

    text = quoted(text_col).cast("string")
    slim = docs.select(quoted(id_col).cast("long").alias("id"), _text_hash(text).alias("text_hash"), text.alias("text"))
    return slim.mapInArrow(run, "id long, text_hash long, fp long")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def links(nodes: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(u, v), u < v: links that connect the distinct fingerprints in nodes(fp) just as all links would."""
    hi, lo = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    table = nodes.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), hi.alias("key")), F.struct(F.lit(1).alias("seg"), lo.alias("key")))).alias("e")).select("e.seg", "e.key", "fp")
    ball = [hi] + [hi.bitwiseXOR(F.lit(1 << i)) for i in range(32)]
    probes = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(0).alias("seg"), k.alias("key")) for k in ball), F.struct(F.lit(1).alias("seg"), lo.alias("key")))).alias("e")).select("e.seg", "e.key", F.col("fp").alias("asks"))
    sizes = table.groupBy("seg", "key").agg(F.count("*").alias("n"))
    hot = checkpointed(sizes.where(F.col("n") > bucket_limit).select("seg", "key"))
    crowded = not hot.isEmpty()
    small = table.join(hot, ["seg", "key"], "left_anti") if crowded else table
    near = F.bit_count(F.col("asks").bitwiseXOR(F.col("fp"))) <= 2
    verified = probes.join(small, ["seg", "key"]).where((F.col("asks") < F.col("fp")) & near).select(F.col("asks").alias("u"), F.col("fp").alias("v"))
    if not crowded:
        return verified.distinct()
    crowd = probes.join(hot, ["seg", "key"], "left_semi").select("asks").distinct()
    centres = [F.col("asks")] + [F.col("asks").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)]
    met = crowd.select("asks", F.explode(F.array(*centres)).alias("centre")).groupBy("centre").agg(F.collect_list("asks").alias("members"))
    stars = met.where(F.size("members") > 1).select(F.array_min("members").alias("u"), F.explode("members").alias("v")).where(F.col("u") < F.col("v"))
    return verified.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node reachable, for the nodes of edges(u, v).

    Hooking and pointer jumping on a table of parents: a number of rounds that is logarithmic in practice. The
    nodes of a popular parent are first counted as one row for each of SALTS parts, which look the parent's own
    parent up; an offer to a parent is made only if it is lower, and is pre-aggregated.
    """
    both = checkpointed(edges.select("u", "v").union(edges.select("v", "u")))
    part = F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("part")
    parents = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("p")))
    total = lambda t: t.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]
    last = total(parents)
    while last is not None:
        up = parents.select(F.col("node").alias("p"), F.col("p").alias("gp"))
        asked = parents.select("p", part).distinct().join(up, "p")
        grand = parents.select("node", "p", part).join(asked, ["p", "part"]).select("node", "p", "gp")
        least = both.join(grand.select(F.col("node").alias("v"), "gp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("gp").alias("m"))
        told = grand.join(least, "node").select("node", "p", F.least("p", "gp", "m").alias("m"))
        mine, higher = F.struct(F.col("node"), F.col("m").alias("p")), F.struct(F.col("p").alias("node"), F.col("m").alias("p"))
        offers = told.select(F.explode(F.when(F.col("m") < F.col("p"), F.array(mine, higher)).otherwise(F.array(mine))).alias("o")).select("o.*")
        parents = checkpointed(offers.groupBy("node").agg(F.min("p").alias("p")))
        now = total(parents)
        if now == last:
            break
        last = now
    return parents.select("node", F.col("p").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(id, text_hash, fp, label, component_id) of every row of docs: label is the least fingerprint of its group."""
    rows = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    edges = checkpointed(links(nodes.select("fp"), bucket_limit))
    groups = nodes.join(components(edges), nodes.fp == F.col("node"), "left").select("fp", "least_id", F.coalesce("label", "fp").alias("label"))
    heads = groups.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = checkpointed(groups.join(heads, "label").select("fp", "label", "component_id"))
    return rows.join(named, "fp").select("id", "text_hash", "fp", "label", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row of each group of near duplicates, unchanged: the one with the least id (then the least hash of its text).

    Of rows that repeat in id and text, one stays. Rows with a null id come last in their group.
    """
    return one_of_each(docs, near_duplicates(docs, id_col, text_col, shingle, bucket_limit), id_col, text_col)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What keep_one keeps of docs, given the label of each of its rows: found(id, text_hash, label). What goes is listed
    and left out, so the texts aren't shuffled while that list's counted size allows a broadcast."""
    found = checkpointed(found.select("id", "text_hash", "label"))
    asked, hashed = unused(docs, "__id"), unused(docs, "__hash")
    best = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("b"))
    chosen = best.select(F.col("b.id").alias("chosen_id"), F.col("b.text_hash").alias("chosen_hash"))
    each = checkpointed(found.groupBy("id", "text_hash").agg(F.count("*").alias("n")))
    stays = each["id"].eqNullSafe(chosen["chosen_id"]) & (each["text_hash"] == chosen["chosen_hash"])
    gone = checkpointed(each.join(chosen, stays, "left_anti").select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash")))
    rows = docs.withColumn(hashed, _text_hash(quoted(text_col).cast("string"))).withColumn(asked, quoted(id_col).cast("long"))
    listed = gone.select(F.col("gone_id").alias(unused(docs, "__gone_id")), F.col("gone_hash").alias(unused(docs, "__gone_hash")))
    same = F.col(asked).eqNullSafe(F.col(listed.columns[0])) & (F.col(hashed) == F.col(listed.columns[1]))
    small = 32 * gone.count() <= BROADCAST_BYTES
    kept = rows.join(F.broadcast(listed) if small else listed, same, "left_anti")
    if not each.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([asked, hashed])
    return kept.select(*(quoted(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """The columns that query op10 returns."""
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
