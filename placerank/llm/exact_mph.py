"""Exact deduplication through a minimal perfect hash over historical distinct digests.

The index of a history holds one slot for each distinct text digest: the full SHA-256 and the
winner's locator (its ``doc_id``). Digests are split over shards by their leading bits; in each
shard a cascade of bit arrays gives every member its own slot (keys alone at their position in
level 0 settle there, the rest fall to the next level, and a slot is the rank of the settled
bit), which takes a few bits a key. A lookup asks the function for a slot and compares the full
digest there byte by byte, so a nonmember is never taken for a member.

``dedup(history, batch)``: the batch is looked up in the index of the history; members are
repeats of a historical text, nonmembers are grouped by digest on their own; winners of both are
laid into a new index, from which every row reads its winner.

Defined cases: a null text counts as empty; empty texts are equal to each other; of equal texts
the row with the largest ``doc_id`` stays (null ids come last); of rows that agree in both text
and ``doc_id`` exactly one stays; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, rows_each, saved, small_side, whole_text

SHARD_KEYS = 8192       # digests aimed at in a shard: bounds the task that builds or probes one
SHARD_LOOKUPS = 32768   # lookups aimed at in one task group; hot shards are salted beyond it
BROADCAST_ROWS = 500_000  # removed rows (id and digest) that are broadcast at most; more are shuffled
LEVELS, GAMMA = 40, 1.5

INDEX = "shard long, n_keys int, sizes binary, bits binary, digests binary, winners binary, copies binary"


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of each digest in a level's bit array. Digests are uniform already; a level
    mixes two of their words with its own odd number."""
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
    x = (words[:, 1] ^ (words[:, 2] * odd)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return ((x * odd) >> np.uint64(11)) % np.uint64(size)


def build_function(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the levels, their bits one after the other) for distinct digests (n x 32 bytes)."""
    words = digests.view(">u8").astype(np.uint64)
    sizes, bits, level = [], [], 0
    while len(words):
        if level == LEVELS:
            raise ValueError("digests are not distinct")
        size = max(8, int(GAMMA * len(words)))
        at = _positions(words, level, size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        words, level = words[~alone[at]], level + 1
    return np.array(sizes, dtype=np.int64), np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(digests: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 where every level is empty at its position (surely a nonmember)."""
    words = digests.view(">u8").astype(np.uint64)
    rank = np.cumsum(bits) - 1
    out, open_, base = np.full(len(words), -1, dtype=np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = base + _positions(words[open_], level, int(size)).astype(np.int64)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + int(size)
    return out


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, col)), dtype=np.uint8).reshape(-1, 32)


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _matrix(pdf["digest"])
    sizes, bits = build_function(keys)
    to = slots(keys, sizes, bits)
    order = np.empty(len(to), dtype=np.int64)
    order[to] = np.arange(len(to))
    winners = pdf["winner"].to_numpy(dtype=np.int64)[order]
    copies = pdf["copies"].to_numpy(dtype=np.int64)[order]
    return pd.DataFrame([{
        "shard": pdf["shard"].iloc[0], "n_keys": len(keys), "sizes": sizes.tobytes(),
        "bits": np.packbits(bits).tobytes(), "digests": keys[order].tobytes(),
        "winners": winners.tobytes(), "copies": copies.tobytes()}])


def _probe(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Look up one salted part of a shard's digests; ``winner`` is null for a nonmember."""
    out = asked[["doc_id", "digest", "rows", "historical"]].copy()
    out["member"], out["winner"], out["copies"] = False, pd.array([None] * len(out), "Int64"), 0
    if not len(asked) or not len(index):
        return out
    row = index.iloc[0]
    n, sizes = int(row["n_keys"]), np.frombuffer(row["sizes"], dtype=np.int64)
    bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=int(sizes.sum())).astype(bool)
    keys = _matrix(asked["digest"])
    at = slots(keys, sizes, bits)
    found = np.flatnonzero(at >= 0)
    stored = np.frombuffer(row["digests"], dtype=np.uint8).reshape(n, 32)
    same = found[(stored[at[found]] == keys[found]).all(axis=1)]  # byte check
    winners = np.frombuffer(row["winners"], dtype=np.int64)[at[same]]
    mask = np.zeros(len(out), bool)
    mask[same] = True
    out["member"] = mask
    out.loc[mask, "winner"] = winners
    out.loc[mask, "copies"] = np.frombuffer(row["copies"], dtype=np.int64)[at[same]]
    return out


NO_ID = -(2 ** 63)  # locator of a winner without doc_id


class DigestIndex:
    """Sharded index; ``table`` has a row of bounded size for each shard."""

    def __init__(self, table: DataFrame, shards: int):
        self.table, self.shards = table, shards

    def shard_of(self, digest="digest"):
        """Leading 32 bits of the digest spread over the shards."""
        lead = F.conv(F.substring(F.hex(F.col(digest)), 1, 8), 16, 10).cast("long")
        return F.shiftright(lead * F.lit(self.shards), 32)

    @classmethod
    def build(cls, groups: DataFrame) -> "DigestIndex":
        """Index distinct digests: rows (digest, winner long, copies long)."""
        groups = saved(groups.select("digest", "winner", "copies"), "groups")
        index = cls(groups, max(1, -(-groups.count() // SHARD_KEYS)))
        keyed = groups.withColumn("shard", index.shard_of())
        index.table = saved(keyed.groupBy("shard").applyInPandas(_build_shard, INDEX), "mph")
        return index

    def lookup(self, asked: DataFrame) -> DataFrame:
        """Rows (doc_id, digest, rows, historical) with member, winner and copies of their slot. Shards that
        many rows ask for (hot texts) are split over salts, their index row sent to each."""
        keyed = asked.withColumn("shard", self.shard_of())
        load = keyed.groupBy("shard").count()
        salts = load.select("shard", F.ceil(F.col("count") / SHARD_LOOKUPS).cast("int").alias("salts"))
        keyed = keyed.join(small_salts(salts, self.shards), "shard") \
            .withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("salts")).cast("int")).drop("salts")
        parts = self.table.join(small_salts(salts, self.shards), "shard") \
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        return keyed.groupBy("shard", "salt").cogroup(parts.groupBy("shard", "salt")).applyInPandas(
            _probe, "doc_id long, digest binary, rows long, historical boolean, member boolean, winner long, copies long")


def small_salts(salts: DataFrame, shards: int) -> DataFrame:
    """One (shard, salts) row for each shard: broadcast only while they are few."""
    return F.broadcast(salts) if shards <= 1_000_000 else salts


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, rows): rows of the same id and text are one, counted."""
    normal = ascii_lower(whole_text())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest")) \
        .groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))


def _winners(rows: DataFrame, winner="doc_id", copies="rows") -> DataFrame:
    return rows.groupBy("digest").agg(F.max(F.coalesce(F.col(winner), F.lit(NO_ID))).alias("winner"),
                                      F.sum(copies).alias("copies"))


def dedup(history: DataFrame, batch: DataFrame) -> DataFrame:
    """One row for each row of ``history`` and ``batch`` (columns doc_id, text): doc_id, keep_id,
    group_size, kept, text_sha256, historical (its text was in the history)."""
    return dedup_digests(saved(digests(history), "digests"), saved(digests(batch), "digests"))


def dedup_digests(old: DataFrame, new: DataFrame) -> DataFrame:
    """``dedup`` over stored tables of :func:`digests`."""
    old, new = old.withColumn("historical", F.lit(True)), new.withColumn("historical", F.lit(False))
    old_groups = _winners(old)
    looked = saved(DigestIndex.build(old_groups).lookup(new), "looked")
    repeats = _winners(looked.where("member"))      # of historical texts
    fresh = _winners(looked.where("NOT member"))    # grouped on their own
    merged = old_groups.unionByName(repeats).groupBy("digest") \
        .agg(F.max("winner").alias("winner"), F.sum("copies").alias("copies")).unionByName(fresh)
    index = DigestIndex.build(merged)
    rows = old.unionByName(looked.select("doc_id", "digest", "rows", F.col("member").alias("historical")))
    both = rows.groupBy("doc_id", "digest").agg(F.sum("rows").alias("rows"), F.max("historical").alias("historical"))
    is_winner = F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.col("winner")
    return rows_each(index.lookup(both), "rows").select(
        "doc_id", F.when(F.col("winner") != NO_ID, F.col("winner")).alias("keep_id"),
        F.col("copies").alias("group_size"), (is_winner & (F.col("copy") == 0)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "historical")


def dedup_table(docs: DataFrame) -> DataFrame:
    """``dedup`` of one table: the half of the ids with an even hash is taken as the history, the
    other half as the batch that arrives; every row is in one of them."""
    rows = saved(digests(docs), "digests")
    even = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(2)) == 0
    return dedup_digests(rows.where(even), rows.where(~even))


def keep_winners(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns and without repeats: of equal texts one row stays."""
    out = saved(dedup_table(docs).where("NOT kept").select(
        F.col("doc_id").alias("_llm_id"), F.col("text_sha256").alias("_llm_sha"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("twin")).distinct(), "repeats")
    n = {r["twin"]: r["n"] for r in out.groupBy("twin").agg(F.count(F.lit(1)).alias("n")).collect()}
    keyed = docs.withColumn("_llm_digest", F.sha2(ascii_lower(whole_text()).cast("binary"), 256))
    gone = small_side(out.where("NOT twin"), n.get(False, 0), BROADCAST_ROWS)
    twin = small_side(out.where("twin"), n.get(True, 0), BROADCAST_ROWS)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_digest") == F.col("_llm_sha"))
    left = keyed.join(gone, same, "left_anti") if n.get(False) else keyed
    if n.get(True):  # rows that agree in both id and text: one of them
        left = left.join(twin, same, "left_anti").unionByName(
            left.join(twin, same, "left_semi").dropDuplicates(["doc_id", "_llm_digest"]))
    return left.select(*docs.columns)
