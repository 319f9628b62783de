"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most ``LENGTH`` tokens; pieces are dealt at random into shards of
bounded size, and each shard is packed on several islands. An individual is a grouping of the
shard's pieces into bins. Crossover takes whole well-filled bins of one parent into the other,
drops the bins there that hold the same pieces and some of the emptiest, and best-fits the
displaced pieces. The first population holds best fit by decreasing length and random orders; the
fittest have the fewest bins, then the fullest, so that free room gathers in few bins. An island
stops early only where neither can get better. Between epochs every island sends its elite to the next
island of its shard. Bins that stay poorly filled are opened and their pieces packed once more
across shards, so a shard's end costs next to nothing.

Defined cases: a null text is empty and has its end id only; repeated rows and ids are documents
of their own; a null id stays null; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved
from .subword import MOST_BYTES, MOST_REMEMBERED, encoder

LENGTH = 4096
SHARD_PIECES = 16384
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 3, 4
EFFORT = 150_000          # pieces that an island places in an epoch, where a shard is small enough for more generations
MOST_GENERATIONS = 250
GOOD_FILL = 0.99          # bins below it are packed once more across shards
TOKENIZER, END_ID = "word_bpe_49k.json", 1

PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches, enc, end_id, length):
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        out = []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text"))):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), length)):
                part = ids[start:start + length]
                out.append((row, doc, piece, start, len(part), zlib.crc32(part)))
                row += 1
        cols = list(zip(*out)) if out else [()] * len(PIECES)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, PIECES)], schema=PIECES)


def pieces(docs: DataFrame, tokenizer=TOKENIZER, end_id=END_ID, length=LENGTH, most_bytes=MOST_BYTES,
           most_remembered=MOST_REMEMBERED) -> DataFrame:
    """Stored pieces: row (a number of its own), doc_id, piece, start, length, ids_crc32.
    ``most_bytes`` and ``most_remembered`` bound the encoder's memory and change no row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cut(batches):
        yield from _pieces(batches, encoder(tokenizer, most_bytes, most_remembered), end_id, length)

    return saved(rows.mapInArrow(cut, PIECES_DDL), "pieces")


def best_fit(lengths, room: list[int], capacity: int) -> list[int]:
    """Bin of each length in turn: the bin with the least room that holds it, else a new one.
    ``room`` of the bins so far is kept up to date."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for b, r in enumerate(room):
        if r:
            by_room[r].append(b)
            some |= 1 << r
    out = []
    for size in lengths:
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        left = room[b] = r - size
        if left:
            by_room[left].append(b)
            some |= 1 << left
        out.append(b)
    return out


class Island:
    """One island's population over a shard's pieces. ``crossings`` counts the crossovers it ran."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths, capacity
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.crossings = 0
        full, rest = divmod(int(lengths.sum()), capacity)
        self.ideal = (full + (rest > 0), -float(full * capacity ** 2 + rest ** 2))

    def fresh(self, noise: float) -> np.ndarray:
        """Best fit in order of decreasing length, blurred; in random order without a bound on the blur."""
        if np.isinf(noise):
            order = self.rng.permutation(len(self.lengths))
        else:
            order = np.argsort(-self.lengths * (1 + noise * self.rng.random(len(self.lengths))), kind="stable")
        bins = np.empty(len(order), dtype=np.int64)
        bins[order] = best_fit(self.lengths[order].tolist(), [], self.capacity)
        return bins

    def fitness(self, bins: np.ndarray) -> tuple[int, float]:
        fill = np.bincount(bins, weights=self.lengths)
        return int((fill > 0).sum()), -float((fill ** 2).sum())

    def regroup(self, kept: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """The pieces marked ``kept`` stay in their ``groups``, the others are best-fitted: half
        the time by decreasing length, else in an order blurred at random."""
        child = np.empty(len(groups), dtype=np.int64)
        _, own = np.unique(groups[kept], return_inverse=True)
        child[kept] = own
        n = int(own.max()) + 1 if len(own) else 0
        room = (self.capacity - np.bincount(own, weights=self.lengths[kept], minlength=n)).astype(int).tolist()
        loose = np.flatnonzero(~kept)
        blur = 1 + (self.rng.random() < 0.5) * self.rng.random(len(loose))
        loose = loose[np.argsort(-self.lengths[loose] * blur, kind="stable")]
        child[loose] = best_fit(self.lengths[loose].tolist(), room, self.capacity)
        return child

    def cross(self, mother: np.ndarray, father: np.ndarray) -> np.ndarray:
        """Whole well-filled bins of the father go into the mother, whose bins with the same pieces
        are dropped; so are some of her least filled ones. What is displaced is best-fitted."""
        self.crossings += 1
        fill = np.bincount(father, weights=self.lengths)
        taken = ((fill >= np.quantile(fill, 0.5)) & (self.rng.random(len(fill)) < 0.5))[father]
        dropped = np.zeros(int(mother.max()) + 1, bool)
        dropped[mother[taken]] = True
        room = self.capacity - np.bincount(mother, weights=self.lengths)
        dropped |= (room > 0) & (self.rng.random(len(room)) < room / max(room.max(), 1))
        groups = np.where(taken, father + len(dropped), mother)
        return self.regroup(taken | ~dropped[mother], groups)

    def evolve(self, guests: list[np.ndarray], effort: int = EFFORT) -> np.ndarray:
        """Fittest of the guests and fresh individuals after ``GENERATIONS`` generations, or as many
        as place ``effort`` pieces; ends where neither bins nor free room can get better."""
        noise = (0.0, 0.3, np.inf, np.inf)
        group = [g for g in guests] + [self.fresh(noise[i % len(noise)]) for i in range(POPULATION - len(guests))]
        ranked = sorted(((self.fitness(g), i, g) for i, g in enumerate(group)), key=lambda x: x[:2])
        serial = len(ranked)
        most = effort // (len(self.lengths) * (POPULATION - 1) + 1)
        for _ in range(min(max(GENERATIONS, most), MOST_GENERATIONS)):
            if ranked[0][0] == self.ideal:
                break
            for _ in range(POPULATION - 1):
                a, b = self.rng.choice(len(ranked), 2, replace=False)
                child = self.cross(ranked[a][2], ranked[b][2])
                ranked.append((self.fitness(child), serial, child))
                serial += 1
            # equals are one individual, the younger one, so that the population does not stand still
            ranked = sorted({x[0]: x for x in ranked}.values(), key=lambda x: x[:2])[:POPULATION]
            while len(ranked) < 2:
                g = self.fresh(np.inf)
                ranked.append((self.fitness(g), serial, g))
                serial += 1
        return min(ranked, key=lambda x: x[:2])[2]


ELITE = "shard long, island int, n_bins long, square double, seed_bins long, crossings long, bins binary"


def dealt_pieces(rows: DataFrame, seed: int) -> DataFrame:
    """Stored pieces (row, length, ...) dealt at random into shards of some ``SHARD_PIECES``."""
    shards = max(1, -(-rows.count() // SHARD_PIECES))
    return rows.select("row", "length", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(shards)).alias("shard"))


def evolved(dealt: DataFrame, length: int = LENGTH, seed: int = 5) -> DataFrame:
    """The elite of each island of each shard after all epochs: n_bins and square of the fills,
    beside seed_bins (bins of plain best fit by decreasing length) and crossings (crossovers the
    island ran, both over all epochs)."""
    islands = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))

    def evolve(key, own: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("row")
        island = Island(own["length"].to_numpy(), length, hash((int(key[0]), int(key[1]), seed, len(elites))) & 0xFFFFFFFF)
        best = island.evolve([np.frombuffer(b, dtype=np.int32).astype(np.int64) for b in elites["bins"]])
        n, square = island.fitness(best)
        at_home = elites[elites["home"]]
        seed_bins = int(at_home["seed_bins"].iloc[0]) if len(at_home) else island.fitness(island.fresh(0.0))[0]
        return pd.DataFrame([{"shard": int(key[0]), "island": int(key[1]), "n_bins": n, "square": -square,
                              "seed_bins": seed_bins, "crossings": island.crossings + int(at_home["crossings"].sum()),
                              "bins": best.astype(np.int32).tobytes()}])

    elites = dealt.sparkSession.createDataFrame([], ELITE)
    for epoch in range(EPOCHS):
        # the elite of each island visits the next one, and stays at home
        away = elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int"))
        guests = elites.withColumn("home", F.lit(True)).unionByName(away.withColumn("home", F.lit(False)))
        elites = saved(islands.groupBy("shard", "island").cogroup(guests.groupBy("shard", "island"))
                       .applyInPandas(evolve, ELITE), "elites")
    return elites


def pack(rows: DataFrame, length: int = LENGTH, seed: int = 5) -> DataFrame:
    """Add shard, bin and fill to stored pieces (row, length, ...): every shard on its islands."""
    dealt = dealt_pieces(rows, seed)
    elites = evolved(dealt, length, seed)
    best = elites.groupBy("shard").agg(F.min_by("bins", F.struct("n_bins", -F.col("square"), "island")).alias("bins"))

    def lay(key, own: pd.DataFrame, elite: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("row")
        bins = np.frombuffer(elite["bins"].iloc[0], dtype=np.int32).astype(np.int64)
        sizes = own["length"].to_numpy()
        order = np.lexsort((own["row"].to_numpy(), -sizes, bins))
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, np.diff(bins[order]) != 0]
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        return pd.DataFrame({"row": own["row"].to_numpy()[order], "shard": int(key[0]), "bin": bins[order],
                             "offset": offset, "fill": fill[bins[order]]})

    placed = dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(
        lay, "row long, shard long, bin long, offset long, fill long")
    return saved(placed, "packed")


def packed_documents(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = pieces(docs, length=length, **how)
    first = pack(rows, length)
    good = F.col("fill") >= GOOD_FILL * length
    poor = saved(rows.join(first.where(~good).select("row"), "row", "left_semi"), "poor")
    second = pack(poor, length, seed=6)

    def sequence(placed: DataFrame, level: int) -> DataFrame:
        return placed.select("row", (F.lit(level << 60) + F.shiftleft("shard", 24) + F.col("bin")).alias("sequence_id"),
                             "offset")

    where = sequence(first.where(good), 0).unionByName(sequence(second, 1))
    return rows.join(where, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
