"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

The genes of a solution are whole bins.  Crossover injects well-filled bins
of one parent into the other, drops the bins that now hold pieces twice, and
puts the pieces displaced by that where they fit best.  Pieces fall into shards
of bounded size; several islands evolve each shard as separate tasks, and their
elites migrate around a ring between epochs.  Afterwards the poorly filled bins
of neighbouring shards pool their pieces and evolve again, until one shard is
left, so no shard's rest is wasted.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import materialise, spread


@dataclass(frozen=True)
class Evolution:
    """Size of the search: pieces a shard, islands a shard, population, generations an epoch, epochs."""

    shard: int = 3000
    islands: int = 2
    population: int = 4
    generations: int = 6
    epochs: int = 2
    full: float = 0.995  # bins filled as far stay as they are


class Bins:
    """Bins of one solution, found by the room they have left."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.rooms: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit r: some bin has room r

    def put_bin(self, items: list[int], room: int) -> None:
        self.by_room[room].append(len(self.items))
        self.mask |= 1 << room
        self.items.append(items)
        self.rooms.append(room)

    def best_fit(self, item: int, length: int) -> None:
        """Put the piece where the least room is left, in a new bin if it fits nowhere."""
        above = self.mask >> length
        if not above:
            self.put_bin([item], self.capacity - length)
            return
        room = length + (above & -above).bit_length() - 1
        stack = self.by_room[room]
        b = stack.pop()
        if not stack:
            self.mask &= ~(1 << room)
        self.items[b].append(item)
        self.rooms[b] = room - length
        self.by_room[room - length].append(b)
        self.mask |= 1 << (room - length)


Solution = list[list[int]]


def fill(order: list[int], lengths: list[int], capacity: int, kept: Solution = ()) -> Solution:
    bins = Bins(capacity)
    for items in kept:
        bins.put_bin(items, capacity - sum(lengths[i] for i in items))
    for i in order:
        bins.best_fit(i, lengths[i])
    return bins.items


def fitness(solution: Solution, lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the mean square of what they hold."""
    squares = sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in solution)
    return -len(solution), squares / max(1, len(solution))


def crossover(a: Solution, b: Solution, lengths: list[int], capacity: int, rng: random.Random) -> Solution:
    """Some of the best-filled bins of ``a`` within ``b``."""
    ranked = sorted(a, key=lambda items: -sum(lengths[i] for i in items))
    well = ranked[: max(1, len(ranked) // 2)]
    injected = [list(x) for x in well if rng.random() < 0.5] or [list(well[0])]
    taken = {i for x in injected for i in x}
    kept, displaced = injected, []
    for items in b:
        if taken.isdisjoint(items):
            kept.append(list(items))
        else:
            displaced += [i for i in items if i not in taken]
    displaced.sort(key=lambda i: (-lengths[i], i))
    return fill(displaced, lengths, capacity, kept)


def mutate(solution: Solution, lengths: list[int], capacity: int, rng: random.Random) -> Solution:
    """Empty the worst-filled bins and a few others, and place their pieces anew."""
    ranked = sorted(solution, key=lambda items: sum(lengths[i] for i in items))
    n = max(1, len(ranked) // 20)
    chosen = ranked[:n] + rng.sample(ranked[n:], min(n, len(ranked) - n))
    loose = [i for b in chosen for i in b]
    gone = {id(b) for b in chosen}
    rng.shuffle(loose)
    loose.sort(key=lambda i: -lengths[i] * (0.8 + 0.4 * rng.random()))
    return fill(loose, lengths, capacity, [list(b) for b in solution if id(b) not in gone])


def evolve(lengths: list[int], capacity: int, elites: list[Solution], seed: int, how: Evolution) -> Solution:
    """The best solution of one island after one epoch."""
    rng = random.Random(seed)
    n = len(lengths)
    down = sorted(range(n), key=lambda i: (-lengths[i], i))
    least = -(-sum(lengths) // capacity)
    rated = [(fitness(s, lengths, capacity), s) for s in [*elites, fill(down, lengths, capacity)]]
    best = max(rated, key=lambda x: x[0])
    if len(best[1]) > least:
        while len(rated) < how.population:
            order = sorted(range(n), key=lambda i: -lengths[i] * (0.9 + 0.2 * rng.random()))
            s = fill(order, lengths, capacity)
            rated.append((fitness(s, lengths, capacity), s))
        for _ in range(how.generations):
            rated.sort(key=lambda x: x[0], reverse=True)
            a, b = rated[0][1], rated[rng.randrange(1, len(rated))][1]
            if rng.random() < 0.5:
                a, b = b, a
            child = mutate(crossover(a, b, lengths, capacity, rng), lengths, capacity, rng)
            score = fitness(child, lengths, capacity)
            if score > rated[-1][0]:
                rated[-1] = score, child
            if -max(rated, key=lambda x: x[0])[0][0] <= least:
                break
        best = max(rated, key=lambda x: x[0])
    return best[1]


def solutions(table: pa.Table, index: dict[int, int]) -> list[Solution]:
    """The elites in an island's rows."""
    out = []
    elite, bins, uid = (table[c].to_pylist() for c in ("elite", "bin", "uid"))
    found: dict[int, dict[int, list[int]]] = {}
    for e, b, u in zip(elite, bins, uid, strict=True):
        if e is not None:
            found.setdefault(e, {}).setdefault(b, []).append(index[u])
    for e in sorted(found):
        out.append([found[e][b] for b in sorted(found[e])])
    return out


def pack_shards(items: DataFrame, capacity: int, how: Evolution, level: int) -> DataFrame:
    """``shard, uid, length, bin, held`` of the best island of each shard; items: shard, uid, length."""
    islands = F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1)))
    state = items.select("shard", islands.alias("island"), "uid", "length", F.lit(None).cast("int").alias("elite"), F.lit(None).cast("int").alias("bin"))
    schema = "shard bigint, island int, uid bigint, length int, elite int, bin int, score_bins int, score_fill double"

    def epoch(key: tuple, table: pa.Table) -> pa.Table:
        shard, island = key[0].as_py(), key[1].as_py()
        first = dict(zip(table["uid"].to_pylist(), table["length"].to_pylist(), strict=True))
        uids = sorted(first)
        lengths = [first[u] for u in uids]
        index = {u: i for i, u in enumerate(uids)}
        seed = level << 40 ^ shard << 8 ^ island
        s = evolve(lengths, capacity, solutions(table, index), seed, how)
        n, score = fitness(s, lengths, capacity)
        where = [0] * len(uids)
        for b, held in enumerate(s):
            for i in held:
                where[i] = b
        size = len(uids)
        columns = [[shard] * size, [island] * size, uids, lengths, [island] * size, where, [-n] * size, [score] * size]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split(" ")[0] for f in schema.split(", ")])

    for number in range(how.epochs):
        out = state.groupBy("shard", "island").applyInArrow(epoch, schema)
        if number + 1 < how.epochs:
            # every elite stays and goes on to the next island of the ring
            to = F.explode(F.array_distinct(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(how.islands)))))
            state = out.select("shard", to.alias("island"), "uid", "length", "elite", "bin")
    out = materialise(out, "islands")
    best = out.groupBy("shard").agg(F.min_by("island", F.struct("score_bins", -F.col("score_fill"), "island")).alias("island"))
    chosen = out.join(best, ["shard", "island"])
    sums = chosen.groupBy("shard", "bin").agg(F.sum("length").alias("held"))
    return chosen.join(sums, ["shard", "bin"]).select("shard", "uid", "length", "bin", "held")


def pack(items: DataFrame, capacity: int, how: Evolution = Evolution()) -> DataFrame:
    """Assign pieces to sequences: columns ``uid``, ``sequence_id``, ``offset``.

    ``items`` has distinct ``uid`` and ``length`` from 1 to ``capacity``.  Sequence ids are arbitrary;
    pieces lie in a sequence from 0 without gaps.  No items give no rows.
    """
    total = items.count()
    shards = max(1, -(-total // how.shard))
    rest = items.select(F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"), "uid", F.col("length").cast("int").alias("length"))
    done: DataFrame | None = None
    level = 0
    while True:
        packed = materialise(pack_shards(rest, capacity, how, level), "packed")
        last = shards == 1
        sealed = packed if last else packed.where(F.col("held") >= int(how.full * capacity))
        number = (F.lit(level).cast("bigint") * (1 << 56)) + F.col("shard") * (1 << 20) + F.col("bin")
        part = sealed.select("uid", "length", number.alias("sequence_id"))
        done = part if done is None else done.unionByName(part)
        if last:
            break
        # pool so many shards that their rests make about one shard again
        rest = packed.where(F.col("held") < int(how.full * capacity)).select("shard", "uid", "length")
        left = rest.count()
        shards = max(1, min(-(-shards // 2), -(-left // how.shard)))
        rest = rest.select(F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"), "uid", "length")
        level += 1
    # a sequence holds at most `capacity` pieces
    each = done.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("down"), "uid"))).alias("held"))
    each = each.select("sequence_id", F.explode(F.transform("held", lambda x, i: F.struct(x["uid"].alias("uid"), F.aggregate(F.slice("held", 1, i), F.lit(0), lambda s, y: s - y["down"]).alias("offset")))).alias("p"))
    return each.select("p.uid", "sequence_id", F.col("p.offset").cast("bigint").alias("offset"))


def pieces(df: DataFrame, path: str, capacity: int, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of all documents: ``doc_id, piece, start, length, ids_crc32``.

    A document's ids end with ``end_id``, so an empty or null text is one piece of length 1; only
    documents of more than ``capacity`` ids are cut.
    """

    def make(coder: bpe.Encoder, keys: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        counts = np.diff(at)
        whole = np.full(len(ids) + len(counts), end_id, "<u4")
        begins = at[:-1] + np.arange(len(counts))
        whole[spread(begins, counts)] = ids
        n = counts + 1
        cut = -(-n // capacity)
        owner = np.repeat(np.arange(len(n)), cut)
        piece = spread(np.zeros(len(n), np.int64), cut)
        start = piece * capacity
        length = np.minimum(capacity, n[owner] - start)
        lo = begins[owner] + start
        crc = [zlib.crc32(whole[i : i + k]) for i, k in zip(lo.tolist(), length.tolist(), strict=True)]
        columns = [keys.take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids_crc32"])

    kind = df.schema[key].dataType.simpleString()
    return bpe.per_text(df, key, text, "word_end", path, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", make)


def pack_documents(df: DataFrame, path: str, capacity: int = 4096, how: Evolution = Evolution(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack the token pieces of all documents into sequences of at most ``capacity`` ids.

    Columns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.  Full pieces are sequences
    of their own; the others are packed by :func:`pack`.  Documents that repeat an id, or have
    none, stay separate.  Null texts count as empty; other columns are ignored.
    """
    cut = materialise(pieces(df, path, capacity, key=key, text=text).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    part = cut.where(F.col("length") < capacity)
    packed = pack(part.select("uid", "length"), capacity, how)
    full = cut.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("bigint")})
    names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return part.join(packed, "uid").select(*names).unionByName(full.select(*names))
