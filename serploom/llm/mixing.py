"""Mixing sources to target weights by cube-method balanced sampling.

Sources in code-point order (null last) weigh ``WEIGHTS`` in turn and share ``SHARE`` times all sizes; a
target stops at ``MOST`` times its source's size and the excess is shared again by weight. A source takes
each document floor(target / size) times for certain and once more with the fraction that is left, chosen by
the cube method: within blocks of documents, three fractional documents at a time move along the null space
of the two constraints (number of documents, total size) until one of them is settled, so both totals are
kept exactly. At most two documents of a block stay fractional; they meet in the blocks of the next level,
and the last one to three of a source are landed on the choice that is nearest to the target.

Blocks are dealt by a hash of the document, so a source of any size is split over many tasks. All chance
comes from a seed and the documents, so reruns agree.

Defined results: a null or empty text has size 0 and is taken as any other (0 words); a null source is a
source of its own; repeated rows are documents of their own; a source of size 0 has target 0; extra columns
stay untouched; without any word all targets are 0.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serploom.llm.common import TOKEN_PATTERN, fresh, landed

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 4096
#: fractional documents of a block that go to the next level, at most
LEFT = 2
#: sources that may be broadcast (about 100 bytes each); more are joined by a shuffle
BROADCAST_SOURCES = 50_000
SEED = 20


def size_of(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_PATTERN)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds weight and target to rows (source, n_docs, source_size), one per source."""
    # ranks: ranges of sources are counted apart, so no task sees all of them
    ranged = landed(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranges")
    before, offsets = 0, []
    for row in ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").toLocalIterator():
        offsets.append((row.part, before))
        before += row.n
    if not offsets:
        return ranged.select("source", "n_docs", "source_size", F.lit(0).alias("weight"), F.lit(0.0).alias("target"))
    starts = sources.sparkSession.createDataFrame(offsets, "part int, start bigint")
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*map(F.lit, WEIGHTS))
    ranked = ranged.withColumn("at", own).join(F.broadcast(starts), "part").withColumn(
        "weight", F.element_at(turn, ((F.col("start") + F.col("at")) % len(WEIGHTS) + 1).cast("int"))
    )
    ranked = landed(ranked.select("source", "n_docs", "source_size", "weight"), "mix-sources")
    # level l: sources above their stop are set to it, the others share the rest by weight
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        stop = F.col("source_size") * MOST
        above = F.col("weight") * F.lit(level) > stop
        row = ranked.agg(
            F.sum(F.when(above, stop)).alias("set"), F.sum(F.when(~above, F.col("weight"))).alias("weights"),
            F.sum(above.cast("bigint")).alias("n"),
        ).first()
        if row.n == capped or not row.weights:
            break
        capped, level = row.n, (SHARE * total - (row.set or 0.0)) / row.weights
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("source_size") * MOST))


def _move(units: list[list[float]], rng: random.Random) -> None:
    """One step of the flight: three fractional units (p, size) along the null space of both totals."""
    (p1, s1), (p2, s2), (p3, s3) = units
    v = (s3 - s2, s1 - s3, s2 - s1)
    if not any(v):
        v = (1.0, -1.0, 0.0)
    up = min(((1 - p) / x if x > 0 else -p / x) for p, x in zip((p1, p2, p3), v, strict=True) if x)
    down = min((p / x if x > 0 else (p - 1) / x) for p, x in zip((p1, p2, p3), v, strict=True) if x)
    step = up if rng.random() * (up + down) < down else -down
    for u, x in zip(units, v, strict=True):
        if x:
            u[0] += step * x
            u[0] = 0.0 if u[0] < 1e-9 else 1.0 if u[0] > 1 - 1e-9 else u[0]


def flight(chances: list[float], sizes: list[float], seed: int, land: bool = False) -> list[float]:
    """Chances after the flight: 0 or 1 but for two at most; none stays with ``land``."""
    rng = random.Random(seed)
    units = [[p, s] for p, s in zip(chances, sizes, strict=True)]
    open_units: list[list[float]] = []
    for u in units:
        if 0.0 < u[0] < 1.0:
            open_units.append(u)
            while len(open_units) == 3:
                _move(open_units, rng)
                open_units = [x for x in open_units if 0.0 < x[0] < 1.0]
    if land and open_units:
        want = sum(p * s for p, s in open_units)
        count = sum(p for p, _ in open_units)
        choices = [[(c >> i) & 1 for i in range(len(open_units))] for c in range(1 << len(open_units))]
        best = min(choices, key=lambda c: (abs(sum(x * u[1] for x, u in zip(c, open_units, strict=True)) - want), abs(sum(c) - count)))
        for u, x in zip(open_units, best, strict=True):
            u[0] = float(x)
    return [u[0] for u in units]


#: what a document carries through the levels
CARRIED = ["id", "source", "row", "size", "source_size", "target"]


def _fly(table: DataFrame, land: bool) -> DataFrame:
    """One level of the flight, block by block; in a block documents come in the order of row and size."""

    def block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("row", "ascending"), ("size", "ascending")])
        seed = SEED * 1_000_003 + rows["block"][0].as_py() * 8191 + rows["row"][0].as_py()
        chance = flight(rows["chance"].to_pylist(), rows["size"].to_pylist(), seed, land)
        return rows.set_column(rows.schema.get_field_index("chance"), "chance", pa.array(chance, pa.float64()))

    return table.groupBy("source", "block").applyInArrow(block, table.schema)


def sampled(sizes: DataFrame) -> DataFrame:
    """Rows of CARRIED, ``rate`` and ``n_docs`` of the source; gives CARRIED and ``times``, how often each is taken."""
    table = sizes.withColumn("times", F.floor("rate")).withColumn("chance", F.col("rate") - F.floor("rate"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK))
    fractional = table.filter("chance > 0")
    level = fractional.agg(F.max("n_docs")).first()[0] or 0
    rows = fractional.withColumn("block", F.pmod(F.xxhash64("row", "size", F.lit(SEED)), blocks)).select(*CARRIED, "times", "chance", "block")
    out = [table.filter("chance = 0").select(*CARRIED, F.col("times").cast("bigint"))]
    while level:
        last = level <= BLOCK
        if last:
            flown = done = _fly(rows.withColumn("block", F.lit(0).cast("bigint")), land=True)
        else:
            flown = landed(_fly(rows, land=False), "mix-flight")
            done = flown.filter("chance = 0 or chance = 1")
            # so many blocks meet in one that their rest fills it
            rows = flown.filter("chance > 0 and chance < 1").withColumn("block", F.floor(F.col("block") * LEFT / BLOCK).cast("bigint"))
        out.append(done.select(*CARRIED, (F.col("times") + F.round("chance")).cast("bigint").alias("times")))
        level = 0 if last else -(-level // BLOCK) * LEFT
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: CARRIED, times and taken (size times times)."""
    sizes = landed(
        docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.xxhash64(F.col(id), F.col(text)).alias("row"), size_of(F.col(text)).alias("size")),
        "mix-sizes",
    )
    stats = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    targets = landed(source_targets(stats), "mix-targets").withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    small = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    joined = sizes.join(small.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return sampled(joined).withColumn("taken", F.col("size") * F.col("times"))


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix with ``copies``, how often each is taken; those taken never are left out.

    Rows that repeat each other become one row with the copies of all of them.
    """
    copies, row, of_row, turn = fresh(docs, "copies", "row", "of_row", "turn")
    taken = mix(docs, id, text, source).filter("times > 0").groupBy(F.col("row").alias(of_row)).agg(F.sum("times").alias(copies))
    keyed = docs.withColumn(row, F.xxhash64(F.col(id), F.col(text)))
    joined = keyed.join(taken, F.col(row) == F.col(of_row))
    first = F.row_number().over(Window.partitionBy(row).orderBy(F.col(source)))
    return joined.withColumn(turn, first).filter(F.col(turn) == 1).drop(row, of_row, turn)
