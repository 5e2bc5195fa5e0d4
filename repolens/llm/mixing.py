"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

The documents of a source, in a pseudo-random order, are cut into blocks of equal row counts. With weights w
and their sum W, block k of a source (from 0) is released at slot floor(k W / w) and due at slot
ceil((k + 1) W / w); each slot goes to the released block that is due first. On one stream this keeps every
source within one block of its share at every slot.

The weights are integers, so the schedule repeats after W slots: one period is computed, in a single row, and
block k's slot follows by arithmetic, however many blocks there are. When a source has no blocks left a new
phase begins, in which the others share by their weights; there are at most as many phases as sources. Every
row of the input is in the result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart

BLOCK_ROWS = 16
BUCKET_ROWS = 4000

# The plan of all phases from arrays w (weights) and n (blocks), as one expression. Slots of a period are
# dealt by the inner aggregate, phases by the outer one; transform(array(x), x -> ...)[0] names a value.
_PLAN = """
aggregate(
  sequence(1, size(w)),
  named_struct('issued', transform(w, x -> 0L), 'base', 0L, 'phases',
    cast(array() AS array<struct<base: bigint, period: bigint, start: array<bigint>, issues: array<bigint>, pattern: array<int>>>)),
  (state, phase) -> transform(array(transform(w, (x, i) -> if(state.issued[i] < n[i], x, 0L))), share ->
    transform(array(aggregate(share, 0L, (a, x) -> a + x)), period ->
      if(period = 0, state,
        transform(array(
          aggregate(
            sequence(0L, period - 1),
            named_struct('k', transform(w, x -> 0L), 'pattern', cast(array() AS array<int>)),
            (deal, slot) -> transform(
              array(array_min(transform(
                filter(sequence(0, size(w) - 1), s -> share[s] > 0 AND (deal.k[s] * period) div share[s] <= slot),
                s -> named_struct('due', ((deal.k[s] + 1) * period + share[s] - 1) div share[s], 's', s)
              )).s),
              pick -> named_struct('k', transform(deal.k, (x, i) -> if(i = pick, x + 1, x)), 'pattern', array_append(deal.pattern, pick))
            )[0]
          ).pattern
        ), pattern -> transform(array(
          array_min(transform(
            filter(sequence(0, size(w) - 1), s -> share[s] > 0),
            s -> ((n[s] - state.issued[s] - 1) div share[s]) * period
              + element_at(filter(sequence(0, cast(period AS int) - 1), t -> pattern[t] = s), cast((n[s] - state.issued[s] - 1) % share[s] AS int) + 1)
          )) + 1
        ), slots -> transform(array(
          transform(share, (x, s) -> (slots div period) * x + size(filter(slice(pattern, 1, cast(slots % period AS int)), p -> p = s)))
        ), issues -> named_struct(
          'issued', zip_with(state.issued, issues, (a, b) -> a + b),
          'base', state.base + slots,
          'phases', array_append(state.phases, named_struct('base', state.base, 'period', period, 'start', state.issued, 'issues', issues, 'pattern', pattern))
        ))[0])[0])[0]
      )
    )[0])[0]
).phases
"""


def schedule(blocks: DataFrame) -> DataFrame:
    """(s, phases) from rows (s, w, n): a source's number from 0 on, its integer weight and its blocks.

    phases: for each phase in which the source has blocks, its first block, how many it issues, the slot where
    the phase begins, the period, and the source's slots in a period.
    """
    one = blocks.groupBy().agg(F.sort_array(F.collect_list(F.struct("s", F.col("w").cast("bigint").alias("w"), F.col("n").cast("bigint").alias("n")))).alias("all"))
    plan = one.select(F.col("all.w").alias("w"), F.col("all.n").alias("n")).select("w", F.expr(_PLAN).alias("phases"))
    mine = """
      transform(filter(phases, p -> p.issues[s] > 0), p -> named_struct(
        'phase', array_position(phases, p), 'first', p.start[s], 'issues', p.issues[s], 'base', p.base, 'period', p.period,
        'slots', filter(sequence(0, cast(p.period AS int) - 1), t -> p.pattern[t] = s)))
    """
    return plan.select("phases", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("s")).select("s", F.expr(mine).alias("phases"))


def mix(docs: DataFrame, weights: dict[str, int], other: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs in mixed order with columns phase, block, slot and position; every row is there once.

    docs needs doc_id, text and source; its own columns called like the new ones are replaced. weights:
    positive integers by source; null and unlisted sources share one queue of weight ``other``. The order
    within a source is that of md5 of id and text, so it does not depend on the input's; rows with equal
    source, id and text are interchangeable. position: slot * block_rows + place in the block, ascending in
    the result; a source's last block may be short, which leaves gaps.
    """
    if other < 1 or any(int(w) != w or w < 1 for w in weights.values()):
        raise ValueError("weights are positive integers")
    divisor = math.gcd(other, *map(int, weights.values()))
    names = sorted(weights)
    number = F.coalesce(F.create_map(*(F.lit(x) for i, name in enumerate(names) for x in (name, i)))[F.col("source")], F.lit(len(names))) if names else F.lit(0)
    narrow, back = apart(docs.drop("phase", "block", "slot", "position"), "doc_id", "text", "source")
    keyed = narrow.withColumns(
        {"__s": number, "__h": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))}
    )
    many = max(1, -(-docs.count() // BUCKET_ROWS))
    keyed = keyed.withColumn("__b", F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("bigint") * many / F.lit(1 << 32)))
    counts = keyed.groupBy("__s", "__b").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("__s").orderBy("__b")) - F.col("__n")).drop("__n")
    ranked = (
        keyed.withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h", "doc_id")) - 1)
        .join(before, ["__s", "__b"])
        .withColumn("__r", F.col("__r") + F.col("__before"))
        .withColumn("block", F.expr(f"__r div {block_rows}"))
    )
    weight = F.element_at(F.array(*(F.lit(int(weights[x]) // divisor) for x in names), F.lit(other // divisor)), F.col("__s") + 1)
    supply = counts.groupBy("__s").agg(F.sum("__n").alias("n")).select(F.col("__s").alias("s"), weight.alias("w"), F.expr(f"(n + {block_rows - 1}) div {block_rows}").alias("n"))
    numbered = _dense(supply)
    # one row for each entry of weights, and one for other sources
    plan = schedule(numbered.select(F.col("dense").alias("s"), "w", "n")).join(numbered.select(F.col("dense").alias("s"), F.col("s").alias("__s")), "s").select("__s", "phases")
    placed = ranked.join(F.broadcast(plan), "__s").withColumn("__p", F.expr("filter(phases, p -> p.first <= block AND block < p.first + p.issues)[0]"))
    slot = "__p.base + ((block - __p.first) div size(__p.slots)) * __p.period + __p.slots[cast((block - __p.first) % size(__p.slots) AS int)]"
    placed = placed.withColumn("slot", F.expr(slot)).withColumn("position", F.expr(f"slot * {block_rows} + __r % {block_rows}"))
    return back(placed.withColumn("phase", F.col("__p.phase").cast("bigint")), "phase", "block", "slot", "position").orderBy("position")


def _dense(supply: DataFrame) -> DataFrame:
    """supply with the number of each row by s, from 0; it has a row for each weight at most."""
    whole = supply.groupBy().agg(F.sort_array(F.collect_list(F.struct("s", "w", "n"))).alias("rows"))
    return whole.select(F.posexplode("rows").alias("dense", "r")).select("dense", "r.s", "r.w", "r.n")
