"""Chat formatting by perspective rotation: the whole dialogue once for each participant.

For each speaker of a conversation the dialogue is rendered with that speaker as the assistant and all others as named
users; spans mark what to learn: the content of the speaker's own turns. System turns are context in every rendering,
and no perspective of their own unless nobody else speaks.

A rendering is one row. Only that of a conversation of more than `PART_CHARACTERS` (each turn counts for its text and
`TURN_CHARACTERS` more) is dealt over several rows, which are its consecutive pieces: `start` is where a piece begins in
the rendering, and masks count from the rendering's beginning, so that the pieces put together are the whole dialogue.
Such a conversation is never gathered: its turns are sorted over all tasks, and sums over the tasks' shares give every
turn its place.

Turns are ordered by number (null first), then speaker, then text. A null role is the speaker `unknown`, a null text is
empty; rows with a null conv_id form one conversation. Repeated rows are repeated turns. Extra columns are ignored; an
empty table gives no rows. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, written

PART_CHARACTERS, TURN_CHARACTERS = 1 << 19, 32
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_ORDER = ("turn", "role", "text")


def _head(role: Column, own: Column) -> Column:
    return F.concat(F.lit(OPEN), F.when(own, F.lit("assistant")).when(role == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), role)), F.lit("\n"))


def _rendered(parts: DataFrame) -> DataFrame:
    """The output of parts(conv_id, participant, part, start, turns)."""
    own = lambda t: t["role"] == F.col("participant")
    shown = parts.withColumn("shown", F.transform("turns", lambda t: F.struct(_head(t["role"], own(t)).alias("head"), t["text"].alias("text"), own(t).alias("own"))))
    begin = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s, t):
        at = s["at"] + F.length(t["head"])
        end = at + F.length(t["text"])
        span = F.concat(at.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + len(CLOSE)).cast("long").alias("at"), F.when(t["own"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return shown.select(
        "conv_id", "participant", "part", "start", F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("shown", lambda t: t["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["text"], F.lit(CLOSE))), "").alias("text"),
        F.array_join(F.aggregate("shown", begin, step)["spans"], ",").alias("mask"),
    )


def _held(turns: DataFrame, *keys: str) -> DataFrame:
    return turns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*_ORDER))).alias("turns"))


def _short(turns: DataFrame) -> DataFrame:
    roles = F.array_sort(F.array_distinct(F.transform("turns", lambda t: t["role"])))
    others = F.filter("roles", lambda r: r != "system")
    held = _held(turns, "conv_id").withColumn("roles", roles)
    each = held.select("conv_id", "turns", F.explode(F.when(F.size(others) > 0, others).otherwise(F.col("roles"))).alias("participant"))
    zero = F.lit(0).cast("long")
    return each.select("conv_id", "participant", zero.alias("part"), zero.alias("start"), "turns")


def _long(turns: DataFrame, part_characters: int) -> DataFrame:
    """Parts of conversations too long to gather: places come from the sums of sorted ranges, then of parts."""
    turns = written(turns.withColumn("row", F.monotonically_increasing_id()), "turns")
    ranges = written(turns.repartitionByRange("conv_id", *_ORDER, "row").withColumn("range", F.spark_partition_id()), "ranges")
    size = (F.length("text") + TURN_CHARACTERS).cast("long")
    sums = ranges.groupBy("conv_id", "range").agg(F.sum(size).alias("size"))
    before = sums.select(F.col("conv_id").alias("of"), F.col("range").alias("in"), (F.sum("size").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("size")).alias("before"))
    inner = F.sum(size).over(Window.partitionBy("conv_id", "range").orderBy(*_ORDER, "row").rowsBetween(Window.unboundedPreceding, 0)) - size
    placed = ranges.withColumn("inner", inner).join(bounded(written(before, "before")), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    placed = written(placed.withColumn("part", F.expr(f"(before + inner) div {part_characters}")).select("conv_id", "part", *_ORDER), "placed")

    # Where a part begins: the heads and texts before it as everyone else sees them, and what the speaker's own heads differ by.
    spoken = placed.groupBy("conv_id", "part", "role").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("characters"))
    spoken = written(spoken.withColumn("length", F.col("characters") + F.col("n") * (F.length(_head(F.col("role"), F.lit(False))) + len(CLOSE))), "spoken")
    whole = spoken.groupBy("conv_id", "part").agg(F.sum("length").alias("length"))
    whole = whole.withColumn("others", F.sum("length").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("length"))
    speaks = spoken.groupBy("conv_id", "role").agg(F.sum("n").alias("n"))
    human = speaks.groupBy("conv_id").agg(F.max(F.col("role") != "system").alias("human"))
    speakers = speaks.select(F.col("conv_id").alias("c"), F.col("role").alias("participant")).join(human, F.col("c").eqNullSafe(F.col("conv_id"))).where("not human or participant <> 'system'")
    each = whole.join(written(speakers.select("c", "participant"), "speakers"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = spoken.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "role", F.col("n").alias("own"))
    each = each.join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("participant") == F.col("role")), "left")
    earlier = F.coalesce(F.sum("own").over(Window.partitionBy("conv_id", "participant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shorter = F.length(_head(F.col("participant"), F.lit(True))) - F.length(_head(F.col("participant"), F.lit(False)))
    starts = written(each.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "participant", (F.col("others") + earlier * shorter).cast("long").alias("start")), "starts")
    parts = written(_held(placed, "conv_id", "part"), "parts")
    return parts.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("conv_id", "participant", "part", "start", "turns")


def rotate(conversations: DataFrame, part_characters: int = PART_CHARACTERS) -> DataFrame:
    """conv_id, participant, part, start, n_turns, n_own, text, mask for each participant (and part) of conversations(conv_id, turn, role, text)."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    sizes = turns.groupBy("conv_id").agg(F.sum((F.length("text") + TURN_CHARACTERS).cast("long")).alias("size"))
    long = written(sizes.where(F.col("size") > part_characters).select(F.col("conv_id").alias("of")), "long")
    is_long = F.col("conv_id").eqNullSafe(F.col("of"))
    if long.isEmpty():
        return _rendered(_short(turns))
    parts = _short(turns.join(bounded(long), is_long, "left_anti"))
    return _rendered(parts.unionByName(_long(turns.join(bounded(long), is_long, "left_semi"), part_characters)))


ROTATE_SQL = """
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as body from conversations
), dealt as (
  select *, (coalesce(sum(length(body) + 32) over (partition by conv_id order by turn nulls first, role, body rows between unbounded preceding and 1 preceding), 0) // 524288)::bigint as part from t
), who as (
  select distinct conv_id, role as participant from t
), speaking as (
  select conv_id, participant from who w where participant <> 'system' or not exists (select 1 from who o where o.conv_id is not distinct from w.conv_id and o.participant <> 'system')
), shown as (
  select d.conv_id, participant, part, turn, role, body, role = participant as own,
    '<|im_start|>' || case when role = participant then 'assistant' when role = 'system' then 'system' else 'user name=' || role end || chr(10) as head
  from dealt d join speaking s on d.conv_id is not distinct from s.conv_id
), placed as (
  select *, coalesce(sum(length(head) + length(body) + 11) over (partition by conv_id, participant order by turn nulls first, role, body rows between unbounded preceding and 1 preceding), 0)::bigint as head_at from shown
)
select conv_id, participant, part, min(head_at)::bigint as start, count(*)::bigint as n_turns, count(*) filter (where own)::bigint as n_own,
  string_agg(head || body || '<|im_end|>' || chr(10), '' order by turn nulls first, role, body) as text,
  coalesce(string_agg((head_at + length(head)) || ':' || (head_at + length(head) + length(body)), ',' order by turn nulls first, role, body) filter (where own), '') as mask
from placed group by conv_id, participant, part
"""
