"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over eight words: some positions count, the others may differ. The masked words at every place of
every document and benchmark item are hashed and joined; a hit fixes the item's place in the document. There the two are
compared word by word, and the document counts as contaminated where some stretch of 13 words (the whole item, if
shorter) has at most two that differ. Whichever two of ten words differ, one of the masks misses both at one of its
three places, so seeds lose no such stretch of ten words or more. Where text and item overlap by less than 13 words at
an end of the document, ten words have to overlap. An item of fewer than ten words is its own seed: all of it has to
stand in the document. Only DataFrame functions are used.

Words are as in the license scan: case, punctuation and white space don't matter. Null and empty texts match nothing.
Rows without an id match under a null id. Rows that repeat an id are one document or item with several texts: each text
meets only its own hits, as a row is known by its id and the hash of its text, so many rows of one id make no square.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, written
from .licenses import words

SPAN = 8
#: Positions that count, by mask: of all triples over eight words with five that count, 22 lose nothing; this is one.
MASKS = ((0, 1, 2, 3, 7), (0, 2, 4, 5, 7), (0, 3, 4, 6, 7))
STRETCH, MOST_DIFFERENT = 13, 2
#: Words that are compared at least; shorter items have to stand as a whole.
LEAST = 10
#: Seeds or hits up to which one side is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def seeds(rows: DataFrame, *key: str) -> DataFrame:
    """(key, at, seed): the hashed masked words at each place; rows has the key's columns and w, its words."""
    enough = rows.where(F.size("w") >= SPAN)
    shifted = [F.slice("w", F.lit(k + 1), F.size("w") - (SPAN - 1)).alias(f"t{k}") for k in range(SPAN)]
    windows = enough.select(*key, F.posexplode(F.arrays_zip(*shifted)).alias("at", "x"))
    hashed = F.array(*[F.xxhash64(F.lit(m), *[F.col(f"x.t{k}") for k in mask]) for m, mask in enumerate(MASKS)])
    return windows.select(*key, "at", F.explode(hashed).alias("seed"))


def whole_places(documents: DataFrame, short: DataFrame) -> DataFrame | None:
    """(doc_id, item_id, shift, first, n_same, n_compared) where an item of fewer than LEAST words stands as a whole.

    None if there are no such items; documents has doc_id and w, short has item_id and w.
    """
    lengths = sorted(r["n"] for r in short.select(F.size("w").alias("n")).distinct().collect())
    if not lengths:
        return None

    def phrases(n: int):
        places = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
        return F.when(F.size("w") >= n, F.transform(places, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i + 1, n), " ").alias("phrase"))))

    places = documents.select("doc_id", F.explode(F.flatten(F.array_compact(F.array(*map(phrases, lengths))))).alias("x")).select("doc_id", "x.at", "x.phrase")
    wanted = bounded(short.select("item_id", F.array_join("w", " ").alias("phrase"), F.size("w").alias("n")), BROADCAST_ROWS)
    return places.join(wanted, "phrase").select("doc_id", "item_id", F.col("at").alias("shift"), F.lit(0).alias("first"), F.col("n").alias("n_same"), F.col("n").alias("n_compared"))


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_places, doc_word, n_same, n_compared for each document and item that share a passage.

    n_places counts the item's places in the document; doc_word, n_same and n_compared belong to the best of them: the
    word of the document where the comparison begins, the words that are the same, and the words compared.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("of", F.xxhash64("text"))
    items = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id()), "items")
    wanted = bounded(written(seeds(items.where(F.size("w") >= LEAST), "row").distinct().withColumnRenamed("at", "item_at"), "seeds"), BROADCAST_ROWS)
    named = docs.select("doc_id", "of", words(F.col("text")).alias("w"))
    hits = seeds(named, "doc_id", "of").join(wanted, "seed").select("doc_id", "of", "row", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = written(hits, "hits")
    hit_docs = bounded(hits.select(F.col("doc_id").alias("id"), "of").distinct(), BROADCAST_ROWS)
    same_row = [F.col("doc_id").eqNullSafe(F.col("id")), F.col("text_of") == F.col("of")]
    texts = docs.withColumnRenamed("of", "text_of").join(hit_docs, same_row, "left_semi").select(F.col("doc_id").alias("id"), "text_of", words(F.col("text")).alias("w"))
    pairs = hits.join(texts, same_row).join(items.select("row", "item_id", F.col("w").alias("v")), "row")
    first, last = F.greatest(-F.col("shift"), F.lit(0)), F.least(F.size("v"), F.size("w") - F.col("shift"))
    pairs = pairs.withColumn("first", first).withColumn("last", last).where(F.col("last") - F.col("first") >= LEAST)
    pairs = pairs.withColumn("same", F.zip_with(F.slice("v", F.col("first") + 1, F.col("last") - F.col("first")), F.slice("w", F.col("first") + F.col("shift") + 1, F.col("last") - F.col("first")), lambda a, b: (a == b).cast("int")))
    n, length = F.size("same"), F.least(F.size("same"), F.lit(STRETCH))
    stretch = F.exists(F.sequence(F.lit(1), n - length + 1), lambda i: F.aggregate(F.slice("same", i, length), F.lit(0), lambda s, x: s + x) >= length - MOST_DIFFERENT)
    checked = pairs.where(stretch).select("doc_id", "item_id", "shift", "first", F.aggregate("same", F.lit(0), lambda s, x: s + x).alias("n_same"), n.alias("n_compared"))
    whole = whole_places(named, items.where(F.size("w").between(1, LEAST - 1)))
    checked = checked if whole is None else checked.unionByName(whole)
    best = F.max_by(F.struct((F.col("first") + F.col("shift")).alias("at"), "n_same", "n_compared"), F.struct("n_same", -F.col("shift")))
    out = checked.groupBy("doc_id", "item_id").agg(F.count_distinct("shift").alias("n_places"), best.alias("b"))
    return out.select("doc_id", "item_id", "n_places", F.col("b.at").cast("long").alias("doc_word"), F.col("b.n_same").cast("long").alias("n_same"), F.col("b.n_compared").cast("long").alias("n_compared"))


_WORDS_SQL = "list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
#: The contract without masks: of ten words of which two differ three neighbours are the same, so places where three words agree are tried, and whole items of fewer than ten words.
CONTAMINATED_SQL = f"""
with tokens as (select row_number() over () as r, doc_id, {_WORDS_SQL.format("text")} as w from documents),
items as (select row_number() over () as q, item_id, {_WORDS_SQL.format("text")} as v from benchmark),
a as (select r, unnest(range(0, len(w) - 2)) as i, w from tokens where len(w) >= {LEAST}),
b as (select q, unnest(range(0, len(v) - 2)) as j, v from items where len(v) >= {LEAST}),
hits as (select distinct r, q, i - j as shift from (select r, i, w[i + 1:i + 3] as k from a) join (select q, j, v[j + 1:j + 3] as k from b) using (k)),
pairs as (
  select r, q, shift, greatest(-shift, 0) as f, v[greatest(-shift, 0) + 1:least(len(v), len(w) - shift)] as x, w[greatest(shift, 0) + 1:least(len(v), len(w) - shift) + shift] as y
  from hits join tokens using (r) join items using (q) where least(len(v), len(w) - shift) - greatest(-shift, 0) >= {LEAST}
), compared as (select r, q, shift, f, list_transform(range(1, len(x) + 1), lambda k: (x[k] = y[k])::int) as same from pairs),
checked as (
  select r, q, shift, f + shift as begin_at, list_sum(same) as n_same, len(same) as n_compared from compared
  where len(list_filter(range(1, len(same) - least(len(same), {STRETCH}) + 2), lambda i: list_sum(same[i:i + least(len(same), {STRETCH}) - 1]) >= least(len(same), {STRETCH}) - {MOST_DIFFERENT})) > 0
), short as (select q, v, len(v) as n from items where len(v) between 1 and {LEAST - 1}),
stretches as (select r, n, unnest(range(0, len(w) - n + 1)) as i, w from tokens, (select distinct n from short) where len(w) >= n),
whole as (select r, q, i as shift, i as begin_at, s.n as n_same, s.n as n_compared from stretches t join short s on s.n = t.n and w[i + 1:i + s.n] = v),
found as (select doc_id, item_id, c.* from (from checked union all from whole) c join tokens using (r) join items using (q))
select doc_id, item_id, count(distinct shift)::bigint as n_places, arg_max(begin_at, n_same * 1000000000 - shift)::bigint as doc_word,
  max(n_same)::bigint as n_same, arg_max(n_compared, n_same * 1000000000 - shift)::bigint as n_compared
from found group by doc_id, item_id
"""
