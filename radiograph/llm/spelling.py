"""Grouping of spelling variants by asymmetric q-chunks.

Two words are near if one edit (an inserted, deleted or replaced code point) makes one the other. The longer of the two
(either, if as long) contributes two disjoint chunks, its first half and the rest; the other contributes its positional
grams. One edit leaves one chunk whole, which then stands in the other word at its own place or one place before, so
words are joined on (length, chunk, text) and verified. Of all grams only those at such places can join, and only they
are made: two for each of the two lengths that the longer word may have.

A chunk that very many words share is not joined at once: the words' remainders, which then have to be one edit apart
themselves, are chunked again under that chunk, until no more than `PAIRS` pairs of a bucket are left to verify or the
remainder is one code point. So no bucket is tried pair by pair, and no pair is lost.

Words are runs of letters `[A-Za-z\\u00C0-\\u00FF]` of whole texts, A-Z lower-cased. Where 199 divides the crc32 of
`<doc_id>:<word>`, the word loses a code point, as if it had been mistyped. A null text has no words, a null doc_id counts
as empty; repeated rows count each; extra columns are ignored; an empty table gives no words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, small_batches, written

LEAST_LENGTH, LEAST_COUNT, TIMES, TYPO = 6, 5, 5, 199
#: Pairs of one bucket up to which it is verified pair by pair.
PAIRS = 4096
#: Bytes of one text that are split at once, and words that a task holds before it hands their counts on.
PIECE, HELD = 1 << 20, 200_000

_IS_LETTER = [chr(b).isalpha() and b < 128 or b >= 0xC0 for b in range(256)]
#: Bytes of Latin-1 text: A-Z lower-cased, all that are no letters a blank.
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if _IS_LETTER[b] else 32 for b in range(256))


def _runs(text: str) -> Counter[bytes]:
    """How often each word stands in a text; letters are one byte each, whatever else a text holds is a blank."""
    found: Counter[bytes] = Counter()
    rest = b""
    for at in range(0, len(text), PIECE):
        piece = rest + text[at : at + PIECE].encode("latin-1", "replace").translate(_LETTERS)
        cut = piece.rfind(b" ") + 1 if at + PIECE < len(text) else len(piece)
        found.update(piece[:cut].split(b" "))
        rest = piece[cut:]
    del found[b""]
    return found


def mistyped(word: bytes, prefix: int) -> bytes:
    """The word as a document has it; prefix is the crc32 of the document's id and a colon."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
    if h % TYPO:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n): words of LEAST_LENGTH code points or more that occur LEAST_COUNT times or more in all texts."""
    small_batches(documents.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in _runs(text.as_py() or "").items():
                    if len(word) >= LEAST_LENGTH and len(word := mistyped(word, prefix)) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) >= HELD:
                    yield told(held)
                    held.clear()
        yield told(held)

    def told(held: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _chunks(rest: Column) -> Column:
    """The two disjoint chunks of the longer word's remainder: (which, chunk, what is left)."""
    n = F.length(rest)
    half = F.floor(n / 2).cast("int")
    first, second = F.substring(rest, F.lit(1), half), F.substring(rest, half + 1, n)
    return F.array(_entry(n, 0, first, second), _entry(n, 1, second, first))


def _grams(rest: Column) -> Column:
    """The grams that can be such a chunk, if the longer word's remainder is as long or one longer."""
    n = F.length(rest)
    out = []
    for longer in (0, 1):
        half = F.floor((n + longer) / 2).cast("int")
        out.append(_entry(n + longer, 0, F.substring(rest, F.lit(1), half), F.substring(rest, half + 1, n)))
        out.append(_entry(n + longer, 1, F.substring(rest, half + 1 - longer, n), F.substring(rest, F.lit(1), half - longer)))
    return F.array(*out)


def _entry(length: Column, which: int, chunk: Column, rest: Column) -> Column:
    return F.struct(F.concat_ws("|", length.cast("string"), F.lit(str(which)), chunk).alias("key"), rest.alias("rest"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other): every ordered pair of words(word) that are one edit apart."""
    words = words.select("word", F.lit("").alias("under"), F.col("word").alias("rest"))
    chunks, grams, out = words, words, None
    while True:
        chunks, grams = (
            rows.select("word", "under", F.explode(entries(F.col("rest"))).alias("e")).select("word", F.concat_ws("/", "under", "e.key").alias("under"), "e.rest")
            for rows, entries in ((chunks, _chunks), (grams, _grams))
        )
        chunks, grams = written(chunks, "chunks"), written(grams, "grams")
        sizes = chunks.groupBy("under").agg(F.count("*").alias("a")).join(grams.groupBy("under").agg(F.count("*").alias("b")), "under")
        crowded = bounded(written(sizes.where((F.col("a") * F.col("b") > PAIRS)).select("under"), "crowded"))
        last = crowded.limit(1).count() == 0
        parts = [(chunks, grams)] if last else [(chunks.join(crowded, "under", "left_anti"), grams.join(crowded, "under", "left_anti"))]
        if not last:
            chunks, grams = chunks.join(crowded, "under", "left_semi"), grams.join(crowded, "under", "left_semi")
            # Remainders of one code point can't be chunked; words that share all else are near, so these are no more than there are results.
            parts.append((chunks.where("length(rest) < 2"), grams.where("length(rest) < 2")))
            chunks, grams = chunks.where("length(rest) >= 2"), grams.where("length(rest) >= 1")
        for a, b in parts:
            pairs = a.select("under", F.col("word").alias("x")).join(b.select("under", F.col("word").alias("y")), "under")
            longer = (F.length("x") > F.length("y")) | (F.col("x") < F.col("y"))
            found = pairs.where(longer & (F.levenshtein("x", "y") == 1)).select("x", "y")
            out = found if out is None else out.unionByName(found)
        if last:
            break
    once = written(out.distinct(), "near")
    return once.select(F.col("x").alias("word"), F.col("y").alias("other")).union(once.select("y", "x"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms(word, form) followed to the last; a form is more frequent than its word, so there are no circles."""
    held = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = bounded(held.select(F.col("word").alias("root"), F.col("root").alias("next")))
        moved = written(held.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        held = moved.select("word", "root")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of documents(doc_id, text): the near word of largest n, if that is TIMES the word's or more."""
    words = written(word_counts(documents), "words")
    named = words.select(F.col("word").alias("other"), F.col("n").alias("m"))
    near = near_pairs(words).join(named, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("d"), "other")).alias("b"))
    rows = words.join(near, "word", "left")
    strong = -F.col("b.d") >= F.col("n") * TIMES
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("b.other")).alias("form"), F.when(strong, -F.col("b.d")).alias("form_n")), "formed")
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_CRC_BIT = "xor(b >> 1, (b & 1) * 3988292384)"
_CRC = "list_reduce(list_prepend({0}, {1}), lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda b, i: " + _CRC_BIT + "))"
_UTF8 = "flatten(list_transform(string_split({0}, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))"
#: DuckDB compares bytes: there, each letter beyond ASCII stands for itself as a character of its own among those that no word has.
_WIDE, _NARROW = "".join(map(chr, range(0xC0, 0x100))), "".join(c for c in map(chr, range(33, 127)) if not "a" <= c <= "z")[:64]
SPELLING_SQL = f"""
with recursive docs as (
  select doc_id, {_CRC.format("4294967295::bigint", _UTF8.format("coalesce(doc_id::varchar, '') || ':'"))} as state,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+') as runs from documents where text is not null
), runs as (select doc_id, state, r, count(*) as k from (select doc_id, state, unnest(runs) as r from docs) where length(r) >= {LEAST_LENGTH} group by all),
hashed as (select r, k, xor({_CRC.format("state", _UTF8.format("r"))}, 4294967295) as h from runs),
words as (
  select word, sum(k)::bigint as n from (select case when h % {TYPO} = 0 then r[:h % length(r)] || r[h % length(r) + 2:] else r end as word, k from hashed)
  where length(word) >= {LEAST_LENGTH} group by word having sum(k) >= {LEAST_COUNT}
), narrow as (select *, translate(word, '{_WIDE}', '{_NARROW.replace("'", "''")}') as w from words),
near as (
  select x.word, x.n, y.word as other, y.n as m from (select *, length(word) as l from narrow) x join (select *, unnest([length(word) - 1, length(word), length(word) + 1]) as l from narrow) y using (l) where levenshtein(x.w, y.w) = 1
), best as (select word, count(*) as n_near, first(other order by m desc, other) as other, max(m) as m from near group by word),
formed as (select word, n, coalesce(n_near, 0) as n_near, case when m >= {TIMES} * n then other end as form, case when m >= {TIMES} * n then m end as form_n from words left join best using (word)),
walk as (select word, word as root, form as next from formed union all select w.word, f.word, f.form from walk w join formed f on f.word = w.next)
select word, form, (select root from walk w where w.word = formed.word and next is null) as root, n, n_near, form_n from formed
"""
