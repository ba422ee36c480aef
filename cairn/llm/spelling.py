"""Spelling variants: words that differ by one inserted, deleted or replaced character, found by permuterm rotations.

A word is ended by a terminator and rotated in all ways. The rotation that puts a character last has all the others before it:
so words that differ in that character alone have rotations with one common prefix, all but the last character, and the word
without that character has this prefix as a whole rotation. After sorting, each such prefix is one range: at most one shorter
word (the prefix is one of its rotations) and one longer word for each character that may follow. Ranges are scanned once, in
order; a member's neighbours are the others, so counts and the most frequent of them follow from the range without pairing it out.
Of equal neighbouring characters only the first is taken out, so two words are neighbours in one range only.

Rotations are dealt by range of the prefix, then sorted by it within each task. No range has more members than the alphabet has
letters and one, so hot words and frequent letters do no harm; a word that a third of all texts hold is counted before the shuffle.

Words are numbered in their own order, and ranges carry numbers. The most frequent neighbour of a word is its form if it is
LEAD times as frequent or more; forms are followed to the last by pointer doubling: frequencies at least double at each step, so
chains are short and never cyclic.

Prefixes of over LONG characters (words have no bound) are named by four residues of a rolling hash and the place, instead of being
written out, so a word of a million letters takes memory and time in proportion to its length.

Defined cases: null texts have no words; a null id is written as empty in the rule that thins words out; a word that is no one's
neighbour has ``n_near`` 0, no form, and is its own root; repeated rows count again; ties go to the word that is first in code-point
order; an empty table gives an empty one; of clashing extra columns only the id and text columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.binding import let
from cairn.session import discard, materialise

#: Words: at least so many characters and occurrences. A form is at least LEAD times as frequent.
LEAST_LENGTH, LEAST_COUNT, LEAD = 5, 3, 2
#: One occurrence of a word in THIN loses a character.
THIN = 97
#: Prefixes of more characters are named by a hash.
LONG = 64
END = "$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MODULUS = np.uint64((1 << 31) - 1)
_BASES = (0x2C1B3C6D, 0x297A2D39, 0x165667B1, 0x1B873593)


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words after thinning. Shorter runs can't become words, so they are not even listed."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"([A-Za-zÀ-ÿ]{{{least_length},}})"), 1)
    each = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.explode_outer(runs).alias("_run")).where(F.col("_run").isNotNull())
    ascii_only = F.octet_length("_run") == F.char_length("_run")
    each = each.withColumn("_run", F.when(ascii_only, F.lower("_run")).otherwise(F.translate("_run", _UPPER, _LOWER)))
    each = each.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    word = F.when(F.col("_h") % THIN == 0, cut).otherwise(F.col("_run"))
    return each.groupBy(word.alias("word")).agg(F.count("*").alias("n")).where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def _rotations(words: DataFrame) -> DataFrame:
    """(key, long, id, n, once): the prefixes of each word's rotations.

    ``long``: the rotation is the prefix and one character; otherwise the rotation is the prefix. ``once``: the character differs
    from the one before it.
    """
    w, n = F.col("word"), F.char_length("word")
    letter = lambda i: F.substring(w, i + 1, F.lit(1))
    rest = lambda i, skip: F.concat(F.substring(w, i + 1 + skip, n), F.lit(END), F.substring(w, F.lit(1), i))
    longer = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(rest(i, 1).alias("key"), F.lit(True).alias("long"), ((i == 0) | (letter(i) != letter(i - 1))).alias("once")))
    whole = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(rest(i, 0).alias("key"), F.lit(False).alias("long"), F.lit(False).alias("once")))
    none = F.array().cast("array<struct<key:string,long:boolean,once:boolean>>")
    both = F.concat(F.when(n <= LONG + 1, longer).otherwise(none), F.when(n <= LONG, whole).otherwise(none))
    short = words.where(n <= LONG + 1).select("id", "n", F.explode(both).alias("r")).select("r.key", "r.long", "id", "n", "r.once")
    return short.unionByName(words.where(n > LONG).select("id", "n", "word").mapInArrow(_long_rotations, "key string, long boolean, id long, n long, once boolean"))


def residues(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base: the hash of every prefix, and the powers of the base, modulo a prime."""
    out = []
    for base in _BASES:
        power = np.ones(len(points) + 1, np.uint64)
        have = 1
        while have < len(power):  # by doubling
            step = np.uint64(pow(base, have, int(_MODULUS)))
            more = min(have, len(power) - have)
            power[have : have + more] = power[:more] * step % _MODULUS
            have += more
        terms = points.astype(np.uint64) * power[:-1] % _MODULUS
        out.append((np.concatenate([[np.uint64(0)], np.cumsum(terms) % _MODULUS]).astype(np.uint64), power))
    return out


def _long_rotations(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for number, n, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
            size = len(points)
            hashes = residues(points)
            for long in (True, False):
                if not long and size <= LONG:
                    continue
                if long and size <= LONG + 1:
                    continue
                for start in range(0, size + (not long), 1 << 16):
                    i = np.arange(start, min(start + (1 << 16), size + (not long)))
                    parts = []
                    for prefix, power in hashes:
                        if long:  # without the character at i: what follows moves one place to the front
                            back = np.uint64(pow(int(power[1]), -1, int(_MODULUS)))
                            parts.append((prefix[i] + (prefix[-1] + _MODULUS - prefix[i + 1]) % _MODULUS * back) % _MODULUS)
                        else:
                            parts.append(np.full(len(i), prefix[-1]))
                    rest = size - long
                    keys = [f"{END}{rest}:{k}:" + ".".join(map(str, own)) for k, own in zip(i.tolist(), zip(*(p.tolist() for p in parts), strict=True), strict=True)]
                    once = np.ones(len(i), bool)
                    if long:
                        once = (i == 0) | (points[i] != points[np.maximum(i - 1, 0)])
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.full(len(i), long)), pa.array(np.full(len(i), number)), pa.array(np.full(len(i), n)), pa.array(once & long)], names=["key", "long", "id", "n", "once"])


def _scan(batches: Iterator[pa.RecordBatch]):
    """Sorted rotations to (id, near, best_n, best): what each range tells about its members. The last range of a batch waits for the next batch."""
    names = ["id", "near", "best_n", "best"]

    def found(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        key = table.column("key").combine_chunks()
        long, once = (table.column(c).to_numpy() for c in ("long", "once"))
        number, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        own = np.repeat(np.arange(len(first)), size)
        shorter = np.add.reduceat((~long).astype(np.int64), first) if len(first) else first  # 0 or 1, before the longer ones
        longer = size - shorter
        top = first + shorter  # the most frequent of the longer ones
        out = []
        a = np.flatnonzero(long & (longer[own] > 1))  # replaced: the other longer ones
        best = np.where(a == top[own[a]], a + 1, top[own[a]])
        out.append((number[a], longer[own[a]] - 1, n[best], number[best]))
        b = np.flatnonzero(once & (shorter[own] == 1))  # deleted: the shorter one
        best = first[own[b]]
        out.append((number[b], np.ones(len(b), np.int64), n[best], number[best]))
        leads = np.append(True, own[b][1:] != own[b][:-1])[: len(b)]  # inserted: the longer ones
        c = b[leads]
        short = first[own[c]]
        out.append((number[short], np.diff(np.append(np.flatnonzero(leads), len(b))), n[c], number[c]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=names)

    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        key = table.column("key")
        same = pc.equal(key, key[len(key) - 1]).to_numpy()
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield found(table.slice(0, cut))
        waiting = table.slice(cut)
    if waiting is not None:
        yield found(waiting)


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best): neighbours of each of (id, word, n) that has some, and the most frequent of them."""
    dealt = _rotations(words).repartitionByRange("key").sortWithinPartitions("key", "long", F.desc("n"), "id")
    found = dealt.select("key", "long", "id", "n", "once").mapInArrow(_scan, "id long, near long, best_n long, best long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best).select("id", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, to) with ``to`` the last of the forms that follow, from (id, to) with the next."""
    while True:
        onward = forms.select(F.col("id").alias("to"), F.col("to").alias("on"))
        moved = materialise(forms.join(onward, "to", "left").select("id", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")), "roots")
        discard(forms)
        forms = moved
        if forms.where("moved").isEmpty():
            return forms.select("id", "to")


def group_variants(words: DataFrame, *, lead: int = LEAD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n)."""
    numbered = words.repartitionByRange("word").sortWithinPartitions("word").select("word", "n", F.monotonically_increasing_id().alias("id"))
    numbered = materialise(numbered, "words")
    near = materialise(near_words(numbered), "near-words")
    formed = numbered.join(near, "id").where(F.col("best_n") >= lead * F.col("n"))
    forms = materialise(formed.select("id", F.col("best").alias("to"), F.col("best_n").alias("form_n")), "forms")
    roots = _roots(materialise(forms.select("id", "to"), "roots"))
    name = lambda to, column: numbered.select(F.col("id").alias(to), F.col("word").alias(column))
    facts = forms.join(name("to", "form"), "to").join(roots.select("id", F.col("to").alias("_root")), "id").join(name("_root", "root"), "_root")
    facts = materialise(facts.select("id", "form", "root", "form_n"), "variants")
    out = numbered.join(near.select("id", "n_near"), "id", "left").join(facts, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word of ``docs`` with its form, its root and how many words are near it."""
    return group_variants(materialise(word_counts(docs, doc_id=doc_id, text=text), "counted-words"))


#: Bytes of a text of ASCII and of characters from U+00C0 to U+00FF; CRC-32 by a table; neighbours meet on what is left without a character.
ORACLE = """
WITH crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(b)
  )
),
each AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{5,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS n FROM each GROUP BY 1, 2),
hashed AS (
  SELECT run, n,
    xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(named, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc_table
),
thinned AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM words, unnest(range(length(word))) u(i)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
),
near AS (SELECT word, count(*) AS n_near, max(n) AS best_n FROM pairs GROUP BY word),
best AS (SELECT p.word, min(p.other) AS best FROM pairs p JOIN near USING (word) WHERE p.n = near.best_n GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(near.n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
chains AS (
  WITH RECURSIVE c AS (SELECT word, word AS latest, 0 AS step FROM words UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN forms f ON f.word = c.latest WHERE f.form IS NOT NULL)
  SELECT word, arg_max(latest, step) AS root FROM c GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chains USING (word)
"""
