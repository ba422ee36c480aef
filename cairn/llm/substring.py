"""Substring dedup with suffix automata over words.

``SuffixAutomaton`` holds all substrings of the texts of a reference shard, with the number of places of each. Documents
are streamed through it: after each word it knows the longest suffix read so far that the shard holds.

Two ways to use it. ``remove_reference`` takes a bounded reference (boilerplate, licences, a list of known passages), cuts
it into shards, broadcasts each shard's automaton and streams all documents past it, removing maximal spans of at least
``min_words`` words. ``remove_repeats`` takes the corpus as its own reference. That has no bound, so its automata are not
broadcast: shards are made by content (see ``repeats``), and the pieces of documents that could match a shard are routed
to it.

Defined cases: words are runs without ASCII whitespace; a null text has none; texts shorter than the window lose nothing;
the same row twice is two documents, so its windows repeat; an empty table gives an empty one; only the id and text columns
named are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import repeats
from cairn.llm.common import row_keys, utf8

WINDOW = 35
PLAN = repeats.Plan("words", WINDOW, gram=20, shard=60_000)
#: Words of a reference shard, and shards, that are broadcast at most: a few hundred bytes a word.
REFERENCE_WORDS, REFERENCE_SHARDS = 100_000, 64


class SuffixAutomaton:
    """All substrings of several word sequences, with weighted counts of places."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.len: list[int] = [0]
        self.count: list[int] = [0]

    def _clone(self, p: int, q: int, word: bytes) -> int:
        """Splits state ``q``: the substrings that ``p`` extends by ``word`` get a state of their own."""
        nxt, link = self.next, self.link
        c = len(self.len)
        nxt.append(nxt[q].copy())
        self.len.append(self.len[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = c
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = c
            p = link[p]
        return c

    def add(self, words: list[bytes], weight: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.len, self.count
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:  # held already, as in an earlier text
                last = q if length[q] == length[last] + 1 else self._clone(last, q, word)
                count[last] += weight
                continue
            cur = len(length)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(weight)
            p = last
            while p != -1 and word not in nxt[p]:
                nxt[p][word] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][word]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
            last = cur

    def finish(self) -> SuffixAutomaton:
        """Places of a substring are places of its suffixes: counts go up the links, longest first."""
        count, link = self.count, self.link
        for s in np.argsort(-np.array(self.len), kind="stable").tolist():
            if link[s] > 0:
                count[link[s]] += count[s]
        return self

    def repeated(self, words: list[bytes], window: int) -> np.ndarray:
        """For every window of the text, whether the shard holds it at two places or more."""
        nxt, link, length, count = self.next, self.link, self.len, self.count
        out = np.zeros(max(0, len(words) - window + 1), bool)
        state, have = 0, 0
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                have = length[state]
            to = nxt[state].get(word)
            if to is None:
                continue
            state, have = to, have + 1
            if have >= window:
                while length[link[state]] >= window:
                    state = link[state]
                have = min(have, length[state])
                out[i - window + 1] = count[state] > 1
        return out

    def spans(self, words: list[bytes], shortest: int) -> list[tuple[int, int]]:
        """Maximal spans [start, end) of at least ``shortest`` words that the shard holds, merged where they overlap."""
        nxt, link, length = self.next, self.link, self.len
        out: list[list[int]] = []
        state, have = 0, 0
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                have = length[state]
            to = nxt[state].get(word)
            state, have = (0, 0) if to is None else (to, have + 1)
            if have >= shortest:
                start = i + 1 - have
                if out and start <= out[-1][1]:
                    out[-1] = [min(out[-1][0], start), i + 1]
                else:
                    out.append([start, i + 1])
        return [tuple(x) for x in out]


def search(pieces: list[list[bytes]], counts: list[int], window: int) -> list[np.ndarray]:
    """Streams every piece of a shard past the shard's automaton."""
    automaton = SuffixAutomaton()
    for words, n in zip(pieces, counts, strict=True):
        automaton.add(words, n)
    automaton.finish()
    return [automaton.repeated(words, window) for words in pieces]


def _joined(text: bytes) -> bytes:
    return b" ".join(text.split())


def _kept(text: bytes, spans: list) -> str:
    words, out, at = text.split(), [], 0
    for s, e in spans:
        out += words[at:s]
        at = e
    return hashlib.sha256(b" ".join(out + words[at:])).hexdigest()


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", plan: repeats.Plan = PLAN) -> DataFrame:
    """One row per document: words, words removed as repeats of the corpus, and the hash of what is kept."""
    rows = row_keys(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id", "_text")
    scanned, spans = repeats.find(rows, plan, search, _joined)
    removed = repeats.without_spans(rows, spans, plan, _kept).drop("n_spans")
    return scanned.join(removed, ["_k1", "_k2"], "left").select(
        "doc_id", F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )


def remove_reference(docs: DataFrame, reference: DataFrame, *, text: str = "text", reference_text: str = "text", min_words: int = WINDOW) -> DataFrame:
    """Replaces the text by what is left of it, words joined by one space, where a span was removed; other texts stay as they are.

    The reference must fit into REFERENCE_SHARDS shards of REFERENCE_WORDS words; a larger one is refused.
    """
    sizes = reference.select(F.size(F.filter(F.split(F.coalesce(F.col(reference_text), F.lit("")), "[ \t\n\x0b\f\r]+"), lambda w: w != "")).alias("n")).agg(F.sum("n")).first()[0] or 0
    if sizes > REFERENCE_WORDS * REFERENCE_SHARDS:
        raise ValueError(f"a reference of {sizes} words is not broadcast")
    shards, held = [], SuffixAutomaton()
    for row in reference.where(F.col(reference_text).isNotNull()).select(reference_text).toLocalIterator():
        held.add(row[0].encode().split())
        if len(held.len) > 2 * REFERENCE_WORDS:
            shards.append(held)
            held = SuffixAutomaton()
    context = docs.sparkSession.sparkContext
    for shard in [*shards, held]:
        shipped = context.broadcast((shard.next, shard.link, shard.len))

        def run(batches, shipped=shipped):
            own = SuffixAutomaton()
            own.next, own.link, own.len = shipped.value
            for batch in batches:
                k = batch.schema.get_field_index(text)
                data, at = utf8(batch.column(k))
                out = batch.column(k).to_pylist()
                for t in range(batch.num_rows):
                    words = data[at[t] : at[t + 1]].tobytes().split()
                    if spans := own.spans(words, min_words):
                        kept, place = [], 0
                        for s, e in spans:
                            kept += words[place:s]
                            place = e
                        out[t] = b" ".join(kept + words[place:]).decode()
                columns = list(batch.columns)
                columns[k] = pa.array(out, batch.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        docs = docs.mapInArrow(run, docs.schema)
    return docs


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, i, md5(array_to_string(w[i:i + {WINDOW} - 1], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW})),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM p) WHERE n > 1),
cov AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM rep),
per AS (SELECT r, count(*) AS n, list(i) AS gone FROM cov GROUP BY r),
kept AS (SELECT r, array_to_string(list(word ORDER BY i), ' ') AS t FROM (SELECT d.r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d JOIN per USING (r)) x ANTI JOIN cov USING (r, i) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(per.n, 0)::BIGINT AS n_removed,
  CASE WHEN per.n IS NULL THEN sha256(array_to_string(d.w, ' ')) ELSE sha256(coalesce(kept.t, '')) END AS kept_sha256
FROM d LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""
