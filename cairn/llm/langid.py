"""Language identification by fusing evidence with Bayes' rule.

Four kinds of evidence, each as log probabilities by language: letter trigrams of the whole text (multinomial, learnt from
all labelled documents by a grouped sum), the language that the markup declares, the suffix of the address, and a prior of
the host. How often each declaration or suffix goes with each language, and what languages each host has, are grouped sums
of the texts' own posteriors over all rows; a host's counts are smoothed toward its domain's, and those toward the whole
table's. A row's own text is taken out of its host's counts before it is judged.

Beside the languages stands one more class, a text in none of them: its trigrams fall into all buckets alike, it has the prior
UNKNOWN at every host, and its declarations and suffixes are any of those seen. A row is accepted if a language has
MIN_POSTERIOR or more of the fused posterior, so gibberish and text in other languages go, whatever the markup declares.

Defined cases: a null text is empty; a text without letters is judged by the other evidence and not accepted; null hosts,
suffixes and declarations give no evidence; a table of labels with no row gives language null; repeated rows each get
their row; an empty table gives an empty one; added columns start with an underscore or replace those of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.binding import let
from cairn.llm.common import chunks, join_facts, utf8
from cairn.session import materialise

BUCKETS = 1 << 14
#: The text counts as so many independent trigrams at most: neighbouring trigrams repeat each other's evidence.
EFFECTIVE = 60.0
SMOOTHING = 0.5
#: Pseudo-rows by which a host leans on its domain, and a domain on the table.
HOST_STRENGTH, DOMAIN_STRENGTH = 5.0, 20.0
MIN_POSTERIOR = 0.5
UNKNOWN = 0.05
#: Hosts and domains are joined by broadcast up to so many of them, by shuffle beyond.
BROADCAST_HOSTS = 50_000

_FOLD = np.full(256, 32, np.uint32)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram at each byte, whether it counts, row of each byte) of several texts."""
    base = int(at[0])
    x = _FOLD[data[base : int(at[-1])]]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n = max(0, len(x) - 2)
    a, b, c = x[:n], x[1 : n + 1], x[2 : n + 2]
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    ok = (row[:n] == row[2 : n + 2]) & (b != 32) & ((a != 32) | (c != 32))
    return (h >> np.uint32(16)) & np.uint32(BUCKETS - 1), ok, row[:n]


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    log_p: np.ndarray  # (BUCKETS, languages), float32


def train(docs: DataFrame, *, text: str = "text", label: str = "lang") -> TextModel:
    """Counts trigrams by language over all labelled rows. What reaches the driver is languages x BUCKETS sums."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, at = utf8(batch.column(1))
            names = np.array(batch.column(0).to_pylist(), object)
            for i, j in chunks(at):
                h, ok, row = _trigrams(data, at[i : j + 1])
                for name in set(names[i:j]):
                    own = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    own += np.bincount(h[ok & (names[i:j] == name)[row]], minlength=BUCKETS)
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(own[at], pa.int64())})

    rows = docs.select(F.col(label).alias("lang"), F.col(text).alias("text")).where("lang is not null")
    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    lang = found.column("lang").combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    languages = tuple(sorted(names))
    counts = np.full((BUCKETS, max(1, len(languages))), SMOOTHING)
    if len(found):
        place = np.array([languages.index(name) for name in names])[lang.indices.to_numpy()]
        counts[found.column("bucket").to_numpy(), place] += found.column("n").to_numpy()
    return TextModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def with_likelihoods(df: DataFrame, model: TextModel, text: str = "text") -> DataFrame:
    """Adds ``_ll``, the tempered log likelihood of the text in each language, and ``_grams``, the trigrams that count."""
    log_p, width = model.log_p, len(model.languages)
    schema = T.StructType([f for f in df.schema.fields if f.name not in ("_ll", "_grams")] + [T.StructField("_ll", T.ArrayType(T.DoubleType())), T.StructField("_grams", T.LongType())])
    df = df.drop("_ll", "_grams")

    def score(batches):
        for batch in batches:
            data, at = utf8(batch.column(batch.schema.get_field_index(text)))
            ll, grams = np.zeros((batch.num_rows, width)), np.zeros(batch.num_rows, np.int64)
            for i, j in chunks(at):
                h, ok, row = _trigrams(data, at[i : j + 1])
                h, row = h[ok], row[ok]
                if not len(h):
                    continue
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                n = np.diff(np.append(first, len(row)))
                grams[i + row[first]] = n
                ll[i + row[first]] = np.add.reduceat(log_p[h].astype(np.float64), first, axis=0)[:, :width] * (np.minimum(n, EFFECTIVE) / n)[:, None]
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * width, width or 1)[: batch.num_rows + 1] if width else np.zeros(batch.num_rows + 1), pa.int32()), pa.array(ll.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, values, pa.array(grams, pa.int64())], names=[*batch.schema.names, "_ll", "_grams"])

    return df.mapInArrow(score, schema)


def _softmax(ll: Column) -> Column:
    powers = let(F.array_max(ll), lambda top: F.transform(ll, lambda x: F.exp(x - top)))
    return let(powers, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(e, lambda x: x / total)))


def _sums(rows: DataFrame, key: str, width: int) -> DataFrame:
    """Posterior mass by language for each value of a column; partial sums come before the shuffle, so a hot value is one row a task."""
    sums = [F.sum(F.get("_post", F.lit(k))).alias(f"s{k}") for k in range(width)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*sums, F.count("*").alias(f"{key}_rows")).select(key, F.array(*(f"s{k}" for k in range(width))).alias(f"{key}_n"), f"{key}_rows")


def _plus(a: Column, b: Column, weight: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * weight)


def _share(counts: Column, prior: Column, strength: float) -> Column:
    """Dirichlet smoothing of counts toward a prior."""
    return let(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + strength, lambda total: F.transform(_plus(counts, prior, strength), lambda x: x / total))


def identify(df: DataFrame, model: TextModel, *, text: str = "text", host: str | None = None, domain: str | None = None, suffix: str | None = None, declared: str | None = None) -> DataFrame:
    """Adds ``lang_id``, ``lang_posterior``, ``lang_text`` (by text alone), ``lang_accepted`` to every row."""
    names = {"_host": host, "_domain": domain, "_suffix": suffix, "_declared": declared}
    df = df.drop("lang_id", "lang_posterior", "lang_text", "lang_accepted", "_post", *names)
    if not model.languages:
        return df.withColumns({"lang_id": F.lit(None).cast("string"), "lang_posterior": F.lit(0.0), "lang_text": F.lit(None).cast("string"), "lang_accepted": F.lit(False)})
    width = len(model.languages)
    df = df.withColumns({k: (F.col(c) if c else F.lit(None)).cast("string") for k, c in names.items()})
    # first pass: only the posteriors and the keys are kept, to be summed
    seen = with_likelihoods(df.select(*names, F.col(text).alias("_text")), model, "_text").select(*names, "_grams", _softmax(F.col("_ll")).alias("_post")).where("_grams > 0")
    seen = materialise(seen, "text-posteriors")
    sums = {k: materialise(_sums(seen, k, width), f"sums{k}") for k, c in names.items() if c}
    whole = seen.agg(*(F.coalesce(F.sum(F.get("_post", F.lit(k))), F.lit(0.0)).alias(f"s{k}") for k in range(width))).first()
    mass = [whole[k] + 1.0 for k in range(width)]
    root = F.array(*(F.lit(m / sum(mass)) for m in mass))
    # second pass: the same likelihoods beside whole rows, and the fused posterior
    out = with_likelihoods(df, model, text).withColumn("_post", _softmax(F.col("_ll")))
    for k, table in sums.items():
        if table.count() <= BROADCAST_HOSTS:
            out = out.join(F.broadcast(table.drop(f"{k}_rows")), k, "left")
        else:
            out = join_facts(out, table, k, f"{k}_rows", seen.count())
    own = F.when(F.col("_grams") > 0, F.col("_post")).otherwise(F.transform("_post", lambda x: F.lit(0.0)))
    less = lambda c: F.zip_with(F.col(c), own, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    prior = root
    for key, strength in (("_domain", DOMAIN_STRENGTH), ("_host", HOST_STRENGTH)):
        if key in sums:
            out = out.withColumn(f"{key}_p", F.when(F.col(f"{key}_n").isNotNull(), _share(less(f"{key}_n"), prior, strength)).otherwise(prior))
            prior = F.col(f"{key}_p")
    total = F.zip_with("_ll", prior, lambda a, p: a + F.log(p * (1 - UNKNOWN)))
    unknown = F.least(F.col("_grams").cast("double"), F.lit(EFFECTIVE)) * float(-np.log(BUCKETS)) + float(np.log(UNKNOWN))
    for key in ("_declared", "_suffix"):
        if key in sums:  # P(value | language), smoothed
            values = F.lit(float(sums[key].count() + 1))
            given = F.zip_with(less(f"{key}_n"), F.array(*(F.lit(m) for m in mass)), lambda n, m: F.log((n + SMOOTHING) / (m + SMOOTHING * values)))
            total = F.when(F.col(f"{key}_n").isNotNull(), F.zip_with(total, given, lambda a, b: a + b)).otherwise(total)
            unknown = unknown - F.when(F.col(f"{key}_n").isNotNull(), F.log(values)).otherwise(0.0)
    langs = F.array(*(F.lit(x) for x in model.languages))
    best = lambda p: F.get(langs, F.array_position(p, F.array_max(p)).cast("int") - 1)
    out = out.withColumn("_fused", F.concat(total, F.array(unknown))).withColumn("_fused", F.slice(_softmax(F.col("_fused")), 1, width))
    out = out.withColumns({"lang_id": best(F.col("_fused")), "lang_posterior": F.array_max("_fused"), "lang_text": F.when(F.col("_grams") > 0, best(F.col("_post")))})
    out = out.withColumn("lang_accepted", (F.col("_grams") > 0) & (F.col("lang_posterior") >= MIN_POSTERIOR))
    extra = ["_ll", "_grams", "_post", "_fused", *names, *(f"{k}_n" for k in sums), *(f"{k}_p" for k in sums)]
    return out.drop(*extra)


def page_evidence(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Adds the visible text, host, domain, suffix and declared language of web pages."""
    body = F.coalesce(F.col(html), F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>|&[A-Za-z#0-9]+;", " ")
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    return pages.withColumns(
        {
            "page_text": visible,
            "page_host": host,
            "page_domain": F.substring_index(host, ".", -2),
            "page_suffix": F.substring_index(host, ".", -1),
            "page_declared": (lambda c: F.when(c != "", c))(F.lower(F.regexp_extract(body, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))),
        }
    )
