"""Gates between evidence and release: which link of each hit's chain of evidence breaks first, what a run lacks, how a run scores.

A hit is a row (run_id, hit_no, company, chunk_id, element_type, unit, element_ids, physical_page, document_id, document_sha256,
source_reference). A chain is followed in a stated order and the first broken link is named; a whole chain has none. Requirements
(companies, kinds) are short stated lists; everything else is joined and grouped by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import broadcast_if_small

#: Certified documents and their owners are a stated list; up to so many are broadcast.
DOCUMENTS = 200_000
#: Kinds of element that can carry evidence of a document.
ELEMENT_KINDS = ("heading", "paragraph", "list", "table", "figure_caption", "footnote")


def _present(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def _some(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def first_broken(*links: tuple[str, Column]) -> Column:
    """The name of the first link that doesn't hold; null if all do."""
    return F.coalesce(*(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in links))


def table_chain(hits: DataFrame, certified: DataFrame, companies: list[str]) -> DataFrame:
    """Hits with ``broken``: a certified hit is of a required company, a table with unit, chunk and elements, on a page, of a document whose hash is ``certified`` (document_sha256)."""
    known = certified.select("document_sha256").distinct().withColumn("_known", F.lit(True))
    rows = hits.join(broadcast_if_small(known, DOCUMENTS), "document_sha256", "left")
    broken = first_broken(
        ("company", F.col("company").isin(companies)), ("element_type", F.col("element_type") == "table"), ("unit", F.col("unit").isNotNull()), ("chunk", _present(F.col("chunk_id"))), ("elements", _some(F.col("element_ids"))),
        ("page", F.col("physical_page") > 0), ("hash", F.col("_known")),
    )
    return rows.withColumn("broken", broken).select(*hits.columns, "broken")


def ownership_chain(hits: DataFrame, owners: DataFrame, prefixes: dict[str, str], kinds: tuple[str, ...] = ELEMENT_KINDS) -> DataFrame:
    """Hits with ``owner`` and ``broken``: evidence counts for the company that owns its document, by hash in ``owners``
    (document_sha256, owner), or else by the start of its id, and only if that is the company it claims."""
    by_hash = owners.groupBy("document_sha256").agg(F.min("owner").alias("_by_hash"))
    rows = hits.join(broadcast_if_small(by_hash, DOCUMENTS), "document_sha256", "left")
    by_id = F.coalesce(*(F.when(F.col("document_id").startswith(start), company) for start, company in prefixes.items()))
    rows = rows.withColumn("owner", F.coalesce("_by_hash", by_id))
    broken = first_broken(
        ("element_type", F.col("element_type").isin(*kinds)), ("elements", _some(F.col("element_ids"))), ("source", _present(F.col("source_reference"))), ("chunk", _present(F.col("chunk_id"))),
        ("owner", F.col("owner").isNotNull()), ("claim", F.col("owner") == F.col("company")), ("page", F.col("physical_page") > 0),
    )
    return rows.withColumn("broken", broken).select(*hits.columns, "owner", "broken")


def gate(runs: DataFrame, observed: DataFrame, companies: list[str], kinds: list[str]) -> DataFrame:
    """(run_id, passed, coverage, missing) of every run: each company needs each kind among (run_id, company, kind).

    ``coverage`` and ``missing`` list "<company> <kind>" in the order of the two lists.
    """
    required = [f"{c} {k}" for c in companies for k in kinds]
    wanted = F.array(*(F.lit(x) for x in required))
    item = F.concat_ws(" ", "company", "kind")
    have = observed.select("run_id", item.alias("item")).where(F.col("item").isin(required)).groupBy("run_id").agg(F.collect_set("item").alias("have"))  # as many as are required at most
    rows = runs.select("run_id").distinct().join(have, "run_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    coverage, missing = F.filter(wanted, lambda x: F.array_contains("have", x)), F.filter(wanted, lambda x: ~F.array_contains("have", x))
    return rows.select("run_id", (F.size(missing) == 0).alias("passed"), coverage.alias("coverage"), missing.alias("missing"))


def evidence_kinds(observations: DataFrame, *, metric: str = "get_company_metric", document: str = "search_financial_documents") -> DataFrame:
    """(run_id, company, kind) that observations (run_id, capability, status, company, source_references, evidence_ids, hits) give evidence of.

    A metric counts with sources, none of them blank; a document with a hit (source, evidence_id) whose source and id the
    observation declares. Only successful observations count.
    """
    sources, ids = F.col("source_references"), F.col("evidence_ids")
    with_sources = _some(sources) & F.forall(sources, _present)
    cited = F.exists("hits", lambda h: _present(h["source"]) & _present(h["evidence_id"]) & F.array_contains(sources, h["source"]) & F.array_contains(ids, h["evidence_id"]))
    kind = F.when((F.col("capability") == metric) & with_sources, "metric").when((F.col("capability") == document) & F.coalesce(cited, F.lit(False)), "document")
    return observations.where("status = 'ok'").select("run_id", "company", kind.alias("kind")).where("kind is not null and company is not null").distinct()


def exact_citations(runs: DataFrame, facts: DataFrame, hits: DataFrame, certified: DataFrame) -> DataFrame:
    """(run_id, exact): every fact of a run is one of its hits' (chunk, company, source, page, elements among the hit's, document certified), there
    is one, and ``aggregate_sources`` of ``runs`` are the facts' sources in the order of their first use.

    Of several hits of one chunk the last counts. Facts are (run_id, fact_no, company, chunk_id, element_ids, source_reference, physical_page).
    """
    last = hits.groupBy("run_id", "chunk_id").agg(F.max_by(F.struct("company", "element_ids", "source_reference", "physical_page", "document_sha256"), "hit_no").alias("h"))
    known = certified.select("document_sha256").distinct().withColumn("_known", F.lit(True))
    rows = facts.join(last, ["run_id", "chunk_id"], "left").withColumn("document_sha256", F.col("h.document_sha256")).join(broadcast_if_small(known, DOCUMENTS), "document_sha256", "left")
    fits = (
        F.col("h").isNotNull() & (F.size(F.array_except("element_ids", "h.element_ids")) == 0) & (F.col("company") == F.col("h.company"))
        & (F.col("source_reference") == F.col("h.source_reference")) & (F.col("physical_page") == F.col("h.physical_page")) & F.col("_known")
    )
    first_use = facts.groupBy("run_id", "source_reference").agg(F.min("fact_no").alias("at")).groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source_reference"))), lambda s: s["source_reference"]).alias("sources"))
    held = rows.groupBy("run_id").agg(F.min(F.coalesce(fits, F.lit(False))).alias("held"))
    out = runs.select("run_id", "aggregate_sources").join(held, "run_id", "left").join(first_use, "run_id", "left")
    return out.select("run_id", F.coalesce(F.col("held") & (F.col("aggregate_sources") == F.col("sources")), F.lit(False)).alias("exact"))


METRICS = ("tool_correctness", "tool_efficiency", "answer_relevance", "answer_completeness", "citation_integrity")


def evaluate_runs(runs: DataFrame, observations: DataFrame, expected: DataFrame, facts: DataFrame, hits: DataFrame, gates: DataFrame, certified: DataFrame, companies: list[str]) -> DataFrame:
    """(run_id, the five METRICS as 0 or 1, release): a run is released if all are 1.

    ``runs`` has (run_id, status, replans, max_steps, max_replans, intent, label, briefing, summary, cross_observations, interpretation,
    limitations, covered, aggregate_sources), the counts and texts null without a briefing, ``covered`` the companies with evidence in
    it; ``observations`` (run_id, position, signature, status), positions from one; ``expected`` (position, signature), the one order
    of calls; ``gates`` (run_id, passed).
    """
    known = expected.select("position", F.col("signature").alias("_wanted"))
    steps = known.count()
    calls = observations.join(F.broadcast(known), "position", "left")  # a stated list
    ok = F.when(F.col("status") == "ok", F.col("signature"))
    seen = calls.groupBy("run_id").agg(
        F.count("*").alias("calls"), F.count_if(F.coalesce(F.col("signature") == F.col("_wanted"), F.lit(False))).alias("in_order"), F.count_if(F.col("status") == "error").alias("errors"),
        F.count(ok).alias("good"), F.countDistinct(ok).alias("different"),
    )
    named = facts.groupBy("run_id").agg(F.array_sort(F.collect_set("company")).alias("named"))
    exact = exact_citations(runs, facts, hits, certified)
    rows = runs.join(seen, "run_id", "left").join(named, "run_id", "left").join(exact, "run_id", "left").join(gates.select("run_id", "passed"), "run_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    every = F.array_sort(F.array(*(F.lit(c) for c in companies)))
    briefed = F.coalesce("briefing", F.lit(False))
    checks = (
        (n("calls") == steps) & (n("in_order") == steps) & (n("errors") == 0) & (F.col("replans") == 0),
        (n("calls") <= F.col("max_steps")) & (F.col("replans") <= F.col("max_replans")) & (n("good") == n("different")),
        (F.col("status") == "completed") & briefed & F.col("intent").isNotNull() & (F.col("named") == every) & ((F.col("intent") == "reference") | F.contains(F.lower("summary"), F.col("label"))),
        briefed & _present(F.col("summary")) & (n("cross_observations") > 0) & (n("interpretation") > 0) & (n("limitations") > 0) & (F.size(F.array_except(every, F.col("covered"))) == 0),
        briefed & F.coalesce("passed", F.lit(False)) & F.col("exact"),
    )
    scored = rows.select("run_id", *(F.coalesce(c, F.lit(False)).cast("int").alias(name) for name, c in zip(METRICS, checks, strict=True)))
    return scored.withColumn("release", F.least(*METRICS) == 1)
