"""Language identification: held-out accuracy, evidence, defined cases."""

import re
from math import exp, log

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    part = F.xxhash64("doc_id") % 2 == 0
    model = langid.train(docs.where(part))
    got = langid.identify(docs.where(~part), model, host="source").agg(F.avg((F.col("lang") == F.col("lang_id")).cast("double")), F.avg(F.col("lang_accepted").cast("double"))).first()
    assert got[0] > 0.95 and got[1] > 0.97


def test_evidence_moves_a_text_that_says_little(spark):
    train = spark.createDataFrame([("the cat of the house and the dog", "en"), ("le chat de la maison et le chien", "fr")] * 20, "text string, lang string")
    model = langid.train(train)
    rows = [(i, "le chat de la maison et le chien", "h.fr", "fr", "fr") for i in range(30)] + [(i + 100, "the cat of the house and the dog", "h.en", "en", "en") for i in range(30)]
    rows += [(1000, "a", "h.fr", "fr", "fr"), (1001, None, "h.fr", "fr", "fr"), (1002, "", None, None, None), (1003, "the dog and the cat of the house", "h.fr", "fr", "fr"), (1000, "a", "h.fr", "fr", "fr")]
    df = spark.createDataFrame(rows, "id long, text string, host string, suffix string, declared string").selectExpr("*", "1 as _ll", "'q' as lang_id", "2 as _post")
    got = {r.id: r for r in langid.identify(df, model, host="host", domain="host", suffix="suffix", declared="declared").collect()}
    assert got[1001].lang_id == "fr" and not got[1001].lang_accepted
    assert got[1003].lang_text == "en"
    assert got[5].lang_id == "fr" and got[105].lang_id == "en" and got[5].lang_accepted
    assert not got[1002].lang_accepted
    assert langid.identify(df.limit(0), model).count() == 0
    assert langid.identify(df, langid.train(train.limit(0))).where("lang_id is not null").count() == 0


def test_likelihoods_are_those_of_a_plain_loop(spark):
    train = spark.createDataFrame([("Abc ab, été", "x"), ("zz top zz", "y")], "text string, lang string")
    model = langid.train(train)
    texts = ["abc zz", "Été", "", "a"]
    got = langid.with_likelihoods(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), model).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        b = [int(langid._FOLD[x]) for x in t.encode()]
        ll, n = np.zeros(2), 0
        for u, v, w in zip(b, b[1:], b[2:]):
            if v != 32 and (u != 32 or w != 32):
                h = ((u * 0x9E3779B1) & 0xFFFFFFFF) ^ ((v * 0x85EBCA6B) & 0xFFFFFFFF) ^ ((w * 0xC2B2AE35) & 0xFFFFFFFF)
                h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
                ll += model.log_p[(h >> 16) & (langid.BUCKETS - 1)]
                n += 1
        assert r._grams == n and np.allclose(r._ll, ll * (min(n, langid.EFFECTIVE) / n if n else 1), atol=1e-4)


def trigrams(text):
    b = [int(langid._FOLD[x]) for x in (text or "").encode()]
    out = []
    for u, v, w in zip(b, b[1:], b[2:]):
        if v != 32 and (u != 32 or w != 32):
            h = ((u * 0x9E3779B1) & 0xFFFFFFFF) ^ ((v * 0x85EBCA6B) & 0xFFFFFFFF) ^ ((w * 0xC2B2AE35) & 0xFFFFFFFF)
            out.append((((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16) & (langid.BUCKETS - 1))
    return out


def softmax(x):
    e = [exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def plain_posteriors(train, rows):
    """Of (text, host, domain, suffix, declared) rows: the fused posterior of every language, in plain loops."""
    langs = sorted({lang for _, lang in train if lang is not None})
    counts = {lang: [langid.SMOOTHING] * langid.BUCKETS for lang in langs}
    for text, lang in train:
        for t in trigrams(text) if lang is not None else ():
            counts[lang][t] += 1
    total = {lang: sum(c) for lang, c in counts.items()}
    known = []
    for text, *_ in rows:
        own = trigrams(text)
        scale = min(len(own), langid.EFFECTIVE) / len(own) if own else 0
        ll = [scale * sum(log(counts[lang][t] / total[lang]) for t in own) for lang in langs]
        known.append((len(own), ll, softmax(ll)))
    width = range(len(langs))
    sums = [{}, {}, {}, {}]
    mass = [1.0 for _ in width]
    for (n, _, post), (_, *keys) in zip(known, rows):
        if n:
            mass = [m + p for m, p in zip(mass, post)]
            for table, key in zip(sums, keys):
                if key is not None:
                    table[key] = [a + p for a, p in zip(table.get(key, [0.0] * len(langs)), post)]
    out = []
    for (n, ll, post), (_, *keys) in zip(known, rows):
        less = lambda at: [max(a - (p if n else 0.0), 0.0) for a, p in zip(sums[at][keys[at]], post)]  # noqa: B023, E731
        prior = [m / sum(mass) for m in mass]
        for at, strength in ((1, langid.DOMAIN_STRENGTH), (0, langid.HOST_STRENGTH)):
            if keys[at] in sums[at]:
                own = less(at)
                prior = [(a + strength * p) / (sum(own) + strength) for a, p in zip(own, prior)]
        fused = [a + log(p * (1 - langid.UNKNOWN)) for a, p in zip(ll, prior)]
        unknown = -min(n, langid.EFFECTIVE) * log(langid.BUCKETS) + log(langid.UNKNOWN)
        for at in (3, 2):
            if keys[at] in sums[at]:
                values = len(sums[at]) + 1
                fused = [f + log((a + langid.SMOOTHING) / (m + langid.SMOOTHING * values)) for f, a, m in zip(fused, less(at), mass)]
                unknown -= log(values)
        best = softmax([*fused, unknown])[:-1]
        out.append((langs[best.index(max(best))], max(best), n > 0 and max(best) >= langid.MIN_POSTERIOR))
    return out


def test_pages_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    train = [(r.text, r.lang) for r in docs.collect()][:60]
    model = langid.train(spark.createDataFrame(train, docs.schema))
    some = [t for t, lang in train if t and lang is not None][:24]
    pages = [(i, f"https://u@h{i % 5}.example.{['de', 'fr', 'com'][i % 3]}:80/x?y", f'<html lang="{["de", "en", "fr"][i % 3]}"><script>var the = 1</script><p>{t[: 40 * (i + 1)]}</p>') for i, t in enumerate(some)]
    pages += [(100, None, None), (101, "no address", "<p>xq zv</p>"), (102, "http://h1.example.de/", "<p>12 34</p>"), (103, "http://h1.example.de/", "xqzj wvkk pqzx jjqw zxcv bvnm qwrt plkj"), (104, "http://h2.example.com", some[3] * 200), pages[0], pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as _host", "2 as _ll")
    seen = langid.page_evidence(df)
    got = langid.identify(seen, model, text="page_text", host="page_host", domain="page_domain", suffix="page_suffix", declared="page_declared").collect()
    rows = []
    for r in got:
        host = re.match(r"[a-z]+://(?:u@)?([^:/]+)", r.url or "")
        host = host and host[1]
        declared = re.search('lang="(..)"', r.html or "")
        body = re.sub(r"<[^>]*>", " ", re.sub(r"<script>.*?</script>", " ", r.html or ""))
        rows.append((body, host, host and ".".join(host.split(".")[-2:]), host and host.split(".")[-1], declared and declared[1]))
    assert len(got) == len(pages)
    for r, (lang, posterior, accepted) in zip(got, plain_posteriors(train, rows)):
        assert abs(r.lang_posterior - posterior) < 1e-4 and r.lang_accepted == accepted, r
        assert posterior < 0.51 or r.lang_id == lang
    kept = {r.page_id for r in got if r.lang_accepted}
    assert 103 not in kept and 102 not in kept and {0, 5, 23, 104} <= kept


def test_hot_and_null_hosts_beyond_a_broadcast(spark, monkeypatch):
    train = spark.createDataFrame([("the cat of the house and the dog", "en"), ("le chat de la maison et le chien", "fr")] * 20, "text string, lang string")
    model = langid.train(train)
    rows = [(i, "le chat de la maison", "hot" if i % 2 else None if i % 3 else f"h{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, host string")
    want = sorted((r.id, r.lang_id, round(r.lang_posterior, 9)) for r in langid.identify(df, model, host="host").collect())
    monkeypatch.setattr(langid, "BROADCAST_HOSTS", 2)
    got = sorted((r.id, r.lang_id, round(r.lang_posterior, 9)) for r in langid.identify(df, model, host="host").collect())
    assert got == want and len(got) == 60
