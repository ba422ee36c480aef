"""Spelling variants against all pairs of words; long words; defined cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from cairn.llm import spelling

SCHEMA = "doc_id long, text string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            out[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    links = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if v != w and near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in links.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(links[w]), n[form[w]] if w in form else None))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aabaa"]
    words = {}
    for stem in stems:
        words[stem] = rng.randrange(1, 200)
        for _ in range(12):
            own = list(stem)
            for _ in range(rng.randrange(1, 3)):
                i = rng.randrange(len(own))
                kind = rng.randrange(3)
                if kind == 0:
                    own[i] = rng.choice("abcdé")
                elif kind == 1:
                    own.insert(i, rng.choice("abcdé"))
                elif len(own) > 5:
                    del own[i]
            words["".join(own)] = rng.randrange(1, 60)
    out = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(out) == plain(words)
    assert any(r[2] not in (r[0], r[1]) for r in plain(words))  # chains


def test_long_words(spark, monkeypatch):
    rng = random.Random(6)
    words = {}
    for size in (62, 63, 64, 65, 66, 67, 300):
        base = "".join(rng.choice("ab") for _ in range(size))
        words |= {base: 50, base[:30] + "x" + base[31:]: 10, base[:-1] + "y": 9, base[:12] + base[13:]: 4, "z" + base: 3, base[::-1]: 7}
    assert got(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain(words)
    few = {w[:20]: n for w, n in words.items()}
    monkeypatch.setattr(spelling, "LONG", 6)
    assert got(spelling.group_variants(spark.createDataFrame(list(few.items()), "word string, n long"))) == plain(few)


def test_a_word_of_very_many_letters(spark):
    long = "".join(random.Random(1).choice("abc") for _ in range(40_000))
    words = {long: 9, long[:20_000] + long[20_001:]: 3}
    assert got(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == sorted([(long, None, long, 9, 1, None), (long[:20_000] + long[20_001:], long, long, 3, 1, 9)])


def test_residues_are_those_of_plain_numbers():
    points = np.arange(70_000, dtype=np.uint32) % 251
    for (prefix, power), base in zip(spelling.residues(points), spelling._BASES):
        p, h = (1 << 31) - 1, 0
        for i in range(2000):
            assert prefix[i] == h and power[i] == pow(base, i, p)
            h = (h + int(points[i]) * pow(base, i, p)) % p


def test_counts_nulls_repeats_and_clashing_columns(spark):
    rng = random.Random(8)
    pool = ["Étage", "ÉTAGE", "etage", "colour", "color", "colours", "Colour", "ab", "abcd", "a×b÷c", "ÿÿÿÿÿ"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(pool) for _ in range(60)) + "-" * (i % 3)) for i in range(120)]
    rows += [rows[0], rows[0], (5, None), (6, ""), (7, "colour " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as n", "3 as word", "4 as _h")
    n = counted(rows)
    assert dict(map(tuple, spelling.word_counts(df).select("word", "n").collect())) == n
    assert got(spelling.variants(df)) == plain(n)
    assert "étage" not in n and "Étage" in n  # only A to Z are lower-cased
    assert spelling.variants(df.limit(0)).count() == 0
