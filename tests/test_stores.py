"""Stores: writes that replace, refusals with their reasons, files against manifests, typed JSON."""

import datetime

import pytest
from pyspark.sql import functions as F

from cairn.operators import schemas
from cairn.sources import stores


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def runs(spark, *ids):
    return spark.createDataFrame([(i, {"k": "4"}) for i in ids], "run_id string, parameters map<string,string>")


def cases(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id string, case_id long, recall double")


def test_logging_a_run_twice_leaves_its_last_copy(spark, root):
    first = cases(spark, ("a", 1, 1.0), ("a", 2, 0.0), ("b", 1, 0.5))
    stores.log_runs(root, runs(spark, "a", "b"), first, first.where("recall < 1"), measures=["recall"])
    again = cases(spark, ("a", 1, 1.0), ("a", 2, 1.0))
    stores.log_runs(root, runs(spark, "a"), again, again.where("recall < 1"), measures=["recall"])  # no failures any more
    assert sorted((r.run_id, r.value) for r in stores.read_log(spark, root, "run_metrics").collect()) == [("a", 1.0), ("b", 0.5)]
    assert [(r.run_id, r.case_id) for r in stores.read_log(spark, root, "failure_rows").collect()] == [("b", 1)]
    assert sorted((r.run_id, r.parameters["k"]) for r in stores.read_log(spark, root).collect()) == [("a", "4"), ("b", "4")]


def test_runs_that_break_rules_are_refused(spark, root):
    bad = cases(spark, ("a", 1, 1.0), ("a", 1, 0.0), ("z", 1, 0.0))
    with pytest.raises(stores.Refused) as e:
        stores.log_runs(root, runs(spark, "a", "a", " ", "empty"), bad, bad, measures=["recall"])
    assert {r.split(":")[0] for r in e.value.reasons} == {"case twice", "no cases", "run twice", "run_id is blank", "unknown run"}


def test_an_index_loads_only_by_its_whole_identity(spark, root):
    v = spark.createDataFrame([(i, [3.0, 4.0 + i]) for i in range(20)], "id long, v array<double>")
    own = stores.index_identity(v, v, key="id", vector="v", columns=[], provider="p", model="m", chunking_strategy="c")
    with pytest.raises(stores.Refused, match="nothing is stored"):
        stores.load_index(spark, root, own, vector="v")
    stores.save_index(v, root, own, key="id", vector="v")
    back = {r.id: r.v for r in stores.load_index(spark, root, own, vector="v").collect()}
    assert back[0] == [0.6, 0.8] and len(back) == 20
    for field in stores.IDENTITY:
        with pytest.raises(stores.Refused, match=field):
            stores.load_index(spark, root, own | {field: "0"}, vector="v")
    other = v.where("id < 19")
    assert stores.index_mismatches(own, stores.index_identity(other, v, key="id", vector="v", columns=[], provider="p", model="m", chunking_strategy="c")) != []
    for bad in ([1.0], [0.0, 0.0], [float("nan"), 1.0], None):
        with pytest.raises(stores.Refused):
            stores.save_index(spark.createDataFrame([(1, bad)], "id long, v array<double>"), root, own, key="id", vector="v")
    assert len(stores.load_index(spark, root, own, vector="v").collect()) == 20  # a refused write leaves what was current


def test_index_files_that_lost_rows_are_refused(spark, root):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10)], "id long, v array<double>")
    own = stores.index_identity(v, v, key="id", vector="v", columns=[], provider="p", model="m", chunking_strategy="c")
    stores.put(v.where("id < 9"), root, "index", own)
    with pytest.raises(stores.Refused, match="9 vectors"):
        stores.load_index(spark, root, own, vector="v")


def test_publishing_and_vacuum(spark, root):
    for n in (1, 2, 3):
        stores.put(spark.range(n), root, "t", {"n": n})
    assert stores.get(spark, root, "t").count() == 3 and stores.current(spark, root, "t")[1] == {"n": 3}
    assert stores.vacuum(spark, root) == 2 and stores.get(spark, root, "t").count() == 3
    with pytest.raises(stores.Refused):
        stores.get(spark, root, "absent")


def test_upsert_replaces_whole_datasets_and_refuses_repeats(spark, root):
    rows = lambda *r: spark.createDataFrame(list(r), "d string, s long, v long")
    up = lambda df: stores.upsert(root, "t", df, by=["d"], key=["d", "s"])
    up(rows(("a", 1, 1), ("a", 2, 1), ("b", 1, 1)))
    up(rows(("a", 1, 2), ("c", 1, 2)))
    assert sorted(map(tuple, stores.get(spark, root, "t").collect())) == [("a", 1, 2), ("b", 1, 1), ("c", 1, 2)]
    with pytest.raises(stores.Refused):
        up(rows(("a", 1, 2), ("a", 1, 3)))
    assert stores.get(spark, root, "t").count() == 3


def test_files_against_a_manifest(spark, tmp_path):
    facts = spark.createDataFrame([(k, 5, "aa") for k in ("ok", "size", "hash", "none", "nohash")], "key string, byte_size long, sha256 string")
    manifest = spark.createDataFrame([("ok", 5, "AA"), ("size", 6, "aa"), ("hash", 5, "ab"), ("nohash", 5, None), ("lost", 5, "aa")], "key string, byte_size long, sha256 string")
    got = {r.key: r.status for r in stores.verify_files(facts, manifest).collect()}
    assert got == {"ok": "ok", "size": "size", "hash": "sha256", "none": "no_record", "nohash": "no_hash", "lost": "no_file"}
    for folder, names in (("a", ["x"]), ("b/c", ["x", "y"])):
        (tmp_path / folder).mkdir(parents=True)
        for name in names:
            (tmp_path / folder / name).write_bytes(b"abc")
    found = {r.key: (r.byte_size, r.files, r.sha256[:8]) for r in stores.file_facts(spark, f"file://{tmp_path}").collect()}
    assert found["a"] == (3, 1, "ba7816bf") and found["b/c"][:2] == (6, 2) and len(found) == 2


def test_canonical_json_sorts_keys_at_all_depths(spark):
    df = spark.range(1).select(stores.canonical_json(F.struct(F.lit(1).alias("z"), F.struct(F.lit("é").alias("y"), F.array(F.struct(F.lit(2.5).alias("d"), F.lit(True).alias("c"))).alias("a")).alias("b"))).alias("j"))
    assert df.first().j == '{"b":{"a":[{"c":true,"d":2.5}],"y":"é"},"z":1}'


def test_artifacts_keep_those_that_are_not_written_again(spark, root):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "art string, id long, t string")
    put = lambda r: stores.put_artifacts(r, root, artifact="art", key="id", columns=["id", "t"])
    facts = lambda: {r.artifact: (r.rows, r.bytes, r.sha256) for r in stores.get(spark, root, "artifacts_manifest").collect()}
    put(rows)
    before = facts()
    put(rows.where("art = 'a'").withColumn("t", F.lit("other")))
    after = facts()
    assert before["b"] == after["b"] and before["a"] != after["a"] and after["a"][0] == 2
    put(rows.where("art = 'a'").repartition(3))
    assert facts() == before


def test_market_snapshot(spark):
    day = datetime.date
    rows = [(1, 2.00005, day(2024, 1, 1)), (1, 3.14155, day(2024, 1, 2)), (1, None, day(2024, 1, 3)), (2, -1.0, day(2024, 1, 1)), (2, float("nan"), day(2024, 1, 1)), (3, 1.0, day(2024, 1, 1)), (3, 2.0, day(2024, 1, 1)), (4, 1.0, None)]
    got = {r.symbol: (r.close, r.state, r.date) for r in stores.market_snapshot(spark.createDataFrame(rows, "symbol long, close double, date date")).collect()}
    assert got == {1: (3.1416, "ok", day(2024, 1, 2)), 2: (None, "incomplete", None), 3: (None, "ambiguous", day(2024, 1, 1)), 4: (None, "incomplete", None)}


def rules(spark):
    return schemas.rules_of(
        spark, "s", ("$", "object", {"closed": True}), ("$.k", "integer", {"required": True, "minimum": 5, "maximum": 90}), ("$.tags", "array"), ("$.tags[]", "object", {"closed": True}),
        ("$.tags[].name", "string", {"required": True, "enum": ["a", "b"]}), ("$.x", "number"), ("$.b", "boolean"),
    )


def test_a_row_that_breaks_each_rule(spark):
    rows = {
        1: ('{"k":7,"x":2,"b":true,"tags":[{"name":"a"}]}', []),
        2: ('{"k":3.5}', [("$.k", "minimum"), ("$.k", "type")]),
        3: ('{"k":1,"z":2}', [("$", "additional:z"), ("$.k", "minimum")]),
        4: ("[]", [("$", "type")]),
        5: (None, [("$", "type")]),
        6: ('{"tags":[{"name":"c"},{"q":1},5],"k":91}', [("$.k", "maximum"), ("$.tags[0].name", "enum"), ("$.tags[1]", "additional:q"), ("$.tags[1]", "required:name"), ("$.tags[2]", "type")]),
        7: ('{"k":true,"x":4,"b":0}', [("$.b", "type"), ("$.k", "type")]),
        8: ('{"k":8,"x":"4","tags":{}}', [("$.tags", "type"), ("$.x", "type")]),
        9: ('{"x":1}', [("$", "required:k")]),
        10: ('{"k":null}', [("$.k", "type")]),
    }
    df = spark.createDataFrame([(i, "s", t) for i, (t, _) in rows.items()] + [(99, "other", "{}")], "id long, schema string, t string")
    found = schemas.violations(df.withColumn("value", F.try_parse_json("t")), rules(spark), "id").collect()
    got = {i: sorted((r.place, r.rule) for r in found if r.id == i) for i in (*rows, 99)}
    assert got == {i: want for i, (_, want) in rows.items()} | {99: [("$", "schema")]}
    assert schemas.violations(df.limit(0).withColumn("value", F.try_parse_json("t")), rules(spark), "id").count() == 0


def test_json_files_load_whole_or_not_at_all(spark, tmp_path):
    for name, text in (("a.json", '{"k":7,"tags":[{"name":"a"},{"name":"b"}]}'), ("b.json", '{"k":7,"tags":[{"name":"a"},{"name":"q"}]}'), ("c.json", '{"k":7,')):
        (tmp_path / name).write_text(text)
    records, rejects = stores.load_json(spark, f"file://{tmp_path}", rules(spark), items="tags", record="name string")
    assert sorted((r.file[-6:], r.ordinal, r.name) for r in records.collect()) == [("a.json", 0, "a"), ("a.json", 1, "b")]
    assert sorted((r.file[-6:], r.place, r.rule) for r in rejects.collect()) == [("b.json", "$.tags[1].name", "enum"), ("c.json", "$", "not_json")]


def test_names_that_are_there_twice(spark):
    rows = spark.createDataFrame([("A-1",), (" a-1 ",), ("a-2",)], "id string")
    assert [(r.key, r.n) for r in stores.repeated(rows, "id").collect()] == [("a-1", 2)]
