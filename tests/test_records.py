import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from curatrix.operators import batch, context, entities, generation, proposals
from curatrix.operators.entities import Reference
from curatrix.sources import audit, stores

SPECS = [Reference("work", "author", "person"), Reference("work", "tags", "person", array=True), Reference("show", "credits", "person", array=True, inner="person")]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "person": spark.createDataFrame([(1, "Ann"), (2, "Bo"), (3, "Cy")], "id long, name string"),
        "work": spark.createDataFrame([(10, "1", [1, 2]), (11, "2", [3, None]), (12, None, None)], "id long, author string, tags array<long>"),
        "show": spark.createDataFrame([(20, [(1, "lead"), (2, "extra")]), (21, [(1, "lead")])], "id long, credits array<struct<person:long,role:string>>"),
    }


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_find_references(spark, tables):
    one = spark.createDataFrame([(1,)], "id long")
    assert ids(entities.find_references(SPECS, tables, "person", one), "source", "field", "source_id") == [("show", "credits", "20"), ("show", "credits", "21"), ("work", "author", "10"), ("work", "tags", "10")]
    assert entities.find_references(SPECS, tables, "planet", one).count() == 0
    assert entities.pointing_at(SPECS, "person") == SPECS


@pytest.mark.parametrize("conflict, credits", [("drop", [(2, "extra")]), ("keep_both", [(2, "lead"), (2, "extra")])])
def test_merge(spark, tables, conflict, credits):
    specs = [*SPECS[:2], Reference("show", "credits", "person", array=True, inner="person", on_conflict=conflict)]
    out, log = entities.merge(specs, tables, "person", spark.createDataFrame([(1, 2)], "source_id long, target_id long"))
    assert ids(out["person"], "id") == [(2,), (3,)]
    assert {r.id: (r.author, r.tags) for r in out["work"].collect()} == {10: ("2", [2]), 11: ("2", [3, None]), 12: (None, None)}
    shows = {r.id: [tuple(c) for c in r.credits] for r in out["show"].collect()}
    assert shows == {20: credits, 21: [(2, "lead")]}
    assert ids(log, "source", "id", "action") == [("person", "1", "merged"), ("show", "20", "relinked"), ("show", "21", "relinked"), ("work", "10", "relinked")]
    assert {c: out[c].columns for c in out} == {c: tables[c].columns for c in tables}


def test_merge_chains_and_guards(spark, tables):
    pair = lambda *r: spark.createDataFrame(list(r), "source_id long, target_id long")
    out, _ = entities.merge(SPECS, tables, "person", pair((1, 2), (2, 3)))
    assert ids(out["person"], "id") == [(3,)] and out["work"].where("id = 10").first().author == "3"
    for wrong in (pair((1, 1)), pair((1, 2), (2, 1))):
        with pytest.raises(ValueError):
            entities.merge(SPECS, tables, "person", wrong)
    with pytest.raises(ValueError, match="target"):
        entities.merge(SPECS, tables, "person", pair((1, 99)))


def test_delete(spark, tables):
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    with pytest.raises(ValueError, match="show/20.credits"):
        entities.delete(SPECS, tables, "person", one(1))
    assert entities.delete(SPECS, tables, "person", one(1), force=True).count() == 2
    assert entities.delete(SPECS, tables, "person", one(99)).count() == 3


def test_vetoes(spark):
    side = "struct<name:string,born:int,references:string>"
    rows = [(1, 2, ("Ann X", 1900, "9"), ("Bob X", 1900, "1")), (3, 4, ("Ann", 1900, "9"), ("ann", 1901, "1")), (5, 6, ("Ann", None, "9"), ("", 1900, "2")), (7, 8, ("Ann", 1900, "2"), ("Abe", 1900, "2")), (9, 10, ("Ann", 1900, "many"), (None, 1900, "2"))]
    df = spark.createDataFrame(rows, f"id_a long, id_b long, a {side}, b {side}")
    gates = [entities.exact_field("born"), entities.initial_match("name"), entities.gender_check("name", ["Bob", "Abe"], ["Ann"]), entities.reference_ratio()]
    got = {r.id_a: (r.accepted, r.reason) for r in entities.vetoed(df, gates).collect()}
    assert got[1] == (False, "initial_match: name starts differently") and got[3] == (False, "exact_field: born differs: 1900 / 1901")
    assert got[5] == (True, None) and got[7] == (False, "gender_check: first names of different gender") and got[9] == (True, None)
    listed = spark.createDataFrame([(6, 5)], "id_a long, id_b long")
    assert entities.vetoed(df, gates, listed).where("id_a = 5").first().reason.startswith("excluded")
    assert entities.vetoed(df, []).where("accepted").count() == 5
    assert entities.vetoed(df, [entities.no_conflict("born")]).where("id_a = 3").first().reason.startswith("no_conflict")


def test_rules(spark, tables):
    df = spark.createDataFrame([(1, "", "x"), (2, None, "y"), (3, "0", None)], "id long, name string, kind string")
    assert ids(entities.required_field(df, "p", "name"), "id") == [("1",), ("2",)]
    assert ids(entities.valid_values(df, "p", "kind", ["x"]), "id", "message") == [("2", "kind is y, not one of x")]
    assert ids(entities.conditional_required(df, "p", F.col("kind") == "x", "name", "kind is x", "warning"), "id", "severity") == [("1", "warning")]
    lost = spark.createDataFrame([(1, [7, 7, 1])], "id long, tags array<long>")
    assert ids(entities.reference_exists(lost, SPECS[1], tables["person"]), "message") == [("tags refers to person/7",)] * 2
    orphans = entities.no_orphans(tables["person"], "person", SPECS, tables)
    assert ids(orphans, "id") == [] and entities.no_orphans(tables["work"], "work", SPECS, tables).count() == 3
    r = entities.validation_summary(entities.required_field(df, "p", "name").union(entities.required_field(df, "p", "kind", "warning"))).first()
    assert tuple(r) == (2, 1, False)
    assert tuple(entities.validation_summary(orphans).first()) == (0, 0, True)


def test_proposals(spark):
    before = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "id long, name string, n int")
    after = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "x", None)], "id long, name string, n int")
    p = proposals.create_modify(before, after, "thing", ["name", "n"]).cache()
    got = {r.refs[0]: [tuple(c) for c in r.changes] for r in p.collect()}
    assert got == {"thing/2": [("n", None, "2")], "thing/3": [("name", "c", "x"), ("n", "3", None)]}
    key = p.where("refs[0] = 'thing/2'").select("proposal_id")
    approved = proposals.move(p, key, "approve", "fine")
    assert ids(approved, "status") == [("approved",), ("pending",)] and proposals.listed(approved, "approved").first().note == "fine"
    assert ids(proposals.move(approved, key, "mark_applied"), "status") == [("applied",), ("pending",)]
    for action, table in (("mark_applied", p), ("reject", approved)):
        with pytest.raises(LookupError):
            proposals.move(table, key, action)
    m = proposals.create_merge(spark.createDataFrame([("a/1", "a/2")], "source string, target string")).first()
    assert (m.title, m.category) == ("Merge a 1 into 2", "merge") and m.name.endswith("_merge_a_1_into_2")
    with pytest.raises(Exception, match="one type"):
        proposals.create_merge(spark.createDataFrame([("a/1", "b/2")], "source string, target string")).collect()
    d = proposals.create_delete(spark.createDataFrame([("a/1",)], "ref string"))
    assert d.first().title == "Delete a 1" and "note" not in json.loads(proposals.as_json(d).first().json)


# Batches


def items(spark, n):
    return spark.createDataFrame([(i, 4.0) for i in range(1, n + 1)], "id long, price double")


def pay(pdf):
    return pd.DataFrame({"item_id": pdf.id.astype(str), "status": "done", "cost": pdf.price})


def test_state_is_a_fold(spark):
    rows = [("a", 2, "done", 1.0, {"k": "new"}), ("a", 1, "open", 2.0, {"k": "old", "j": "x"}), ("b", 1, "open", None, None)]
    got = {r.item_id: (r.status, r.cost, r.metadata) for r in batch.state(spark.createDataFrame(rows, batch.EVENT)).collect()}
    assert got == {"a": ("done", 3.0, {"k": "new", "j": "x"}), "b": ("open", 0.0, {})}


@pytest.mark.parametrize("step", [2, 3, 50_000])
def test_running_sums(spark, step):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 41)], "id long, cost double").repartition(7)
    got = {r.id: r.s for r in batch.cumulative(df, "cost", [F.col("id")], "s", step).collect()}
    assert got == {i: i * (i + 1) / 2 for i in range(1, 41)}
    assert batch.cumulative(df.where("false"), "cost", [F.col("id")], "s").count() == 0


def test_budget_cut_is_a_prefix(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 4.0), (3, 4.0), (4, 1.0), (5, None)], "id long, cost double")
    cut = batch.budget_cut(df, 10.0, [F.col("id")])
    assert [r.committed for r in cut.orderBy("id").collect()] == [True, True, False, False, False]
    assert [r.committed for r in batch.budget_cut(df, 10.0, [F.col("id")], spent=6.0).orderBy("id").collect()][:2] == [True, False]


def test_run_resumes_and_stops(spark):
    none = spark.createDataFrame([], batch.EVENT)
    first = batch.run_batch(items(spark, 5), none, pay, budget=10.0, wave=2)
    assert ids(first, "item_id") == [("1",), ("2",)]
    again = batch.run_batch(items(spark, 5), first, pay, budget=100.0)
    assert ids(again, "item_id", "seq") == [("3", 2), ("4", 2), ("5", 2)]
    assert batch.run_batch(items(spark, 5), first.union(again), pay).count() == 0
    assert batch.run_batch(items(spark, 5), first, pay, budget=8.0).count() == 0


def test_a_failing_batch_marks_its_items(spark):
    def broken(pdf):
        raise RuntimeError("no luck")

    got = batch.run_batch(items(spark, 2), spark.createDataFrame([], batch.EVENT), broken).collect()
    assert [(r.status, r.metadata) for r in got] == [("error", {"error": "no luck"})] * 2


def test_tiers(spark):
    def quick(pdf):
        return pd.DataFrame({"item_id": pdf.id.astype(str), "status": ["flagged" if i % 2 else "verified" for i in pdf.id], "cost": 1.0, "findings": [["x"]] * len(pdf)})

    out = batch.run_tiers(items(spark, 4), [("quick", quick), ("deep", pay)])
    assert ids(out, "item_id", "tier", "status") == [("1", "deep", "done"), ("1", "quick", "needs_review"), ("2", "quick", "done"), ("3", "deep", "done"), ("3", "quick", "needs_review"), ("4", "quick", "done")]
    counts, totals = batch.tier_status(out, items(spark, 5))
    assert tuple(totals.first()) == (12.0, 1)
    assert ids(batch.status_line(counts), "tier", "summary") == [("deep", "done=2"), ("quick", "done=2, needs_review=2")]
    assert set(ids(batch.run_tiers(items(spark, 4), [("quick", quick), ("deep", pay)], budget=4.0), "tier")) == {("quick",)}
    assert batch.run_tiers(items(spark, 4), [("quick", quick), ("deep", pay)], budget=8.5).where("tier = 'deep'").count() == 1


def test_small_functions(spark):
    df = spark.createDataFrame([(1,), (20,), (1_000,)], "n int")
    assert [r[0] for r in df.select(batch.timeout_for(F.col("n"))).collect()] == [30, 600, 1800]
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, input double, output double")
    calls = spark.createDataFrame([("m", 1_000_000, 500_000), ("?", 5, 5)], "model string, input_tokens long, output_tokens long")
    assert [r.cost for r in batch.model_cost(calls, prices).orderBy("cost").collect()] == [0.0, 4.0]
    assert ids(batch.pending(items(spark, 3), spark.createDataFrame([("2", "done"), ("3", "error")], "item_id string, status string")), "id") == [(1,), (3,)]


# Audit logs and stores


def test_audit_round_trip(spark, tmp_path):
    entry = "ts string, item_id string, action string, details struct<status:string,type:string,operations:array<struct<type:string,ids:array<bigint>,field:string,_ts:string>>>, cost double, tier string"
    op = lambda t, i, ts=None: (t, [i], "f", ts)
    rows = [("2024-01-01T00:00:00", "a", "fix", (None, None, [op("merge", 1), op("delete", 2)]), 1.5, ""), ("2024-01-02T00:00:00", "a", "fix", ("error", None, [op("merge", 1)]), 0.5, "t"), ("2024-01-02T00:00:00", "b", "error", None, None, "t"), (None, "c", "note", (None, "typed", []), None, None)]
    audit.append(spark.createDataFrame(rows, entry), str(tmp_path / "log"))
    (tmp_path / "log" / "dt=20240101" / "zz.json").write_text("\nnot json\n")
    log = audit.read(spark, str(tmp_path / "log"))
    assert log.count() == 4 and audit.read(spark, str(tmp_path / "log"), since="2024-01-02").count() == 3
    ops = audit.operations(log)
    assert sorted(r.type for r in ops.collect()) == ["delete", "error", "merge", "merge", "typed"]
    last = audit.operations(log, ["merge"], F.concat_ws("-", F.col("type"), F.col("ids")[0].cast("string")))
    assert [r.ts for r in last.collect()] == ["2024-01-02T00:00:00"]
    assert {r.type: r.n for r in audit.operations_by_type(ops).collect()} == {"merge": 2, "delete": 1, "error": 1, "typed": 1}
    s = {(r.scope, r.value): (r.entries, r["items"], r.errors, r.cost) for r in audit.summary(log).collect()}
    assert s["all", ""] == (4, 3, 2, 2.0) and s["tier", "unknown"] == (2, 2, 0, 1.5) and s["action", "fix"] == (2, 1, 1, 2.0)


def test_stores(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "path string, mtime double")
    chunks = spark.createDataFrame([("a", "old a"), ("b", "old b")], "doc_path string, content string")
    new = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "path string, mtime double")
    newc = spark.createDataFrame([("a", "new a"), ("b", "new b"), ("c", "new c")], "doc_path string, content string")
    d, c = stores.add_documents(docs, chunks, new, newc)
    assert ids(d, "path", "mtime") == [("a", 1.0), ("b", 2.0), ("c", 1.0)] and ids(c, "content") == [("new b",), ("new c",), ("old a",)]
    claims = spark.createDataFrame([("1", "x")], "id string, content string")
    twice = stores.add_claims(stores.add_claims(c, claims), claims.withColumn("content", F.lit("y")))
    assert ids(twice.where("doc_path like 'claim:%'"), "doc_path", "content") == [("claim:1", "y")]
    versions = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 5, "c")], "key string, v int, x string")
    assert ids(stores.latest(versions, "key", "v"), "x") == [("b",), ("c",)]
    assert ids(stores.upsert(versions.where("key = 'j'"), versions, "key", "v"), "x") == [("b",), ("c",)]
    full = spark.createDataFrame([(1, "p", "c1", [3.0, 4.0]), (2, "p", "c2", None), (3, "q", "c1", [0.0, 0.0])], "id long, doc_path string, collection string, embedding array<float>")
    r = stores.index_stats(full).first()
    assert tuple(r) == (3, 2, ["c1", "c2"], 2)
    assert ids(stores.vectors_of(full, "c1"), "id", "vec") == [(1, [0.6, 0.8]), (3, [0.0, 0.0])]


def test_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "p1.yaml").write_text("name: Ann\nage: 3\nextra: 1\n")
    (tmp_path / "p2.yaml").write_text("name: [broken\n")
    got = stores.read_entities(spark, str(tmp_path), "name string, age bigint").collect()
    assert [(r.name, r.age) for r in got] == [("Ann", 3)]


def test_json_files(spark, tmp_path):
    node = {"id": "a", "title": "A", "prerequisites": ["b"], "obscurity": 2}
    for name, data in (("one.json", {"nodes": [node]}), ("two.json", [node])):
        (tmp_path / name).write_text(json.dumps(data, indent=1))
        r = stores.read_graph(spark, str(tmp_path / name)).first()
        assert (r.id, r.prerequisites, r.level) == ("a", ["b"], None)
    (tmp_path / "state.json").write_text(json.dumps({"productions": {"x": {"status": "done", "cost": 1.5}, "y": {}}}))
    assert ids(stores.read_old_state(spark, str(tmp_path / "state.json")), "item_id", "status", "cost") == [("x", "done", 1.5), ("y", "pending", 0.0)]
    times = stores.file_times(spark, str(tmp_path), "*.json")
    assert times.count() == 3
    assert stores.stale(times, times.withColumn("mtime", F.when(F.col("path").endswith("one.json"), 0.0).otherwise(F.col("mtime")))).count() == 1


def test_contexts(spark):
    df = spark.createDataFrame([("c", 2, "b", None), ("c", 1, "a", "x")], "conv string, turn int, name string, note string")
    one = context.markdown(context.section("Item", context.fields(["name", "note"])), context.section("None", F.array().cast("array<string>")))
    assert context.batch_markdown(df, one, "turn", ["conv"]).first().context == "## Item\n- name: a\n- note: x\n\n---\n\n## Item\n- name: b"
    assert json.loads(context.batch_json(df, ["name"], "turn", ["conv"]).first().context) == [{"name": "a"}, {"name": "b"}]


# Generation


def test_generation(spark):
    def client(prompts, model):
        return [("{}" if model == "spare" else ("oops" if "bad" in p else '{"x": 1}'), len(p), 2) for p in prompts]

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id long, prompt string")
    got = {r.id: (r.text, r.model, r.input_tokens, r.parsed) for r in generation.generated(df, client, "main", "spare", "struct<x:int>", wait=0).collect()}
    assert got[1][:3] == ('{"x": 1}', "main", 4) and got[1][3].x == 1 and got[2][:2] == ("{}", "spare") and got[3][:3] == (None, "main", 0)


def test_retries():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("503 unavailable")
        return ["ok"]

    assert generation.with_retries(flaky, wait=0) == ["ok"] and len(tries) == 3
    with pytest.raises(ValueError):
        generation.with_retries(lambda: (_ for _ in ()).throw(ValueError("bad key")), wait=0)
    assert generation.plain_schema({"type": ["null", "integer"], "items": [{"type": ["string", "null"]}]}) == {"type": "integer", "items": [{"type": "string"}]}


def test_listed_rows_exclude_as_their_pairs_do(spark, small):
    """A flag of each row gives what a list of all pairs gives; the query joins no pairs."""
    df = spark.createDataFrame([(i, j, (i % 2 == 0, str(i)), (j % 2 == 0, str(j))) for i in range(6) for j in range(i + 1, 6)], "id_a long, id_b long, a struct<debt:boolean,code:string>, b struct<debt:boolean,code:string>")
    listed = df.where("a.debt and b.debt").selectExpr("id_b as id_a", "id_a as id_b")
    gates = [entities.initial_match("code")]
    got = entities.vetoed(df, [entities.both_listed("debt"), *gates])
    assert sorted(got.collect()) == sorted(entities.vetoed(df, gates, listed).collect()) and got.where("reason like 'excluded%'").count() == 3
    from curatrix.plans import catalog

    plan = catalog.queries()["exclusion_pairs"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
