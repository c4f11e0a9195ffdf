import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandgraph import config, construct, qa
from strandgraph.functions.text import plain
from strandgraph.hooks import CannedModel, HashingEncoder, Retrying, encode, is_rate_limit
from strandgraph.sources import tables
from strandgraph.streaming import incremental


def _record(*triples):
    return json.dumps({"attributes": {t[0]: [f"kind: {t[0].lower()}"] for t in triples}, "triples": [list(t) for t in triples], "entity_types": {t[0]: "person" for t in triples}})


def test_from_corpus(spark):
    docs = spark.createDataFrame([(0, "T", "Ann met Bob"), (1, "U", "Bob met Cid"), (2, "V", "broken")], "doc_id long, title string, text string")
    model = CannedModel((("Ann", _record(("Ann", "met", "Bob"))), ("Cid", "```json\n" + _record(("Bob", "met", "Cid"), ("Bob", "met", "Cid")) + "\n```")), "no json")
    out = construct.from_corpus(docs, "demo", model, HashingEncoder(16), config.EngineConfig().override({"grouping": {"clusters": 2, "rounds": 3, "least_members": 1}}))
    names = {r["name"]: r["label"] for r in out["nodes"].filter("level < 4").collect()}
    assert names == {"Ann": "entity", "Bob": "entity", "Cid": "entity", "kind: ann": "attribute", "kind: bob": "attribute"}
    assert out["edges"].filter("relation = 'met'").count() == 2
    assert out["vectors"].count() == 2  # the third name is too short to embed alone
    assert out["groups"].select("node_id").distinct().count() == 3


def test_decompose_and_answer(spark):
    q = spark.createDataFrame([("q1", "Who and where?"), ("q2", "When?")], "question_id string, question string")
    subs = qa.decompose(q, CannedModel((("Who", '[{"sub-question": "Who?"}, {"sub-question": "Where?"}]'),), "??"))
    assert sorted(tuple(r) for r in subs.collect()) == [("q1", 0, "Who?"), ("q1", 1, "Where?"), ("q2", 0, "When?")]
    ctx = lambda d: d.select("query_id", F.concat(F.lit("ctx "), "query").alias("context"))
    got = qa.answer_steps(subs, ctx, CannedModel((("ctx Ann, Where?", "here"), ("Who?", "Ann")), "none"))
    assert {(r["question_id"], r["step"]): r["reply"] for r in got.collect()} == {("q1", 0): "Ann", ("q1", 1): "here", ("q2", 0): "none"}


def test_reflection_is_bounded(spark):
    q = spark.createDataFrame([("a", "one"), ("b", "same"), ("c", "last")], "question_id string, question string")
    model = CannedModel((("one", "The new query is: two"), ("two", "So the answer is: 42"), ("same", "The new query is: same"), ("last", "So the answer is: yes")))
    ctx = lambda d: d.select("query_id", F.lit("").alias("context"))
    got = {r["question_id"]: (r["answer"], r["steps"]) for r in qa.reflect(q, ctx, model, 3).collect()}
    assert got == {"a": ("42", 1), "b": ("The new query is: same", 0), "c": ("yes", 0)}


def test_judge(spark):
    r = spark.createDataFrame([("a", "q", "Bob", "It is bob."), ("b", "q", "Ann", None)], "question_id string, question string, gold string, answer string")
    assert {x["question_id"]: x["correct"] for x in qa.judge(r).collect()} == {"a": 1, "b": 0}


def test_encoder_failures_are_alone(spark):
    class Picky:
        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad")
            return HashingEncoder(8)(texts)

    rows = encode(spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id int, text string"), Picky()).collect()
    assert {r["id"]: r["embedding"] is None for r in rows} == {1: False, 2: True, 3: False}


def test_retrying():
    calls = []

    def model(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("429 too many requests")
        return "ok"

    assert Retrying(model, tries=5, pause=0)("x") == "ok"
    assert is_rate_limit("Rate limit reached") and not is_rate_limit("broken pipe")
    assert is_rate_limit("TPM: 500") and is_rate_limit("Request limit exceeded")


def test_values_become_plain():
    got = plain({"a": np.int64(3), 2: {"x", "y"}, "v": np.ones(2), "o": Path("p"), "n": None, "t": (True, 1.5)})
    assert json.loads(json.dumps(got)) == {"a": 3, "2": ["x", "y"], "v": [1.0, 1.0], "o": "p", "n": None, "t": [True, 1.5]}


def test_batches_extract_each_chunk_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, "", f"text {i}") for i in range(9)], "doc_id long, title string, text string")
    reply = json.dumps({"attributes": {}, "triples": [["a", "knows", "b"]], "entity_types": {}})
    settings = config.EngineConfig().override({"construction": {"batched": True, "batch_size": 3}})
    path = f"file://{tmp_path}/cp"
    first = construct.from_corpus(docs, "demo", CannedModel((), reply), HashingEncoder(16), settings, path)
    again = construct.from_corpus(docs, "demo", CannedModel((), "not asked again"), HashingEncoder(16), settings, path)
    for got in (first, again):
        assert sorted(r["name"] for r in got["nodes"].filter("level < 4").collect()) == ["a", "b"]
        assert got["nodes"].filter("level = 4").count() == got["groups"].select("subgraph_id").distinct().count()
    assert tables.exists(spark, f"{path}/of=3/batch=2/_SUCCESS")


def test_mixture_and_hub_cache(spark, tmp_path):
    groups = spark.createDataFrame([("Shared_A", "shared", "a"), ("Expert_1", "expert", "a"), ("Expert_1", "expert", "b")], "subgraph_id string, kind string, node_id string")
    tables.write_mixture(groups, f"file://{tmp_path}/m")
    assert sorted(map(tuple, tables.read_mixture(spark, f"file://{tmp_path}/m").collect())) == sorted(map(tuple, groups.collect()))
    (tmp_path / "g.json").write_text(json.dumps({"relationships": [], "metadata": {"total_nodes": 3, "total_edges": 1, "dataset_name": "demo"}}))
    assert tables.read_metadata(spark, f"file://{tmp_path}/g.json")["total_nodes"] == 3
    assert tables.read_mixture(spark, f"file://{tmp_path}/g.json").count() == 0
    vec = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "node_id string, embedding array<float>")
    tables.write_group_index(groups, vec, f"file://{tmp_path}/i")
    tables.clear_vectors(spark, f"file://{tmp_path}/i", hubs_only=True)
    assert {r[0] for r in spark.read.parquet(f"file://{tmp_path}/i").select("subgraph_id").collect()} == {"Expert_1"}


def test_ask_in_steps(spark):
    questions = spark.createDataFrame([("q1", "who?")], "question_id string, question string")
    model = CannedModel((("Decompose", '["first", "second"]'), ("second", "So the answer is: yes")), "maybe")
    search = lambda q: q.select("query_id", F.lit("").alias("context"))
    got = qa.answered(qa.answer_steps(qa.decompose(questions, model), search, model)).first()
    assert (got["answer"], got["steps"]) == ("yes", 2)
    assert config.EngineConfig().override(config.parse_mode("decompose")).retrieval.decompose


def test_config(tmp_path):
    c = config.EngineConfig().override({"retrieval": {"top_k": 3}, "datasets": {"demo": {"corpus": "c.json"}}})
    config.save_config(c, tmp_path / "a" / "c.yaml")
    assert config.load_config(tmp_path / "a" / "c.yaml") == c
    assert c.override(config.parse_mode("reflect-3_all-experts")).retrieval == config.Retrieval(top_k=3, max_experts=None, reflection_steps=3)
    with pytest.raises(ValueError, match="demo2"):
        c.dataset("demo2")
    with pytest.raises(ValueError, match="no nonsense"):
        c.override({"retrieval": {"nonsense": 1}})


def test_sources(spark, tmp_path):
    p = tmp_path / "corpus.json"
    p.write_text(json.dumps([{"title": "A", "text": "x"}, {"title": "B", "text": "y\nz"}]))
    docs = tables.read_corpus(spark, f"file://{p}")
    assert sorted((r["title"], r["text"]) for r in docs.collect()) == [("A", "x"), ("B", "y\nz")]
    c = tmp_path / "chunks.txt"
    c.write_text("id: a\tChunk: one\twith tab\njunk\nid: a\tChunk: two\n")
    assert [tuple(r) for r in tables.read_chunk_file(spark, f"file://{c}").collect()] == [("a", "two")]
    assert tables.is_fresh(spark, f"file://{p}", f"file://{c}") and not tables.is_fresh(spark, f"file://{p}", f"file://{tmp_path}/none")
    assert tables.read_ontology(spark, f"file://{tmp_path}/none.json") == {}
    assert tables.merge_ontology({"Nodes": ["a"]}, {"Nodes": ["b", "a"]})["Nodes"] == ["a", "b"]
    first = spark.createDataFrame([("a", "1"), ("b", "1")], "chunk_id string, chunk_text string")
    tables.write_chunks(spark, first, f"file://{tmp_path}/ch")
    got = tables.write_chunks(spark, spark.createDataFrame([("b", "2")], first.schema), f"file://{tmp_path}/ch")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "1"), ("b", "2")]
    r = tmp_path / "res.jsonl"
    r.write_text('{"question_id": "q1", "correct": 1}\n\n{broken\n{"type": "summary", "question_id": "x"}\n')
    assert [x["question_id"] for x in tables.read_results(spark, f"file://{r}").collect()] == ["q1"]
    with pytest.raises(FileNotFoundError):
        tables.read_graph(spark, f"file://{tmp_path}/nothing")


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A", "entity", 2, "c"), ("b", "B", "entity", 2, None), ("z", "Z", "entity", 2, None)], "node_id string, name string, label string, level int, chunk_id string")
    edges = spark.createDataFrame([("a", "b", "r"), ("a", "b", "s")], "src string, dst string, relation string")
    tables.write_graph(nodes, edges, f"file://{tmp_path}/g", as_json=True)
    n, e = tables.read_graph_json(spark, f"file://{tmp_path}/g/relationships")
    assert sorted(r["node_id"] for r in n.collect()) == ["a", "b"]
    assert e.count() == 2
    tables.write_graph(nodes, edges, f"file://{tmp_path}/h")
    assert tables.read_graph(spark, f"file://{tmp_path}/h")[0].count() == 3
    groups = spark.createDataFrame([("Shared_A", "a"), ("Shared_A", "b")], "subgraph_id string, node_id string")
    vec = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "node_id string, embedding array<float>")
    tables.write_group_index(groups, vec, f"file://{tmp_path}/i")
    assert tables.read_group_index(spark, groups, f"file://{tmp_path}/i").count() == 2
    assert tables.read_group_index(spark, groups.filter("node_id = 'a'"), f"file://{tmp_path}/i").count() == 0
    assert tables.graph_metadata(nodes, edges, 1.5).first()["total_edges"] == 2


def test_batches_are_not_done_twice(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "src string, dst string, relation string"

    def run():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        incremental.run_batches(s, lambda df, n: incremental.merge_batch(spark, df, n, out), f"file://{tmp_path}/cp")

    spark.createDataFrame([("a", "b", "r")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([("a", "b", "r"), ("b", "c", "r")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert incremental.graph_of(spark, out).count() == 2
    tables.keep_latest_batches(spark, out, 1)
    assert spark.read.parquet(out).select("batch").distinct().count() == 1


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_command_line(spark, tmp_path, monkeypatch):
    from strandgraph import __main__ as cli

    (tmp_path / "corpus.json").write_text(json.dumps([{"title": "T", "text": "Ann met Bob"}]))
    (tmp_path / "qa.json").write_text(json.dumps([{"question": "Who met Bob?", "answer": "Ann"}]))
    c = config.EngineConfig().override({"output": f"file://{tmp_path}/out", "grouping": {"clusters": 1, "rounds": 1, "least_members": 1}, "datasets": {"demo": {"corpus": f"file://{tmp_path}/corpus.json", "questions": f"file://{tmp_path}/qa.json"}}})
    config.save_config(c, tmp_path / "c.yaml")
    model = CannedModel((("Who met", "So the answer is: Ann"), ("Ann", _record(("Ann", "met", "Bob")))), "0")
    monkeypatch.setattr(cli, "_hook", lambda name, default: model if name == "m" else default)
    cli.main(["build", "demo", "--config", str(tmp_path / "c.yaml"), "--model", "m"])
    cli.main(["ask", "demo", "--config", str(tmp_path / "c.yaml"), "--model", "m"])
    cli.main(["ask", "demo", "--config", str(tmp_path / "c.yaml"), "--model", "m"])  # nothing is left to ask
    got = tables.read_results(spark, f"file://{tmp_path}/out/demo/results").collect()
    assert [(r["question_id"], r["generated_answer"]) for r in got] == [("demo_0", "Ann")]
