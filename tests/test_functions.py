import json

import pytest
from pyspark.sql import functions as F

from strandgraph.functions import text as tx
from strandgraph.functions import vectors as vx


def _one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_vectors(spark):
    a, b = vx.literal([3.0, 4.0]), vx.literal([4.0, 3.0])
    assert _one(spark, vx.dot(a, b)) == 24.0
    assert _one(spark, vx.norm(a)) == 5.0
    assert _one(spark, vx.cosine(a, b)) == pytest.approx(0.96)
    assert _one(spark, vx.l2_squared(a, b)) == 2.0
    assert _one(spark, vx.normalise(a)) == [0.6, 0.8]


@pytest.mark.parametrize(("said", "want"), [("a@b{c}", "abc"), ("  ", "[EMPTY_TEXT]"), ("@#", "[EMPTY_AFTER_CLEANING]"), ("é (ok)!", "é (ok)!")])
def test_clean_text(spark, said, want):
    assert _one(spark, tx.clean_text(F.lit(said))) == want


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('```json\n{"triples": [["a", "b", "c"]]}\n```', [["a", "b", "c"]]),
        ('{"triples": [["a", "b", "c"], ["d", "e"', [["a", "b", "c"], ["d", "e"]]),
        ('Here: {"triples": [["a", "b", "c"]]} bye', [["a", "b", "c"]]),
        ("[1, 2]", None),
        ("nothing", None),
        (None, None),
    ],
)
def test_parse_record(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "reply string")
    assert df.select(tx.parse_record(F.col("reply")).alias("r")).select("r.triples").first()[0] == want


def test_repair_survives_any_cut():
    whole = json.dumps({"a": ["x, \"y\"", "z"], "b": {"c": "d}"}})
    for n in range(len(whole) + 1):
        assert isinstance(json.loads(tx._repaired(whole[:n])), dict)


def test_small_ones(spark):
    assert _one(spark, tx.stringify(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))) == "a: 1, b: 2"
    assert _one(spark, tx.token_count(F.lit(" a  b\nc "))) == 3
    assert _one(spark, tx.token_count(F.lit(""))) == 0
    assert len(_one(spark, tx.short_id(F.lit("x")))) == 32
    assert _one(spark, tx.nodes_hash(F.array(F.lit("b"), F.lit("a")))) == _one(spark, tx.nodes_hash(F.array(F.lit("a"), F.lit("b"))))
