import json

import pytest
from pyspark.sql import functions as F

from parapheur.operators import shred


def found(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "record_id BIGINT, payload STRING")
    return sorted(tuple(r) for r in shred.kie_found(df).collect())


def test_objects_arrays_and_strings_that_hold_json(spark):
    detail = {"selected": "x", "candidates": [{"value": "a"}, None, {"value": "b"}]}
    pages = [{"tables": {"table_index": 1}, "field_details": {"objet": detail, "date": None}}, None, {"field_details": [{"field": "pj", "candidates": {"value": "c"}}, None]}]
    expected = [
        ("candidate", 0, "objet", 0), ("candidate", 0, "objet", 2), ("candidate", 2, "pj", 0), ("detail", 0, "objet", -1), ("detail", 2, "pj", -1),
        ("page", 0, "", -1), ("page", 2, "", -1), ("tbl", 0, "", 0),
    ]
    for form in (pages, json.dumps(pages), json.dumps(json.dumps(pages))):
        assert found(spark, [json.dumps({"pages": form})]) == [(0, *e) for e in expected]


@pytest.mark.parametrize("payload", [None, "", "null", "[1, 2]", '{"pages": [{"page_number": 1}, {"page', '{"pages": NaN}', "{}", '{"pages": null}', '{"debug": {"pages": [{}]}}', '{"pages": ["text", 3, true]}'])
def test_payloads_without_objects(spark, payload):
    assert found(spark, [payload]) == []


def test_children_lead_to_their_parents(spark):
    payload = json.dumps({"pages": [{"page_number": 7, "field_details": {"a": {"candidates": [{"value": "v", "score": 0.5}]}}}]})
    df = spark.createDataFrame([(1, payload, "kept out")], "record_id BIGINT, payload STRING, node STRING")
    e = shred.kie_entities(shred.kie_nodes(df))
    page, detail, candidate = (e[n].collect()[0] for n in ("pages", "details", "candidates"))
    assert page.page_number == "7" and detail.page_node == page.page_node and candidate.detail_node == detail.detail_node
    assert (candidate.field_name, candidate.cand_value, candidate.score) == ("a", "v", "0.5")


def test_deep_nesting_and_long_payloads(spark):
    deep = "{}"
    for _ in range(400):
        deep = '{"x": ' + deep + "}"
    long = json.dumps({"pages": [{"page_number": i} for i in range(5000)]})
    rows = found(spark, ['{"pages": ' + deep + "}", long])
    assert len(rows) == 5001 and rows[0] == (0, "page", 0, "", -1)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_all_scalars_of_an_object_survive(spark):
    obj = {"a": 1, "b": "x", "c": None, "d": 1.5, "e": True, "f": ""}
    df = spark.createDataFrame([(1, json.dumps({"pages": [obj]}))], "record_id BIGINT, payload STRING")
    nodes = shred.kie_nodes(df).where("kind = 'scalar'")
    assert {r.label: r.scalar for r in nodes.collect()} == {"a": "1", "b": "x", "d": "1.5", "e": "true", "f": ""}
    assert nodes.where(F.col("parent") != 1).isEmpty()


def test_selected_values_lead_to_their_first_candidate(spark):
    details = {"a": {"selected": "v", "candidates": [{"value": "u", "strategy": "regex"}, {"value": "v", "strategy": "heuristic"}, {"value": "v", "strategy": "fuzzy"}]}, "b": {"selected": "x"}, "c": {"selected": None}}
    df = spark.createDataFrame([(1, json.dumps({"pages": [{"field_details": details}]}))], "record_id BIGINT, payload STRING")
    out = {r.field_name: (r.origin, r.item_pos) for r in shred.selected_origins(shred.kie_entities(shred.kie_nodes(df))).collect()}
    assert out == {"a": ("heuristic", 1), "b": (None, None)}


def test_arrays_under_any_label_and_cells_of_tables(spark):
    payload = {"extras": [{"x": 1}, [2, [3]], 4], "pages": [{"tables": [{"data": [["a", None, "b"], [], ["c"]], "bbox": [1, 2, 3, 4]}]}]}
    df = spark.createDataFrame([(1, json.dumps(payload))], "record_id BIGINT, payload STRING")
    nodes = shred.kie_nodes(df)
    extras = [(r.kind, r.ordinal, r.scalar) for r in nodes.where("label IN ('extras', 'x')").orderBy("node").collect()]
    assert sorted(extras, key=str) == sorted([("object", 0, None), ("array", 1, None), ("scalar", 2, "4"), ("scalar", 0, "2"), ("array", 1, None), ("scalar", 0, "3"), ("scalar", -1, "1")], key=str)
    e = shred.kie_entities(nodes)
    assert sorted((r.row_pos, r.col_pos, r.cell) for r in e["cells"].collect()) == [(0, 0, "a"), (0, 2, "b"), (2, 0, "c")]
    box = e["tables"].first()
    assert (box.x1, box.y1, box.x2, box.y2) == ("1", "2", "3", "4") and box.table_node == e["cells"].first().table_node


def test_no_depth_loses_a_payload(spark):
    deep = '{"pages": [{"page_number": 1, "x": ' + '{"x": [' * 30_000 + "1" + "]}" * 30_000 + '}], "score": NaN, "t": "a\\"b"}'
    df = spark.createDataFrame([(1, deep), (2, deep[:-5])], "record_id BIGINT, payload STRING")
    nodes = shred.kie_nodes(df)
    assert nodes.where("record_id = 1 AND kind = 'object'").count() == 30_002 and nodes.where("label = 'score'").first().scalar == "NaN"
    assert [r.kind for r in nodes.where("record_id = 2").collect()] == ["unreadable"]
    assert [tuple(r) for r in shred.kie_found(df).collect()] == [(1, "page", 0, "", -1)]


@pytest.mark.parametrize("text", ["{}", "[]", ' {"a": [1, {"b": null}, "x", -1.5e3, true], "c": {}} ', '"s"', "3"])
def test_the_deep_reader_reads_what_json_does(text):
    assert shred._deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a" 1}', "{} {}", '{"a": 1,}', "[1 2]", "}", "]", "nul"])
def test_the_deep_reader_rejects_what_json_rejects(text):
    with pytest.raises(ValueError):
        shred._deep(text)
