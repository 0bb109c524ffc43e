import json

import pytest

from lexgauge.operators.inputs import ValidationError
from lexgauge.sources.scores import attach_scores, read_scores


def put(folder, value):
    (folder / "s.json").write_text(json.dumps(value), encoding="utf-8")
    return str(folder / "s.json")


def test_scores_by_position(spark, tmp_path):
    manifest = spark.createDataFrame([(2, "m", "1", "b", "standard"), (1, "m", "1", "a", "standard"), (3, "m", "1", "c", "standard")], "line_no long, model_name string, run_id string, id string, input_variant string")
    path = put(tmp_path, {"hyp.txt": [{"src": "x", "COMET": 0.5}, {"src": "{\"COMET\": 9}", "COMET": 0.25}, {"src": "z", "COMET": None}]})
    got = {r.id: r.comet_score for r in attach_scores(manifest, read_scores(spark, path, "$['hyp.txt']")).collect()}
    assert got == {"a": 0.5, "b": 0.25, "c": None}
    flat = read_scores(spark, put(tmp_path, [1, 0.125, "nan"]))
    assert [(r.line_no, r.score) for r in flat.orderBy("line_no").collect()] == [(1, 1.0), (2, 0.125), (3, None)]


def test_unequal_counts_are_refused(spark, tmp_path):
    manifest = spark.createDataFrame([(1, "a"), (2, "b")], "line_no long, id string")
    with pytest.raises(ValidationError, match="1 lines without a score"):
        attach_scores(manifest, read_scores(spark, put(tmp_path, [0.5])))
    with pytest.raises(ValidationError, match="0 repeated|1 scores without"):
        attach_scores(manifest, read_scores(spark, put(tmp_path, [0.5, 0.5, 0.5])))
    with pytest.raises(ValidationError, match="no score array"):
        read_scores(spark, put(tmp_path, {"x": 1}), "$.y")
    empty = attach_scores(manifest.limit(0), read_scores(spark, put(tmp_path, [])))
    assert empty.columns == ["line_no", "id", "comet_score"] and empty.count() == 0
