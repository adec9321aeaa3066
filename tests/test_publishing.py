"""Models replaced only by better ones, metric logs written once, whoever fails or writes at the same time."""

import math

import numpy as np
import pytest

from strandline.sources import models, tables
from strandline.sources.store import Folder


def fold_rows(spark, values):
    return spark.createDataFrame([row for fold, value in values.items() for row in models.model_rows(
        fold, {"w": np.full((2, 2), value), "b": np.array([value])})], models.MODEL_SCHEMA)


def current(spark, path):
    return {r.fold: r["values"][0] for r in models.read_models(spark, path).where("name = 'b'").collect()}


def test_only_better_models_are_published(spark, tmp_path):
    path = str(tmp_path / "models")
    assert models.publish_best(fold_rows(spark, {0: 1.0, 1: 1.0, 2: 1.0}), {0: .5, 1: math.nan, 2: -1.0}, path) == [0]
    assert current(spark, path) == {0: 1.0}
    assert models.publish_best(fold_rows(spark, {0: 2.0, 1: 2.0, 3: 2.0}), {0: .5, 1: -.5, 3: None}, path) == [1]
    assert current(spark, path) == {0: 1.0, 1: 2.0} and models.published_scores(spark, path) == {0: .5, 1: -.5}
    assert models.publish_best(fold_rows(spark, {0: 3.0, 1: 3.0}), {0: .4, 1: -.6}, path) == []
    assert models.publish_best(fold_rows(spark, {0: 4.0, 1: 4.0}), {0: .6, 1: -.7}, path) == [0]
    assert current(spark, path) == {0: 4.0, 1: 2.0}
    assert models.list_folds(models.read_models(spark, path)) == [0, 1]


def test_a_run_killed_halfway_leaves_the_old_models(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "models")
    models.publish_best(fold_rows(spark, {0: 1.0}), {0: .5}, path)

    def fail(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Folder, "create", fail)  # parameters are written, the list isn't
    with pytest.raises(KeyboardInterrupt):
        models.publish_best(fold_rows(spark, {0: 2.0}), {0: .9}, path)
    monkeypatch.undo()
    assert current(spark, path) == {0: 1.0}
    (tmp_path / "models" / "lists" / "00000001.json").write_text('{"folds": {"0": {"sco')  # a list cut short
    assert current(spark, path) == {0: 1.0}
    assert models.publish_best(fold_rows(spark, {0: 3.0}), {0: .7}, path) == [0]
    assert current(spark, path) == {0: 3.0} and Folder(spark, f"{path}/lists").numbers() == [0, 1, 2]


@pytest.mark.parametrize("other, published", [(.9, []), (.6, [0])])
def test_a_second_writer_compares_again(spark, tmp_path, monkeypatch, other, published):
    path = str(tmp_path / "models")
    models.publish_best(fold_rows(spark, {0: 1.0}), {0: .5}, path)
    create, raced = Folder.create, []

    def race(folder, number, content):
        if not raced:
            raced.append(number)
            models.publish_best(fold_rows(spark, {0: 9.0}), {0: other}, path)
        return create(folder, number, content)

    monkeypatch.setattr(Folder, "create", race)
    assert models.publish_best(fold_rows(spark, {0: 2.0}), {0: .8}, path) == published
    assert current(spark, path) == {0: 2.0 if published else 9.0}


def rows_of(spark, rows):
    return spark.createDataFrame(rows, tables.HISTORY_SCHEMA)


def test_history_is_written_once(spark, tmp_path):
    path = str(tmp_path / "history")
    first = [("r", 0, e, "mcc", e / 4) for e in range(3)] + [("r", 1, 0, "mcc", None)]
    for rows in (first, first, [("r", 0, 3, "mcc", .9)], [("s", 0, 0, "mcc", .1)], first[::-1]):
        tables.append_history(rows_of(spark, rows), path)
    held = sorted(map(tuple, tables.read_history(spark, path).collect()), key=repr)
    assert held == sorted([*first, ("r", 0, 3, "mcc", .9), ("s", 0, 0, "mcc", .1)], key=repr)
    for value in (.2, .3):
        tables.append_history(rows_of(spark, [("r", 5, 0, "mcc", value)]), path, part="fold-5")
    assert [r.value for r in tables.read_history(spark, path).where("fold = 5").collect()] == [.3]
    assert tables.read_history(spark, path).count() == len(held) + 1


def test_records_that_do_not_fit(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        'AMP_No,Sequence,Label,Length,Fatty_acid_chain\nP1,AKL,1,3,C6\nP2,AK,yes,2,C6\nP3,"A,K",0,,C8\nP4,AK\n'
        'P5,AK,1,2,C6,more\nP6,,,,\nP7,AK,1.5,two,C6\n')
    good, bad = tables.read_records(spark, str(tmp_path / "in.csv"))
    assert sorted((r.AMP_No, r.Sequence, r.Label, r.Length) for r in good.collect()) == [
        ("P1", "AKL", 1, 3), ("P3", "A,K", 0, None), ("P6", None, None, None)]
    assert good.count() == 3 and good.select("Sequence").count() == 3 and good.where("peptide_id is null").count() == 3
    assert {(r.raw_record, r.reason) for r in bad.collect()} == {
        ("P2,AK,yes,2,C6", "not of its type: Label"), ("P4,AK", "2 fields for 5 columns"),
        ("P5,AK,1,2,C6,more", "6 fields for 5 columns"), ("P7,AK,1.5,two,C6", "not of its type: Label, Length")}
    good, bad = tables.read_records(spark, str(tmp_path / "in.csv"), "AMP_No string, Label string, extra double")
    assert good.count() == 5 and bad.count() == 2 and good.where("extra is not null").count() == 0
