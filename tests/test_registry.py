"""Queries run, and what SQL says of them agrees on the smallest tables."""

import json

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from sieveline.operators import bootstrap, graph, similarity
from sieveline.plans import catalog, split_plans
from sieveline.sources import standins

TABLES = "documents embeddings pages labels".split()


def rows(frame):
    cell = lambda x: "NULL" if x is None or x != x else repr(x.tolist() if hasattr(x, "tolist") else x)
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", ["step0_run_metrics", "agg25_ece", "win2_threshold", "agg6_duplicate_groups", "win5_longest_runs", "jn1_cosine_pairs", "gr1_components", "gr4_stratified", "bst1_3_image_ci"])
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    got, want = entry.queries()[name](spark, small).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["bst7_ece_ci", "bst7_selective_ci", "bst1_3_image_ci", "bst5_q9_contrasts", "q1_main_table"])
def test_intervals_against_sql_without_a_row_a_draw(spark, small, name, monkeypatch):
    monkeypatch.setattr(bootstrap, "draws", None)
    test_against_sql(spark, small, name)


def test_intervals_against_sql_without_numbering_units_in_shuffles(spark, small, monkeypatch):
    monkeypatch.setattr(bootstrap, "numbered", None)
    test_against_sql(spark, small, "bst1_3_image_ci")


@pytest.mark.parametrize("name, table", [("q1_main_table", "predictions"), ("bst5_q9_contrasts", "regions")])
def test_intervals_against_sql_by_links_and_with_predictions_made_once(spark, small, name, table, monkeypatch):
    made, make = [], getattr(standins, table)
    monkeypatch.setattr(similarity, "cosine_pairs", None)
    monkeypatch.setattr(standins, table, lambda *a: made.append(1) or make(*a))
    test_against_sql(spark, small, name)
    assert len(made) == 1


def test_report_by_links_and_with_predictions_made_once(spark, small, monkeypatch):
    made, make = [], standins.predictions
    monkeypatch.setattr(similarity, "cosine_pairs", None)
    monkeypatch.setattr(standins, "predictions", lambda *a: made.append(1) or make(*a))
    got = json.loads(entry.queries()["q7_report_json"](spark, small).first().report)
    assert len(made) == 1 and got == [{k: v for k, v in r.asDict().items()} for r in entry.queries()["q1_main_table"](spark, small).orderBy("backbone").collect()]


def test_report_holds_the_main_table_without_a_row_a_draw(spark, small, monkeypatch):
    monkeypatch.setattr(bootstrap, "draws", None)
    got = json.loads(entry.queries()["q7_report_json"](spark, small).first().report)
    assert [r["backbone"] for r in got] == [0, 1] and all(r["accuracy_image_lo"] <= r["accuracy_mean"] <= r["accuracy_image_hi"] for r in got)


def test_report_draws_once_and_finds_clusters_without_rounds(spark, small, monkeypatch):
    drawn, sums = [], bootstrap.weighted_sums
    monkeypatch.setattr(bootstrap, "weighted_sums", lambda *a: drawn.append(1) or sums(*a))
    monkeypatch.setattr(graph, "connected", None)
    got = json.loads(entry.queries()["q7_report_json"](spark, small).first().report)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{small}/embeddings.parquet')")
    assert len(drawn) == 1 and got == con.execute(entry.oracle_sql()["q1_main_table"] + " ORDER BY backbone").df().to_dict("records")


def test_near_summary_joins_no_vectors_and_finds_clusters_once(spark, small, monkeypatch):
    rounds, connected = [], graph.connected
    monkeypatch.setattr(graph, "connected", lambda *a, **k: rounds.append(1) or connected(*a, **k))
    monkeypatch.setattr(split_plans, "_with_corr", None)
    test_against_sql(spark, small, "agg9_flt6_near_summary")
    assert len(rounds) == 1


def test_near_summary_finds_clusters_without_rounds(spark, small, monkeypatch):
    made, checkpointed = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: made.append(df.columns) or checkpointed(df))
    test_against_sql(spark, small, "agg9_flt6_near_summary")
    assert len(made) == 2  # what cells give back, and its links


def test_no_floor_of_the_four_leaves_few_pairs(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 64)).astype("float32")
    x = np.concatenate([base, np.repeat(base[:1], 20, axis=0)])  # 210 pairs of copies
    pd.DataFrame({"vec_id": range(60), "embedding": list(x), "label": [i % 10 for i in range(60)]}).to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    want = con.execute(entry.oracle_sql()["set2_effective_floor"]).fetchall()
    assert [tuple(r) for r in entry.queries()["set2_effective_floor"](spark, str(tmp_path)).collect()] == want == [(None,)]


def test_group_split_checks_find_the_pairs_once_and_tell_of_missing_classes(spark, small, tmp_path, monkeypatch):
    found, pairs = [], similarity.cosine_pairs
    monkeypatch.setattr(similarity, "cosine_pairs", lambda *a: found.append(1) or pairs(*a))
    test_against_sql(spark, small, "gr5_8_group_split_checks")
    assert len(found) == 1
    x = np.concatenate([np.ones((30, 64)), -np.ones((1, 64))]).astype("float32")  # a cluster of 30, whole in train, and one row
    pd.DataFrame({"vec_id": range(31), "embedding": list(x), "label": [i % 2 for i in range(31)]}).to_parquet(tmp_path / "embeddings.parquet")
    got = entry.queries()["gr5_8_group_split_checks"](spark, str(tmp_path)).first()
    assert (got.crossing, got.spanning, got.n, got.every_class_everywhere, got.train_largest) == (0, 0, 31, False, True)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and catalog.FLAGSHIP in entry.queries()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
