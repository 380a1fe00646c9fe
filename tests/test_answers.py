"""The answer store asks about a text once, over runs, retries and kinds."""

import pandas as pd
import pytest

from carelocus.operators.answers import AnswerStore, prompt_of, raw_requests
from carelocus.operators.enrich import PROMPTS, echo_model, enrichment_requests

COLUMNS = "unique_id string, specialties string, procedure string, equipment string, capability string"


def refusing():
    """A model that must not be called; made here, as workers cannot import this module."""

    def refuse(prompts: pd.Series) -> pd.Series:
        raise AssertionError("the model was called")

    return refuse


def rows(spark, texts):
    return spark.createDataFrame([(f"F{i}", t, t, None, "") for i, t in enumerate(texts)], COLUMNS)


def test_second_run_makes_no_call(spark, tmp_path):
    store, raw = AnswerStore(spark, str(tmp_path / "answers")), rows(spark, ["a"] * 50 + ["b", None])
    requests = raw_requests(raw)
    assert store.unanswered(requests).count() == 5  # a and b of two kinds, and the empty capability
    store.ask(requests, echo_model, "r1")
    store.ask(requests, refusing(), "r2")
    store.ask(requests, refusing(), "r1")
    got = {(r.unique_id, r.kind): r.response for r in store.attach(requests).collect()}
    want = {(r.unique_id, r.kind): None if r.prompt is None else f"ok:{len(r.prompt)}" for r in enrichment_requests(raw).collect()}
    assert got == want and len(got) == 4 * 52


def test_only_new_texts_are_asked(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "answers"))
    store.ask(raw_requests(rows(spark, ["a", "b"])), echo_model, "r1")
    more = raw_requests(rows(spark, ["b", "c", "a"]))
    assert sorted(r.raw for r in store.unanswered(more).collect()) == ["c", "c"]
    store.ask(more, lambda prompts: "new " + echo_model(prompts), "r2")
    assert {(r.raw, r.response[:3]) for r in store.attach(more).where("raw <> ''").collect()} == {("a", "ok:"), ("b", "ok:"), ("c", "new")}


def test_failed_run_leaves_nothing_and_asks_again(spark, tmp_path):
    store, requests = AnswerStore(spark, str(tmp_path / "answers")), raw_requests(rows(spark, ["a"]))
    with pytest.raises(Exception, match="the model was called"):
        store.ask(requests, refusing(), "r1")
    assert store.answers().count() == 0
    store.ask(requests, echo_model, "r1")
    assert store.unanswered(requests).count() == 0


def test_one_answer_for_texts_of_two_runs(spark, tmp_path):
    store, requests = AnswerStore(spark, str(tmp_path / "answers")), raw_requests(rows(spark, ["a"]))
    for run, answer in (("r2", "late"), ("r1", None)):
        spark.createDataFrame([("services", "a", answer)], "kind string, raw string, response string").write.parquet(f"{store.path}/run={run}")
    assert [r.response for r in store.answers().collect()] == [None]
    assert store.attach(requests).count() == len(PROMPTS)


def test_prompts_are_built_after_the_shuffle(spark, tmp_path):
    raw = rows(spark, ["it's"])
    made = {(r.kind, r.prompt) for r in raw_requests(raw).select("kind", prompt_of().alias("prompt")).collect()}
    assert made == {(r.kind, r.prompt) for r in enrichment_requests(raw).collect()}
    plan = AnswerStore(spark, str(tmp_path / "none")).unanswered(raw_requests(raw))._jdf.queryExecution().toString()
    assert "You are a" not in plan
