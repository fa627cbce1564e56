"""A graph of steps: killed on the way it goes on from there, and what fails is on record."""

import pytest

from tidemark.operators.graph import Graph, Step


def test_killed_between_steps_it_goes_on_from_there(spark, tmp_path):
    ran, fail = [], {"c": KeyboardInterrupt()}

    def step(name, *after):
        def make(before):
            ran.append(name)
            if name in fail:
                raise fail.pop(name)
            assert set(before) == set(after)
            return spark.range(len(ran)).withColumnRenamed("id", name)

        return Step(name, make, after)

    steps = [step("a"), step("b", "a"), step("c", "b"), step("d", "c", "a")]
    graph = Graph(spark, str(tmp_path), steps)
    with pytest.raises(KeyboardInterrupt):  # as if the driver were killed
        graph.run("monday")
    assert {r.step: r.state for r in graph.state("monday").collect()} == {"a": "done", "b": "done", "c": "running"}
    again = Graph(spark, str(tmp_path), steps)
    states = {r.step: r for r in again.run("monday").collect()}
    assert ran == ["a", "b", "c", "c", "d"] and all(r.state == "done" for r in states.values())
    assert [states[s].attempts for s in "abcd"] == [1, 1, 2, 1] and [states[s].n_rows for s in "abcd"] == [1, 2, 4, 5]
    assert again.result("monday", "c").count() == 4
    again.run("monday")
    assert len(ran) == 5  # nothing is left to do
    again.run("tuesday")
    assert len(ran) == 9


def test_a_failure_blocks_what_comes_after_and_nothing_else(spark, tmp_path):
    broken = [True]

    def bad(_):
        if broken[0]:
            raise ValueError("no feed today")
        return spark.range(3)

    graph = Graph(spark, str(tmp_path), [Step("feed", bad), Step("use", lambda b: b["feed"], ("feed",)), Step("other", lambda _: spark.range(2))])
    states = {r.step: r for r in graph.run("x").collect()}
    assert [(states[s].state, states[s].attempts) for s in ("feed", "use", "other")] == [("failed", 1), ("blocked", 0), ("done", 1)]
    assert "no feed today" in states["feed"].error and states["use"].error == "waits for feed"
    with pytest.raises(LookupError):
        graph.result("x", "use")
    broken[0] = False
    states = {r.step: r for r in graph.run("x").collect()}
    assert [(states[s].state, states[s].attempts) for s in ("feed", "use", "other")] == [("done", 2), ("done", 1), ("done", 1)]


def test_order_is_checked(spark, tmp_path):
    one = Step("a", lambda _: spark.range(1), ("b",))
    with pytest.raises(ValueError):
        Graph(spark, str(tmp_path), [one])
