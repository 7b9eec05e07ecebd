import random
import re

import pytest

from tidemark.operators import lifecycle
from tidemark.streaming import polls as stream

SOURCES = ["a", "b"]


def _history(seed: int, runs: int = 6):
    rng = random.Random(seed)
    polls = [(r, s, i, rng.random() > 0.25) for r in range(runs) for i, s in enumerate(SOURCES)]
    seen = []
    for r, s, _, ok in polls:
        for e in ("x", "y", "z"):
            if ok and rng.random() < 0.55:
                salary = rng.choice([None, "$1", "$2"])
                seen.append((r, e, s, "C", "P", "J", "L", salary, "u", "K", None))
    return polls, seen


def _frames(spark, seed):
    polls, seen = _history(seed)
    columns = "run_id int, canonical_id string, source_id string, " + ", ".join(f"{c} string" for c in lifecycle.MEANINGFUL)
    return spark.createDataFrame(polls, "run_id int, source_id string, priority int, ok boolean"), spark.createDataFrame(seen, columns), polls, seen


def _sequential(polls, seen):
    """One poll after another, entry by entry."""
    state = {}
    for run in sorted({p[0] for p in polls}):
        for _, source, _, ok in (p for p in polls if p[0] == run and p[3]):
            now = {o[1]: o[3:] for o in seen if o[0] == run and o[2] == source}
            for e, v in now.items():
                old = state.get((e, source))
                if old is None:
                    state[e, source] = [run, run, None, True, v]
                elif not old[3] or old[4] != v:
                    state[e, source] = [old[0], run, None, True, v]
            for (e, s), old in state.items():
                if s == source and e not in now and old[3]:
                    old[2], old[3] = run, False
    return {(e, s, *v[:4]) for (e, s), v in state.items()}


def test_closed_form_is_the_sequential_fold(spark):
    for seed in range(4):
        polls_df, seen_df, polls, seen = _frames(spark, seed)
        assert {tuple(r) for r in lifecycle.memberships(seen_df, polls_df).collect()} == _sequential(polls, seen)


def test_stream_is_the_closed_form(spark):
    polls_df, seen_df, polls, seen = _frames(spark, 11)
    assert {tuple(r) for r in stream.run_stream(seen_df, polls_df).collect()} == _sequential(polls, seen)


def test_failed_poll_is_unknown(spark):
    columns = "run_id int, canonical_id string, source_id string, " + ", ".join(f"{c} string" for c in lifecycle.MEANINGFUL)
    seen = spark.createDataFrame([(0, "x", "a", *["v"] * 8)], columns)
    polls = lambda ok: spark.createDataFrame([(0, "a", 0, True), (1, "a", 0, ok)], "run_id int, source_id string, priority int, ok boolean")
    assert lifecycle.memberships(seen, polls(False)).first()["active"]
    assert lifecycle.memberships(seen, polls(True)).first()["inactive_at"] == 1


def _folded(locations):
    """One after another."""
    counts, state, out = lambda x: re.match(r"\d+\s+locations\b", x, re.I) is not None, None, []
    for x in locations:
        if x is not None and (state is None or counts(state) and not counts(x) or len(state) <= len(x)):
            state = x
        out.append(state)
    return out


def _running(spark, groups, runs=None):
    rows = [(f"e{e}", r, x) for e, group in enumerate(groups) for r, x in enumerate(group)]
    random.Random(1).shuffle(rows)
    found = lifecycle.running_location(spark.createDataFrame(rows, "canonical_id string, run_id int, location string"), runs).collect()
    by_run = {(r["canonical_id"], r["run_id"]): r["location"] for r in found}
    assert len(found) == len(rows)
    return [[by_run[f"e{e}", r] for r in range(len(group))] for e, group in enumerate(groups)]


def test_locations_fold(spark):
    groups = [["5 locations SF, NY", "Palo Alto"], ["Palo Alto", "5 locations Palo Alto and more"], ["A", "BB", "C"]]
    assert [g[-1] for g in _running(spark, groups)] == ["Palo Alto", "5 locations Palo Alto and more", "BB"]


def test_running_locations_are_the_sequential_fold(spark):
    """Ties, nulls, empty names, runs of counts and of places; groups of one row and of powers of two and one more."""
    rng = random.Random(7)
    kinds = [None, "", "A", "BB", "CC", "3 locations", "12 LOCATIONS", "3 locations now", "Palo Alto, CA", "a place of 16 ch", "a place longer than a count"]
    groups = [[rng.choice(kinds) for _ in range(n)] for n in [1, 2, 3, 4, 5, 8, 9, 16, 17, 64, 65, 300] for _ in range(6)]
    groups += [[None, None], ["2 locations"] * 5, ["A" * n for n in range(40, 0, -1)]]
    assert _running(spark, groups) == [_folded(g) for g in groups]
    assert _running(spark, groups, 1000) == [_folded(g) for g in groups]


def test_more_runs_than_said_are_an_error(spark):
    with pytest.raises(Exception, match="more than 2 runs of e0"):
        _running(spark, [["A", "B", "C"]], 2)
    assert _running(spark, [["A", "B"]], 2) == [["A", "B"]]
    none = spark.createDataFrame([], "canonical_id string, run_id int, location string")
    assert lifecycle.running_location(none).collect() == []


def test_running_locations_collect_no_lists(spark):
    rows = spark.createDataFrame([("e", 0, "A")], "canonical_id string, run_id int, location string")
    plan = lifecycle.running_location(rows, 4096)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1
