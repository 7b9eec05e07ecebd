"""Polls applied one after another, against the rules restated entity by entity."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, lifecycle, resolve

COLUMNS = "run_id int, source_id string, priority int, obs_id int, company string, position string, location string, salary string, age string, category string, season string, job_type string, application_url string, source_url string, posted string"
SOURCES = ["a", "b", "c"]


def _polls(seed: int, runs: int):
    rng = random.Random(seed)
    out, number = [], 0
    for run in range(runs):
        answered = [s for s in SOURCES if rng.random() > 0.25 and (s != "c" or run > 1)]
        rows = []
        for s in answered:
            for job in range(4):
                if rng.random() < 0.6:
                    number += 1
                    wrapped = s == "c" and rng.random() < 0.7
                    url = f"https://simplify.jobs/p/{job}" if wrapped else f"https://jobs.lever.co/x/{job}"
                    company = f"C{job}" if job < 2 else rng.choice([f"C{job}", f"C{job} Inc"])
                    rows.append((run, s, SOURCES.index(s), number, company, "P", rng.choice(["SF", "5 locations X", "Palo Alto, CA"]) if job == 3 else "SF", rng.choice([None, "$1", "$2"]), rng.choice([None, f"{run}d"]), rng.choice(["Unknown", "Other", "FAANG+"]), None, "J", url, rng.choice([None, f"https://simplify.jobs/p/{job}"]), None))
        out.append((answered, rows))
    return out


def _members(spark, rows):
    obs = spark.createDataFrame(rows, COLUMNS)
    priorities = spark.createDataFrame([(s, i) for i, s in enumerate(SOURCES)], "source_id string, priority int")
    return resolve.attach_wrappers(resolve.identified(obs.drop("priority"), priorities))


def _count(t):
    head = (t or "").split(" ")
    return len(head) > 1 and head[0].isdigit() and head[1] == "locations"


class Restated:
    """The same rules over dictionaries."""

    def __init__(self):
        self.entities, self.members, self.ready, self.batches, self.initialized = {}, {}, set(), [], False

    def apply(self, found, seen, answered, run, fallback_of):
        answered = set(answered) or {s for _, s in seen}
        new = []
        taken = {}
        for i in sorted(found):
            if not i.startswith("fallback:") and i not in self.entities and fallback_of[i] in self.entities and fallback_of[i] not in taken:
                taken[fallback_of[i]] = i
        for old, i in taken.items():
            self.entities[i] = self.entities.pop(old)
            for (e, s) in [k for k in self.members if k[0] == old]:
                self.members[i, s] = self.members.pop((e, s))
            self.batches = [sorted({i if x == old else x for x in b}) for b in self.batches]
        moved = set()
        for (i, s), v in seen.items():
            m = self.members.get((i, s))
            if m is None or not m["active"] or m["v"] != v:
                self.members[i, s] = {"first": m["first"] if m else run, "last": run, "gone": None, "active": True, "v": v}
                moved.add(i)
        for (i, s), m in self.members.items():
            if s in answered and (i, s) not in seen and m["active"]:
                m["active"], m["gone"] = False, run
        for i, n in found.items():
            o = self.entities.get(i)
            if o is None:
                self.entities[i] = {**n, "active": True, "first": run, "last": run, "gone": None}
                if self.initialized and any((i, s) in seen for s in self.ready):
                    new.append(i)
                continue
            want = dict(n)
            want["age"] = o["age"] or n["age"]
            want["salary"] = n["salary"] or o["salary"]
            if n["category"] == "Unknown" or o["category"] in history.STICKY:
                want["category"] = o["category"]
            for c in ("company", "position", "location"):
                if len(o[c]) > len(n[c]):
                    want[c] = o[c]
            if _count(o["location"]) and not _count(n["location"]):
                want["location"] = n["location"]
            if "lever" in o["application_url"] and "lever" not in n["application_url"]:
                want["application_url"] = o["application_url"]
            want["aliases"] = sorted({*o["aliases"], *n["aliases"]})
            if any(o[c] != want[c] for c in want) or i in moved or not o["active"]:
                o["last"] = run
            o.update(want)
        for i, o in self.entities.items():
            active = any(m["active"] for (e, _), m in self.members.items() if e == i)
            if o["active"] and not active:
                o["gone"] = run
            if active:
                o["gone"] = None
            o["active"] = active
        if new:
            self.batches.append(sorted(new))
        self.ready |= answered
        self.initialized = True


@pytest.mark.parametrize("seed", [1])
def test_steps_are_the_rules_restated(spark, tmp_path, seed):
    state, plain, values = history.empty(spark, "int"), Restated(), ["company", "position", "location", "salary", "age", "category", "application_url"]
    for run, (answered, rows) in enumerate(_polls(seed, 3)):
        if not answered:
            continue
        members = _members(spark, rows)
        members.write.parquet(f"{tmp_path}/{seed}-{run}-m")
        members = spark.read.parquet(f"{tmp_path}/{seed}-{run}-m")
        found = {r["canonical_id"]: {**{c: r[c] for c in values}, "aliases": sorted(r["url_aliases"].split(" "))} for r in resolve.resolved(members).collect()}
        fallback = {r["canonical_id"]: r["f"] for r in resolve.resolved(members).select("canonical_id", F.concat(F.lit("fallback:"), history.text.fingerprint(*(F.col(c) for c in ("company", "position", "job_type", "location", "season")))).alias("f")).collect()}
        one = resolve.per_source(members)
        seen = {(r["canonical_id"], r["source_id"]): r["m"] for r in one.select("canonical_id", "source_id", lifecycle.meaning(one).alias("m")).collect()}
        plain.apply(found, seen, answered, run, fallback)
        step = history.apply_run(state, members, answered, run).history
        for name in ("entities", "memberships", "sources", "batches"):
            getattr(step, name).write.parquet(f"{tmp_path}/{seed}-{run}-{name}")
            setattr(step, name, spark.read.parquet(f"{tmp_path}/{seed}-{run}-{name}"))
        state = step
        assert {r["canonical_id"]: (*(r[c] for c in values), list(r["url_aliases"]), r["active"], r["first_seen"], r["last_seen"], r["inactive_at"]) for r in state.entities.collect()} == {i: (*(o[c] for c in values), o["aliases"], o["active"], o["first"], o["last"], o["gone"]) for i, o in plain.entities.items()}
        assert {(r["canonical_id"], r["source_id"]): (r["first_seen"], r["last_seen"], r["inactive_at"], r["active"]) for r in state.memberships.collect()} == {k: (m["first"], m["last"], m["gone"], m["active"]) for k, m in plain.members.items()}
        assert sorted(list(r["job_ids"]) for r in state.batches.collect()) == sorted(plain.batches)
    assert history.current(state).count() == sum(o["active"] for o in plain.entities.values())


def test_a_broken_feed_ends_nothing(spark):
    """A source whose poll isn't ok isn't among those that answered, so what it listed stays active."""
    from tidemark.sources import registry

    rows = [(0, s, i, i, "C", "P", "L", None, None, "Other", None, "J", f"https://jobs.lever.co/x/{s}", None, None) for i, s in enumerate(["a", "b"])]
    first = history.apply_run(history.empty(spark, "int"), _members(spark, rows), ["a", "b"], 0)
    assert first.baseline and first.new.count() == 0
    polls = registry.outcomes(spark.createDataFrame([("a", "json_internships", "{"), ("b", "json_internships", '{"jobs": [{"category": "Software Engineering", "company": "C", "title": "P", "location": "L", "url": "https://jobs.lever.co/x/b"}]}')], "source_id string, format string, body string"))
    answered = [r["source_id"] for r in polls.where("ok").collect()]
    assert answered == ["b"]
    second = history.apply_run(first.history, _members(spark, [(1, *rows[1][1:])]), answered, 1)
    assert {r["canonical_id"]: r["active"] for r in second.history.entities.collect()} == {"lever:x:a": True, "lever:x:b": True}
    third = history.apply_run(first.history, _members(spark, [(1, *rows[1][1:])]), ["a", "b"], 1)
    assert {r["canonical_id"]: r["inactive_at"] for r in third.history.entities.collect()} == {"lever:x:a": 1, "lever:x:b": None}


def test_links_in_closed_form_are_those_of_the_steps(spark):
    """Links only grow; a run adds some if it has one that no run before had."""
    runs = {0: ["https://jobs.lever.co/x/1?a=1"], 1: ["https://jobs.lever.co/x/1?a=2", "https://jobs.lever.co/x/1?a=1"], 2: ["https://jobs.lever.co/x/1?a=1"]}
    rows = [(run, s, i, run * 10 + i, "C", "P", "L", None, None, "Other", None, "J", url, None, None) for run, urls in runs.items() for i, (s, url) in enumerate(zip(SOURCES, urls))]
    state = history.empty(spark, "int")
    for run in runs:
        mine = [r for r in rows if r[0] == run]
        state = history.apply_run(state, _members(spark, mine), [r[1] for r in mine], run).history
    members = _members(spark, rows)
    stepped = {r["canonical_id"]: list(r["url_aliases"]) for r in state.entities.collect()}
    assert stepped == {r["canonical_id"]: list(r["url_aliases"]) for r in lifecycle.aliases(members).collect()} == {"lever:x:1": sorted(runs[1])}
    assert {r["run_id"]: r["adds"] for r in lifecycle.link_changes(members).collect()} == {0: True, 1: True, 2: False}
    assert {r["run_id"]: (r["observations"], r["entities"], r["duplicates"]) for r in resolve.counts(members).collect()} == {0: (1, 1, 0), 1: (2, 1, 1), 2: (1, 1, 0)}
    assert lifecycle.aliases(members.limit(0)).count() == 0 and resolve.counts(members.limit(0)).count() == 0
    unlinked = members.withColumn("application_url", F.lit(None).cast("string"))
    assert lifecycle.links(unlinked).count() == 0 and not any(r["adds"] for r in lifecycle.link_changes(unlinked).collect())
