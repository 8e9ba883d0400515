"""Builds that are killed and go on, locks that are taken over, projects with links, policies and an index."""

import os
import time

import pytest

from quillspan.operators import anomaly, lexindex
from quillspan.plans import project
from quillspan.sources import tables as store

TEXT = "第1章 起\n陆川击败韩岳。玄霄又称青帝。陆川位于青城。来客共有3名。License LICENSE\n"
SCHEMA = "source_id string, text string"


class Killed(BaseException):
    """What no handler of the library catches."""


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Killed before every single stage is entered, until one attempt comes to the end: names of stages as they were done."""
    folder = tmp_path_factory.mktemp("builds")
    path, done, plain = f"file://{folder}/p", [], store.write_tables
    sources = spark.createDataFrame([("a", TEXT), ("b", "陆川位于青城。")], SCHEMA)
    policy = project.profile("balanced", anomaly=anomaly.AnomalyPolicy(marker_groups={"g": ("xx", "yy")}))

    def once(made, place):
        if done and done[-1] == "killed":
            done.append(sorted(made))
            return plain(made, place)
        done.append("killed")
        raise Killed

    store.write_tables = once
    try:
        for attempts in range(1, 40):
            try:
                project.publish(spark, sources, path, policy)
                break
            except Killed:
                assert not (folder / "p").exists() and len(list(folder.glob("p.build-*"))) <= 1 and not (folder / "p.lock").exists()
    finally:
        store.write_tables = plain
    return folder, path, done, attempts, sources, policy


def test_a_killed_build_goes_on_and_does_no_stage_twice(spark, built):
    folder, path, done, attempts, *_ = built
    stages = [tuple(x) for x in done if x != "killed"]
    assert attempts > 8 and len(stages) == len(set(stages)) and ("lines",) in stages
    assert sorted(p.name for p in folder.iterdir()) == ["p"]
    assert project.verify(spark, path).isEmpty() and not (folder / "p" / "_journal").exists()


def test_it_is_the_project_that_an_undisturbed_build_gives_by_its_own_policy(spark, built):
    _, path, *_, policy = built
    assert project.policy_of(store.read_project(spark, path, ["policy"])["policy"].first().policy) == policy
    assert project.regenerated_differences(spark, path).isEmpty()


def test_a_name_in_two_sources_does_not_fail_the_probe(spark, built):
    assert project.probe(spark, built[1]).first().decision in ("answered", "refused_ambiguous")


def test_the_index_is_searched_and_looked_after(spark, built):
    path = built[1]
    hits = project.search(spark, path, ["license"]).collect()
    assert [(r.source_id, r.score >= 20) for r in hits] == [("a", True)]
    lexindex.add_units(spark.createDataFrame([("x", "u", 0, "foreign")], "source_id string, unit_id string, start_char long, unit_text string"), f"{path}/{project.INDEX}")
    assert [(r.table_name, r.problem) for r in project.verify(spark, path).collect()] == [("lexical", "CHANGED")]


def test_locks_of_the_living_hold_and_those_of_the_dead_do_not(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/q"
    with store.replacing(spark, path) as place:
        assert "pid" in (tmp_path / "q.lock").read_text()
        with pytest.raises(OSError, match="another build"):
            store.replacing(spark, path).__enter__()
        spark.range(1).write.parquet(f"{place}/t")
    (tmp_path / "q.lock").touch()
    os.utime(tmp_path / "q.lock", (time.time() - store.LEASE - 60,) * 2)
    (tmp_path / "q.build-old").mkdir()
    with store.replacing(spark, path, "new") as place:
        spark.range(2).write.parquet(f"{place}/t")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["q"] and spark.read.parquet(f"{path}/t").count() == 2


def test_a_living_lock_is_touched(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LEASE", 1)
    with store.replacing(spark, f"file://{tmp_path}/q") as place:
        os.utime(tmp_path / "q.lock", (0, 0))
        time.sleep(1.5)
        assert (tmp_path / "q.lock").stat().st_mtime > 1e9
        spark.range(1).write.parquet(f"{place}/t")


def test_policies_are_told_and_read(spark):
    for policy in [*project.PROFILES.values(), project.profile("strict", anomaly=anomaly.AnomalyPolicy(marker_groups={"a": ("x", "y"), "b": ("z",)}))]:
        assert project.policy_of(project.policy_json(policy)) == policy
    with pytest.raises(ValueError):
        project.policy_of('{"odd": 1}')
