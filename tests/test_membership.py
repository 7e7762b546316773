"""Candidates and their members in long form, against the lists and against loops; a candidate of a third of all trials."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseflux.operators import cluster, funnel, membership
from phaseflux.plans import catalog
from phaseflux.sources import shared

SF = "/root/testdata/sf0.001"


def lists(schema):
    return [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType)]


@pytest.fixture(scope="module")
def trials(spark):
    return shared.kept(catalog.trials(spark, SF))


def shown(frame, *columns):
    return sorted(map(str, frame.select(*columns).collect()))


SCALARS = ("candidate_id", "drug_name", "indication", "drug_name_raw", "n_trials", "highest_phase", "sponsors", "earliest_start", "latest_completion", "trees", "ord", "mesh_drug", "mesh_indication", *cluster.LABELS, "p_1", "p_2", "p_3", "has_p")


def test_long_form_equals_lists(spark, trials):
    for key in (cluster.string_key, cluster.hybrid_key):
        found, plain = membership.clustered(trials, key), cluster.candidates(trials, key)
        assert shown(found.candidates, *SCALARS) == shown(plain, *SCALARS)
        assert shown(membership.listed(found), "candidate_id", "trial_ids") == shown(plain, "candidate_id", "trial_ids")
        assert not lists(found.members.schema) and set(lists(found.candidates.schema)) == {"sponsors", "trees"}


@pytest.mark.parametrize("unmatched", [True, False])
def test_merged_long_form_equals_merged_lists(spark, trials, unmatched):
    found, plain = membership.clustered(trials), cluster.candidates(trials)
    merged = membership.remerged(found._replace(candidates=shared.kept(catalog.numbered(found.candidates))), unmatched)
    want = cluster.remerged(catalog.numbered(plain), unmatched)
    names = ("candidate_id", "drug_name", "merged", "n_trials", "sponsors", "trees", "highest_phase", "earliest_start", "latest_completion", "ord", "p_1", "has_p")
    assert shown(merged.candidates, *names) == shown(want, *names)
    assert shown(membership.listed(merged), "candidate_id", "trial_ids") == shown(want, "candidate_id", "trial_ids")
    assert merged.candidates.where("merged > 1").count() > 3


def test_funnel_of_members_equals_funnel_of_lists(spark, trials):
    found, plain = membership.clustered(trials), cluster.candidates(trials)
    rows = shared.kept(found.candidates)
    names = ("stratum", "modality", "disease_area", "candidate_count", "from_phase", "numerator", "denominator", "n_durations", F.round("avg_duration_years", 9).alias("y"))
    assert shown(funnel.funnel(rows, trials, membership.labels(found, rows)), *names) == shown(funnel.funnel(plain, trials), *names)


def skewed(spark, n):
    """Trials of which one candidate has a third, with studies that several candidates share."""
    rng = random.Random(9)
    rows = []
    for i in range(n):
        name = "Hot Drug" if i % 3 == 0 else f"drug {rng.randint(0, n // 8)}"
        rows.append((f"N{rng.randint(0, n // 2)}", f"{i:08d}", name, "pain", f"s{rng.randint(0, 40)}", rng.choice(["Phase 1", "Phase 2", "Phase 3", "N/A"]), dt.date(2000, 1, 1), dt.date(2000, 1, 1) + dt.timedelta(rng.randint(-5, 900)), rng.choice([None, 0.01, 0.2]), [], [f"m{rng.randint(0, 3)}"], [f"C0{rng.randint(1, 5)}"], ("peptide", "vaccine", None)[len(name) % 3], ("oncology", "cardiology")[len(name) % 2]))
    schema = "nct_id string, ord string, intervention string, indication string, sponsor string, phase string, start_date date, completion_date date, p_value double, mesh_drug_terms array<string>, mesh_condition_terms array<string>, trees array<string>, modality string, disease_area string"
    return rows, spark.createDataFrame(rows, schema).repartition(6)


def test_a_candidate_of_a_third_of_all_trials(spark):
    rows, frame = skewed(spark, 6000)
    found = membership.clustered(shared.kept(frame))
    got = {r.candidate_id: r for r in found.candidates.collect()}
    by = {}
    for r in rows:
        by.setdefault(f"{r[2].lower()}__pain", []).append(r)
    assert set(got) == set(by)
    for key, own in by.items():
        own.sort(key=lambda r: r[1])
        r = got[key]
        assert r.n_trials == len(own) and r.sponsors == list(dict.fromkeys(x[4] for x in own)) and r.trees == sorted({x[11][0] for x in own})
        least = lambda i, own=own: min((x[8] for x in own if x[5] == f"Phase {i}" and x[8] is not None), default=None)
        assert (r.p_1, r.p_2, r.p_3) == (least(1), least(2), least(3))
        terms = Counter(x[10][0] for x in own)
        assert r.mesh_indication == min(terms, key=lambda t: (-terms[t], next(i for i, x in enumerate(own) if x[10][0] == t))) and r.mesh_drug is None
    assert got["hot drug__pain"].n_trials == 2000
    labels = {r.nct_id: {tuple(x) for x in r.labels} for r in membership.labels(found, shared.kept(found.candidates.join(frame.select("modality", "disease_area", F.lower(F.concat("intervention", F.lit("__pain"))).alias("candidate_id")).distinct(), "candidate_id") if "modality" not in found.candidates.columns else found.candidates)).collect()}
    want = {}
    for r in rows:
        want.setdefault(r[0], set()).add((r[12], r[13]))
    assert labels == want


def test_the_hot_candidate_is_split(spark):
    """Members meet their candidates' labels by a join that Spark splits where one candidate has most rows."""
    _, frame = skewed(spark, 30_000)
    found = membership.clustered(shared.kept(frame))
    rows = shared.kept(found.candidates)
    members = shared.kept(found.members)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = membership.labels(membership.Clustered(rows, members), rows)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan, plan[:3000]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("unmatched", [True, False])
def test_studies_equal_merged_members(spark, trials, unmatched):
    hot = skewed(spark, 3000)[1].replace("Hot Drug", "drug 4000")
    for frame in (trials, shared.kept(hot), trials.where("false")):
        found, names = membership.clustered(frame), membership.named(frame)
        assert shown(names.candidates, *names.candidates.columns) == shown(found.candidates, *names.candidates.columns)
        merged = membership.remerged(found._replace(candidates=shared.kept(catalog.numbered(found.candidates))), unmatched)
        want = merged.members.groupBy("candidate_id", "nct_id").agg(F.count("*").alias("n")).join(merged.candidates.select("candidate_id", "n_trials"), "candidate_id")
        got = membership.studies(names._replace(candidates=shared.kept(catalog.numbered(names.candidates))), unmatched)
        assert shown(got, "candidate_id", "nct_id", "n", "n_trials") == shown(want, "candidate_id", "nct_id", "n", "n_trials")
    assert got.count() == 0


def test_ids_and_areas_that_are_missing(spark):
    """A MeSH drug in the place of an id, no area at all, a group of one, a study twice in a candidate that is alone."""
    rows = [("a", "1", "DB1", None, "x"), ("b", "2", None, "DB1", "x"), ("c", "3", "DB2", None, None), ("d", "4", "DB2", None, None), ("e", "5", None, None, "x"), ("f", "6", "DB3", None, "x")]
    cands = spark.createDataFrame([(*r, None, 2) for r in rows], "candidate_id string, ord string, drug_id string, mesh_drug string, indication string, mesh_indication string, n_trials long")
    members = spark.createDataFrame([(c, n) for c, ns in {"a": "pp", "b": "pq", "c": "rs", "d": "st", "e": "pp", "f": "qq"}.items() for n in ns], "candidate_id string, nct_id string")
    got = membership.studies(membership.Clustered(cands, members))
    assert sorted(map(tuple, got.collect())) == [("a", "p", 1, 2), ("a", "q", 1, 2), ("c", "r", 1, 3), ("c", "s", 1, 3), ("c", "t", 1, 3), ("e", "p", 2, 2), ("f", "q", 2, 2)]


def test_no_trials(spark):
    _, frame = skewed(spark, 30)
    found = membership.clustered(frame.where("false"))
    assert found.candidates.count() == 0 and found.members.count() == 0
    named = catalog.numbered(found.candidates)
    assert membership.remerged(found._replace(candidates=named)).candidates.count() == 0
