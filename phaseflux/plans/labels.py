"""Queries of the registry's tables, of labelling and of the review files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import stages
from ..functions import text
from ..operators import evaluate, ingest, label, numbering
from ..sources import adapter, readers, shared
from ..sources.journal import Journal
from .catalog import _CANDS, _answer, cands, query, trials

_SHOWN = "nct_id, i_id || '/' || c_id AS at, brief_title, start_date, completion_date, intervention, indication, sponsor, drug_terms, condition_terms, trees"


def _scanned(rows: DataFrame) -> DataFrame:
    return rows.select(
        "nct_id", F.concat_ws("/", F.col("ord.i_id"), F.col("ord.c_id").cast("string")).alias("at"), F.concat(F.lit("Study "), F.col("phase_text")).alias("brief_title"), "start_date", "completion_date", "intervention", "indication", "sponsor",
        *(F.array_join(c, "|").alias(n) for c, n in (("mesh_drug_terms", "drug_terms"), ("mesh_condition_terms", "condition_terms"), ("trees", "trees"))),
    )


@query("s1_registry_scan", f"WITH {adapter.REGISTRY} SELECT {_SHOWN} FROM scan", False)
def s1_registry(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(ingest.scan(adapter.registry(spark, d)))


@query("s2_registry_filter", f"""WITH {adapter.REGISTRY} SELECT {_SHOWN} FROM scan s WHERE EXISTS (SELECT 1 FROM browse_interventions b WHERE b.nct_id = s.nct_id AND b.mesh_term = 'Brand#11')
    AND (brief_title ILIKE '%peptide%' OR official_title ILIKE '%peptide%' OR EXISTS (SELECT 1 FROM brief_summaries x WHERE x.nct_id = s.nct_id AND x.description ILIKE '%peptides%')) ORDER BY nct_id, i_id, c_id LIMIT 40""", False)
def s2_registry(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(ingest.scan(adapter.registry(spark, d), "Brand#11", ingest.KEYWORDS, 40))


@query("j5_tree_numbers", f"WITH {adapter.REGISTRY} SELECT nct_id, terms FROM tree_numbers", False)
def j5(spark: SparkSession, d: str) -> DataFrame:
    t = adapter.registry(spark, d)
    return ingest.tree_numbers(t["browse_conditions"], t["mesh_terms"]).select("nct_id", F.array_join("terms", "|").alias("terms"))


@query("j8_trial_p_values", """s AS (SELECT nct_id FROM trials GROUP BY nct_id HAVING count(DISTINCT intervention) = 1 AND count(DISTINCT indication) = 1), p AS (SELECT nct_id, count(*) AS n, min(p_value) AS least FROM trials SEMI JOIN s USING (nct_id) WHERE phase <> 'Phase 4' GROUP BY 1)
    SELECT t.ord, coalesce(p.n, 0) AS n, p.least, p.n IS NOT NULL AS has_p_values FROM trials t LEFT JOIN p ON p.nct_id = t.nct_id""")
def j8(spark: SparkSession, d: str) -> DataFrame:
    rows = shared.kept(ingest.flagged(trials(spark, d)).select("ord", "nct_id", "phase", "p_value", "is_single_arm"))
    outcomes = rows.select(F.col("ord").alias("outcome_id"), "nct_id", F.when(F.col("phase") != "Phase 4", "PRIMARY").otherwise("SECONDARY").alias("outcome_type"))
    analyses = rows.select(F.col("ord").alias("outcome_id"), "nct_id", "p_value")
    got = ingest.with_p_values(rows, ingest.p_values(outcomes, analyses, rows.where("is_single_arm").select("nct_id")))
    return got.select("ord", F.size("p_values").cast("long").alias("n"), F.array_min(F.col("p_values.p_value")).alias("least"), "has_p_values")


@query("j12_peptides", f"{_CANDS} SELECT candidate_id FROM cands WHERE contains(lower(CASE WHEN modality = 'vaccine' THEN 'Peptide vaccine' ELSE modality END), 'peptide')")
def j12(spark: SparkSession, d: str) -> DataFrame:
    rows = cands(spark, d)
    named = rows.select("candidate_id", F.when(F.col("modality") == "vaccine", "Peptide vaccine").otherwise(F.col("modality")).alias("modality"))
    return ingest.peptides(rows, named).select("candidate_id")


_NAMES = "['FAILED_PHASE_1', 'APPROVED', 'COMMERCIALIZED', 'ONGOING', 'UNKNOWN', 'Approved']"


def _item() -> Column:
    """An adjudication of each event as a reply: names, wrong names, missing ones, dates of several forms."""
    names = F.array(*(F.lit(x) for x in ("FAILED_PHASE_1", "APPROVED", "COMMERCIALIZED", "ONGOING", "UNKNOWN", "Approved")))
    name = F.get(names, (F.col("event_id") % 7).cast("int"))  # null at 6
    day = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyyMMdd")).when(F.col("event_id") % 4 == 2, "soon")
    sure = F.when(F.col("event_id") % 5 == 0, "HIGH").when(F.col("event_id") % 5 == 1, "LOW").when(F.col("event_id") % 5 == 2, "MEDIUM")
    return F.struct(F.lit(1).alias("candidate_index"), name.alias("outcome"), sure.alias("confidence"), F.lit("r").alias("reasoning"), day.alias("approval_date"))


@query("p13_adjudication", f"""WITH e AS (SELECT event_id, {_NAMES}[event_id % 7 + 1] AS name, CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN event_id % 4 IN (0, 1) THEN ts::DATE END AS approval_date FROM events)
    SELECT event_id, CASE name WHEN 'FAILED_PHASE_1' THEN 'Failed Phase 1' WHEN 'APPROVED' THEN 'Approved' WHEN 'COMMERCIALIZED' THEN 'Commercialized' WHEN 'ONGOING' THEN 'Ongoing' ELSE 'Unknown' END AS outcome, confidence, approval_date, confidence <= 0.25 OR coalesce(name, 'UNKNOWN') = 'UNKNOWN' AS unsure FROM e""", False)
def p13(spark: SparkSession, d: str) -> DataFrame:
    answers = adapter.table(spark, d, "events").select(F.array(F.struct(F.lit(1).alias("candidate_index"), F.col("event_id").cast("string").alias("id"))).alias("members"), F.to_json(F.array(_item())).alias("reply"))
    return label.parsed(answers, label.adjudication(), "event_id").select(F.col("event_id").cast("long").alias("event_id"), "outcome", "confidence", "approval_date", "unsure")


@query("p18_fields", f"""{_CANDS}, s AS (SELECT candidate_id, sponsor, min(ord) AS o FROM keyed WHERE sponsor IS NOT NULL GROUP BY ALL), p AS (SELECT candidate_id, string_agg(sponsor, ', ' ORDER BY o) AS sponsors FROM s GROUP BY 1), st0 AS (SELECT candidate_id, status, count(*) AS n FROM keyed GROUP BY ALL), st AS (SELECT candidate_id, string_agg(n || ' ' || status, ', ' ORDER BY status) AS statuses FROM st0 GROUP BY 1)
    SELECT c.candidate_id, '[1]' || chr(10) || 'Drug name: ' || drug_name_raw || chr(10) || 'Indication: ' || c.indication || chr(10) || 'Highest phase reached: ' || highest_phase || chr(10) || 'Number of trials: ' || n_trials || chr(10) || 'Sponsors: ' || coalesce(sponsors, 'Unknown') || chr(10)
        || 'Earliest trial start: ' || strftime(earliest_start, '%Y-%m-%d') || chr(10) || 'Latest trial completion: ' || strftime(latest_completion, '%Y-%m-%d') || chr(10) || 'Trial statuses: ' || statuses AS block FROM cands c LEFT JOIN p ON p.candidate_id = c.candidate_id JOIN st ON st.candidate_id = c.candidate_id""")
def p18(spark: SparkSession, d: str) -> DataFrame:
    rows = cands(spark, d, ids=False, statuses=True).withColumn("candidate_index", F.lit(1))
    return rows.select("candidate_id", label.block(label.adjudication().fields, "statuses").alias("block"))


@query("p38_batches", "WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey::VARCHAR) - 1 AS i FROM part) SELECT p_partkey, i // 50 AS batch, (i % 50 + 1)::INT AS candidate_index FROM n", False)
def p38(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("id"))
    return label.batched(rows, "id").select("p_partkey", "batch", "candidate_index")


@query("p17_requests", """WITH n AS (SELECT p_partkey::VARCHAR AS id, p_name || ' ' || p_partkey AS drug, row_number() OVER (ORDER BY p_partkey::VARCHAR) - 1 AS i FROM part)
    SELECT i // 50 AS batch, string_agg(id, ',' ORDER BY i) AS members, md5('Candidates:' || chr(10) || chr(10) || string_agg('[' || (i % 50 + 1) || ']' || chr(10) || 'Drug name: ' || drug || chr(10) || 'Indication: Unknown', chr(10) || chr(10) ORDER BY i)) AS prompt FROM n GROUP BY 1""", False)
def p17_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("candidate_id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("drug_name_raw"), F.lit("").alias("indication"))
    asked = label.requests(rows, label.classification(), "candidate_id")
    return asked.select("batch", F.array_join("members.id", ",").alias("members"), F.md5("prompt").alias("prompt"))


def _judge(sure: bool) -> label.Model:
    """A stand-in for a model of outcomes: the first tier leaves out one in three and doubts one in five."""

    def call(system: str, prompt: str) -> label.Answer:
        items = []
        for part in prompt.split("\n\n")[1:]:
            lines = dict(x.split(": ", 1) for x in part.split("\n")[1:])
            number = int(lines["Drug name"].rsplit(" ", 1)[-1])
            if sure or number % 3:
                name = "APPROVED" if number % 2 else "FAILED_PHASE_2"
                items.append({"candidate_index": int(part[1 : part.index("]")]), "outcome": name if sure or number % 5 else "UNKNOWN", "confidence": "HIGH", "reasoning": "", "evidence_sources": [lines["Highest phase reached"]], "approval_date": "2001-02-03" if number % 2 else None})
        return label.Answer(json.dumps(items), 100, 10)

    return call


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """A candidate for each part."""
    e = F.expr
    return adapter.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("candidate_id"), F.col("p_name").alias("drug_name"), e("concat(p_name, ' ', p_partkey)").alias("drug_name_raw"), e("concat('i', p_partkey)").alias("indication"), F.lit("Phase 2").alias("highest_phase"), e("array('t')").alias("trial_ids"), e("array('s')").alias("sponsors"),
        e("date'2000-01-01'").alias("earliest_start"), e("cast(null AS date)").alias("latest_completion"), e("CASE WHEN p_partkey % 4 = 0 THEN array('C04.1') WHEN p_partkey % 4 = 1 THEN array('C04.1', 'C18.2') END").alias("trees"),
    )


def _outcome_cache(rows: DataFrame) -> DataFrame:
    """Outcomes of earlier runs for every seventh candidate."""
    key = text.cache_key(F.col("drug_name"), F.col("indication"), F.col("highest_phase"))
    return rows.where("candidate_id % 7 = 0").select(key.alias("cache_key"), F.lit("Ongoing").alias("outcome"), F.lit(0.5).alias("confidence"), F.lit("old").alias("reasoning"), F.expr("array('x')").alias("evidence_sources"), F.lit(None).cast("date").alias("approval_date"), F.lit(None).cast("date").alias("market_date"), F.lit(0).alias("created_at"))


@query("u7_adjudicated", """SELECT p_partkey::VARCHAR AS candidate_id, CASE WHEN p_partkey % 10 = 3 THEN 'Failed Phase 2' WHEN p_partkey % 7 = 0 THEN 'Ongoing' WHEN p_partkey % 2 = 1 THEN 'Approved' ELSE 'Failed Phase 2' END AS outcome, CASE WHEN p_partkey % 10 <> 3 AND p_partkey % 7 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence,
    CASE WHEN p_partkey % 10 <> 3 AND p_partkey % 7 <> 0 AND p_partkey % 2 = 1 THEN DATE '2001-02-03' END AS approval_date, CASE WHEN p_partkey % 10 = 3 THEN '' WHEN p_partkey % 7 = 0 THEN 'x' ELSE 'Phase 2' END AS evidence FROM part""", False)
def u7_adjudicated(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d)
    failures = rows.where("candidate_id % 10 = 3").select("candidate_id", F.lit("Failed Phase 2").alias("outcome"), F.lit(1.0).alias("confidence"))
    got = label.adjudicate(rows, _outcome_cache(rows), _judge(False), _judge(True), F.lit(1), failures)
    return got.labels.select("candidate_id", "outcome", "confidence", "approval_date", F.array_join("evidence_sources", ",").alias("evidence"))


@query("u7_outcome_cache", """SELECT sha256(lower(p_name) || '|i' || p_partkey || '|phase 2') AS cache_key, CASE WHEN p_partkey % 7 = 0 THEN 'Ongoing' WHEN p_partkey % 2 = 1 THEN 'Approved' ELSE 'Failed Phase 2' END AS outcome, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS created_at FROM part""", False)
def u7_cache(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d)
    return label.adjudicate(rows, _outcome_cache(rows), _judge(False), _judge(True), F.lit(1)).cache.select("cache_key", "outcome", "created_at")


@query("u7_classified", """SELECT p_partkey::VARCHAR AS candidate_id, CASE WHEN p_partkey % 2 = 1 THEN 'peptide' ELSE 'vaccine' END AS modality, CASE WHEN p_partkey % 4 = 0 THEN 'oncology' ELSE 'autoimmune' END AS disease_area, CASE WHEN p_partkey % 4 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS disease_confidence FROM part""", False)
def u7_classified(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "cache_key string, modality string, disease_area string, modality_confidence double, disease_confidence double, reasoning string, created_at int")
    return label.classify(_parts(spark, d), none, _answer(False), _answer(True), F.lit(1)).labels.select("candidate_id", "modality", "disease_area", "disease_confidence")


@query("u7_ledger", """WITH p AS (SELECT count(*) FILTER (p_partkey % 7 <> 0) AS asked, count(*) FILTER (p_partkey % 7 <> 0 AND (p_partkey % 3 = 0 OR p_partkey % 5 = 0)) AS again, count(*) FILTER (p_partkey % 7 = 0) AS hits FROM part)
    SELECT 'Adjudication' AS stage, (100 * (ceil(asked / 50.0) + ceil(again / 50.0)))::BIGINT AS input_tokens, asked + again AS asked, hits AS cache_hits, asked AS tier1_asked, again AS tier2_asked FROM p""", False)
def u7_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d)
    entries = label.adjudicate(rows, _outcome_cache(rows), _judge(False), _judge(True), F.lit(1)).entries
    return label.ledger(entries).select("stage", "input_tokens", "asked", "cache_hits", "tier1_asked", "tier2_asked")


_TWICE = "count(*) AS n, count(*) FILTER (p_partkey % 3 = 0 OR p_partkey % 5 = 0) AS again FROM part"


@query("u2_request_journal", f"""WITH p AS (SELECT {_TWICE})
    SELECT 1 AS run, (100 * (ceil(n / 50.0) + ceil(again / 50.0)))::BIGINT AS input_tokens, n + again AS asked, 0::BIGINT AS cache_hits, round(0.0005 * ceil(n / 50.0) - 0.00005 * ceil(n / 50.0) + 0.00075 * ceil(again / 50.0), 9)::DOUBLE AS cost FROM p
    UNION ALL SELECT 2, 0, 0, n + again, 0.0 FROM p""", False)
def u2_journal(spark: SparkSession, d: str) -> DataFrame:
    """The ledgers of two runs with one journal: the second finds every answer of the first, and its models are never called."""
    path, rows = f"{shared.folder(spark)}/journal-{uuid.uuid4().hex}", _parts(spark, d)
    out = []
    for run, models in enumerate(((_judge(False), _judge(True)), (_refusing(), _refusing())), 1):
        got = label.tiered(rows, label.adjudication(), *models, book=Journal(path))
        out.append(label.ledger(got.entries).select(F.lit(run).alias("run"), "input_tokens", "asked", "cache_hits", F.round("cost", 9).alias("cost")))
        Journal(path).seal(spark)
    shared.delete(spark, path)  # the answers of both runs are kept
    return out[0].unionByName(out[1])


def _refusing() -> label.Model:
    def call(system: str, prompt: str) -> None:
        raise RuntimeError("nothing is to be asked")

    return call


@query("u7_side_by_side", f"""WITH p AS (SELECT {_TWICE}), q AS (SELECT count(*) FILTER (p_partkey % 7 <> 0) AS n, count(*) FILTER (p_partkey % 7 <> 0 AND (p_partkey % 3 = 0 OR p_partkey % 5 = 0)) AS again, count(*) FILTER (p_partkey % 7 = 0) AS hits FROM part)
    SELECT 'Classification' AS stage, 0::BIGINT AS input_tokens, n + again AS asked, 0::BIGINT AS cache_hits, n AS tier1_asked, again AS tier2_asked, n AS labels FROM p
    UNION ALL SELECT 'Adjudication', (100 * (ceil(n / 50.0) + ceil(again / 50.0)))::BIGINT, n + again, hits, n, again, n + hits FROM q""", False)
def u7_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Both stages at the same time, and the ledger's rows of both."""
    rows = _parts(spark, d)
    none = spark.createDataFrame([], "cache_key string, modality string, disease_area string, modality_confidence double, disease_confidence double, reasoning string, created_at int")
    got = stages.run(spark, {
        "Classification": lambda: label.classify(rows, none, _answer(False), _answer(True), F.lit(1)),
        "Adjudication": lambda: label.adjudicate(rows, _outcome_cache(rows), _judge(False), _judge(True), F.lit(1)),
    }).results
    made = [got[x].labels.agg(F.lit(x).alias("stage"), F.count("*").alias("labels")) for x in got]
    entries = got["Classification"].entries.unionByName(got["Adjudication"].entries)
    return label.ledger(entries).join(made[0].unionByName(made[1]), "stage").select("stage", "input_tokens", "asked", "cache_hits", "tier1_asked", "tier2_asked", "labels")


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Label rows of the parts: some usable, some not, some repeated, some blank."""
    e = F.expr
    return adapter.table(spark, d, "part").select(
        e("concat(' ', upper(p_name), ' ')").alias("drug_name"), e("concat('I ', p_size)").alias("indication"), e("CASE p_partkey % 6 WHEN 0 THEN 'Positive ' WHEN 1 THEN 'negative' WHEN 2 THEN 'unknown' WHEN 3 THEN '' ELSE 'negative' END").alias("commercialization_label"),
        e("CASE p_partkey % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'ambiguous' WHEN 2 THEN NULL ELSE 'negative' END").alias("approval_label"), F.col("p_partkey").alias("ord"), "p_brand",
    )


_REVIEWED = """r AS (SELECT ' ' || upper(p_name) || ' ' AS drug_name, 'I ' || p_size AS indication, CASE p_partkey % 6 WHEN 0 THEN 'Positive ' WHEN 1 THEN 'negative' WHEN 2 THEN 'unknown' WHEN 3 THEN '' ELSE 'negative' END AS c, CASE p_partkey % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'ambiguous' WHEN 2 THEN NULL ELSE 'negative' END AS a, p_partkey AS ord, p_name, p_size FROM part),
    u AS (SELECT lower(p_name) AS drug, 'i ' || p_size AS match, coalesce(a, '') AS approval_label, lower(trim(c)) AS commercialization_label, ord FROM r WHERE c <> 'unknown' AND coalesce(a, '') <> 'ambiguous'), l AS (SELECT *, row_number() OVER (PARTITION BY drug, match ORDER BY ord DESC) AS rn FROM u)"""


@query("s12_raw_labels", f"WITH {_REVIEWED} SELECT drug, match, approval_label, commercialization_label FROM l WHERE rn = 1", False)
def s12(spark: SparkSession, d: str) -> DataFrame:
    return readers.raw_labels(_reviewed(spark, d)).select("drug", "match", "approval_label", "commercialization_label")


@query("s11_skipped", f"WITH {_REVIEWED} SELECT count(*) FILTER (c = 'unknown' OR coalesce(a, '') = 'ambiguous') AS skipped FROM r", False)
def s11_skipped(spark: SparkSession, d: str) -> DataFrame:
    return readers.skipped(_reviewed(spark, d))


_PREDICTED = "p AS (SELECT lower(p_name) AS drug, 'i ' || p_size AS match, CASE p_partkey % 4 WHEN 0 THEN 'commercialized' WHEN 1 THEN 'approved' ELSE 'investigational' END AS predicted, row_number() OVER (PARTITION BY lower(p_name), p_size ORDER BY p_partkey DESC) AS rn FROM part WHERE p_partkey % 3 <> 0)"


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.table(spark, d, "part").where("p_partkey % 3 != 0")
    return readers.predictions(rows.select(F.col("p_name").alias("drug_name"), F.expr("concat('I  ', p_size)").alias("indication"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'COMMERCIALIZED' WHEN 1 THEN ' Approved ' WHEN 2 THEN 'Ongoing' ELSE 'nonsense' END").alias("outcome"), F.col("p_partkey").alias("ord")))


@query("s13_predictions", f"WITH {_PREDICTED} SELECT drug, match AS indication, predicted FROM p WHERE rn = 1", False)
def s13(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d)


@query("a29_label_errors", f"""WITH {_REVIEWED}, {_PREDICTED}, x AS (SELECT l.drug, l.match, p.predicted, t.task, CASE t.task WHEN 'approval' THEN approval_label ELSE commercialization_label END AS label, CASE t.task WHEN 'approval' THEN p.predicted <> 'investigational' ELSE p.predicted = 'commercialized' END AS says
        FROM l JOIN p ON p.drug = l.drug AND p.match = l.match AND l.rn = 1 AND p.rn = 1 CROSS JOIN (VALUES ('approval'), ('commercialization')) AS t(task))
    SELECT drug, match, predicted, task, CASE WHEN says THEN 'FP' ELSE 'FN' END AS error FROM x WHERE says AND label = 'negative' OR NOT says AND label = 'positive'""", False)
def a29_labels(spark: SparkSession, d: str) -> DataFrame:
    got = evaluate.label_errors(readers.raw_labels(_reviewed(spark, d)), _predicted(spark, d))
    return got.select(text.match_key(F.col("drug_name")).alias("drug"), text.match_key(F.col("indication")).alias("match"), "predicted", "task", "error")


@query("p36_review_order", f"WITH {_REVIEWED} SELECT drug_name, indication, ord FROM r WHERE NOT (coalesce(c, '') <> '' AND coalesce(a, '') <> '') ORDER BY lower(drug_name), drug_name, indication", False)
def p36(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.review_order(_reviewed(spark, d)).select("drug_name", "indication", "ord")


@query("p34_prompts", """SELECT p_partkey, '[' || p_partkey || '] ' || trim(p_name) || ' / ' || CASE WHEN p_size > 30 THEN 'Unknown' ELSE 's' || p_size END || chr(10) || 'Drug name: ' || trim(p_name) || chr(10) || 'Indication: ' || CASE WHEN p_size > 30 THEN 'Unknown' ELSE 's' || p_size END || chr(10)
    || 'Highest phase reached: Unknown' || chr(10) || 'Number of trials: (see trial record)' || chr(10) || 'Sponsors: ' || p_brand || chr(10) || 'Earliest trial start: Unknown' || chr(10) || 'Latest trial completion: Unknown' AS prompt FROM part""", False)
def p34(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_name").alias("drug_name"), F.expr("CASE WHEN p_size <= 30 THEN concat('s', p_size) WHEN p_size < 40 THEN '  ' END").alias("indication"), F.lit("").alias("highest_phase"), F.col("p_brand").alias("sponsors"))
    return evaluate.prompts(rows, "p_partkey")


@query("s21_approval_texts", "WITH n AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS name FROM part WHERE p_size < 40), l AS (SELECT DISTINCT p_name AS query FROM part WHERE p_name NOT LIKE 'red%') SELECT name, CASE WHEN l.query IS NULL THEN '' ELSE 'for ' || l.query || ' | and more' END AS indications FROM n LEFT JOIN l ON lower(n.name) = l.query", False)
def s21(spark: SparkSession, d: str) -> DataFrame:
    part = adapter.table(spark, d, "part")
    names = part.where("p_size < 40").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("name"))
    labels = part.where("p_name NOT LIKE 'red%'").select(F.col("p_name").alias("query")).distinct().withColumn("indications", F.array(F.concat(F.lit("for "), "query"), F.lit("and more")))
    return evaluate.approval_texts(names, labels)


@query("l7_shuffled", "SELECT p_partkey, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) AS at FROM part", False)
def l7(spark: SparkSession, d: str) -> DataFrame:
    """The shuffled order as numbers, which no single task gives out."""
    rows = adapter.table(spark, d, "part").select("p_partkey", evaluate.turn("p_partkey", 42).alias("turn"))
    return numbering.ordered(rows, "turn", "p_partkey").select("p_partkey", "at")
