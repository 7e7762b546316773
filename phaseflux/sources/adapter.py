"""The clinical data model as a view of the star schema: one trial row per line item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODALITY = {"STANDARD": "small_molecule", "ECONOMY": "peptide", "PROMO": "monoclonal_antibody", "LARGE": "vaccine", "SMALL": "gene_therapy", "MEDIUM": "polymer"}
AREA = {"MACHINERY": "Oncology", "BUILDING": "endocrinology", "AUTOMOBILE": "Infectious Disease", "FURNITURE": "dermatology", "HOUSEHOLD": "mystery"}
TREE = {"0": "C04", "1": "C18", "2": "C10", "3": "C04", "4": "F03", "5": "C05"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table from which its files are worth several tasks as they are: Spark splits them at their row groups.
_SPLIT = 64 << 20


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to all cores where there are fewer files than cores: a file may be one row group, and then a single
    task would read it and do all that is computed before the first shuffle. With more files, or with files of many row groups, rows
    stay where they are read: a shuffle of the whole table would only come on top of those of its joins."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    small = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < _SPLIT
    return frame.repartition(cores, *keys) if small and len(frame.inputFiles()) < cores else frame


#: Bytes of shuffled rows that a task of the view takes: they unpack to twenty times as much, in a sort or a table of groups.
_TASK = 16 << 20


def compiled(spark: SparkSession) -> None:
    """Lets Spark split a projection whose generated method is beyond the 8000 bytes up to which HotSpot compiles one; the view's are
    wide, and a method that stays interpreted takes most of a query's time. Tasks after a shuffle are of `_TASK` bytes instead of
    Spark's 64 MB, of which the view's narrow rows pack too many. Lower limits of the session's own stay."""
    bytes_ = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most, read in (("spark.sql.codegen.hugeMethodLimit", 8000, int), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", _TASK, bytes_)):
        if read(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))


def _of(table_: dict, column: str) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial rows in source form; `ord` is unique and stands for the source's order.

    Large sides meet by key; nation has a row per country, and Spark's own size check decides on its broadcast. What hangs on an
    order is joined before line items come to it, so that their rows are shuffled by order and by part, and no third time. Line
    items and orders meet by shuffles at every size: a packed file's few bytes would pass the size check, and the few tasks
    that read orders would then make all rows.
    """
    compiled(spark)
    line, orders, part = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "part"))
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    line = spread(line, "l_orderkey", "l_linenumber")
    owners = orders.join(customer.join(nation, customer.c_nationkey == nation.n_nationkey), orders.o_custkey == customer.c_custkey)
    rows = line.join(owners.hint("merge"), line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    e = F.expr
    rows = rows.select(
        F.concat(F.lit("NCT"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("nct_id"),
        F.concat_ws(":", *(F.lpad(F.col(c).cast("string"), 10, "0") for c in ("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.date_format("l_shipdate", "yyyyMMdd")).alias("ord"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("intervention"), "p_name", "p_brand", F.col("n_name").alias("indication"),
        e("nullif(c_name, 'Customer#000000007')").alias("sponsor"),
        e("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Phase 1' WHEN '2' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Phase 1/Phase 2' ELSE 'PHASE2' END WHEN '3' THEN 'Phase 3' WHEN '4' THEN 'N/A' ELSE 'Phase 4' END").alias("phase_text"),
        e("CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Not yet recruiting' ELSE CASE l_linestatus WHEN 'F' THEN 'Terminated' ELSE 'withdrawn' END END").alias("status_text"),
        F.col("o_orderdate").cast("date").alias("start_date"), F.col("l_shipdate").cast("date").alias("completion_date"),
        e(_of(MODALITY, "p_type")).alias("modality_text"), e(_of(AREA, "c_mktsegment")).alias("area_text"),
        e("CASE o_orderkey % 8 WHEN 0 THEN 'Failed Phase 1' WHEN 1 THEN 'Failed Phase 2' WHEN 2 THEN 'Failed Phase 3' WHEN 3 THEN 'Approved' WHEN 4 THEN 'Commercialized' WHEN 5 THEN 'Ongoing' WHEN 6 THEN 'Unknown' END").alias("outcome_text"),
        F.col("l_discount").alias("p_value"), F.col("l_quantity").cast("int").alias("quantity"),
        e("CASE WHEN p_size % 3 = 0 THEN array() ELSE array(lower(p_brand)) END").alias("mesh_drug_terms"),
        e("CASE WHEN n_regionkey = 2 THEN array() WHEN n_regionkey = 3 THEN array(concat('Region ', n_regionkey), upper(n_name)) ELSE array(concat(' region ', n_regionkey, ' ')) END").alias("mesh_condition_terms"),
        F.array(F.concat(e(_of(TREE, "cast(p_partkey % 6 AS string)")), F.lit(".588")), F.concat(e(_of(TREE, "cast(l_suppkey % 6 AS string)")), F.lit(".180"))).alias("trees"),
    )
    return rows


#: The same view in DuckDB's SQL, the start of every oracle on trials.
SQL = f"""trials AS (
    SELECT 'NCT' || lpad(o_orderkey::VARCHAR, 8, '0') AS nct_id,
        lpad(o_orderkey::VARCHAR, 10, '0') || ':' || lpad(l_linenumber::VARCHAR, 10, '0') || ':' || lpad(l_partkey::VARCHAR, 10, '0') || ':' || lpad(l_suppkey::VARCHAR, 10, '0') || ':' || strftime(l_shipdate, '%Y%m%d') AS ord,
        p_name || ' ' || p_partkey AS intervention, p_name, p_brand, n_name AS indication, nullif(c_name, 'Customer#000000007') AS sponsor,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Phase 1' WHEN '2' THEN 'Phase 2' WHEN '3' THEN 'Phase 3' WHEN '4' THEN 'N/A' ELSE 'Phase 4' END AS phase,
        CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Recruiting' ELSE CASE l_linestatus WHEN 'F' THEN 'Terminated' ELSE 'Withdrawn' END END AS status,
        o_orderdate::DATE AS start_date, l_shipdate::DATE AS completion_date,
        CASE p_type WHEN 'STANDARD' THEN 'small_molecule' WHEN 'ECONOMY' THEN 'peptide' WHEN 'PROMO' THEN 'monoclonal_antibody' WHEN 'LARGE' THEN 'vaccine' WHEN 'SMALL' THEN 'gene_therapy' ELSE 'unknown' END AS modality,
        CASE c_mktsegment WHEN 'MACHINERY' THEN 'oncology' WHEN 'BUILDING' THEN 'endocrine' WHEN 'AUTOMOBILE' THEN 'infectious_disease' WHEN 'FURNITURE' THEN 'other' ELSE 'unknown' END AS disease_area,
        CASE o_orderkey % 8 WHEN 0 THEN 'Failed Phase 1' WHEN 1 THEN 'Failed Phase 2' WHEN 2 THEN 'Failed Phase 3' WHEN 3 THEN 'Approved' WHEN 4 THEN 'Commercialized' WHEN 5 THEN 'Ongoing' WHEN 6 THEN 'Unknown' END AS outcome,
        l_discount AS p_value, l_quantity::INT AS quantity, CASE WHEN p_size % 3 = 0 THEN NULL ELSE lower(p_brand) END AS mesh_drug,
        CASE WHEN n_regionkey = 2 THEN NULL WHEN n_regionkey = 3 THEN lower(n_name) || '|region 3' ELSE 'region ' || n_regionkey END AS mesh_conditions,
        {_of(TREE, "CAST(p_partkey % 6 AS VARCHAR)")} || '.588' AS tree1, {_of(TREE, "CAST(l_suppkey % 6 AS VARCHAR)")} || '.180' AS tree2
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def registry(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The registry's tables as views of the star schema: studies and what hangs on them, keyed by nct_id."""
    line, orders, part = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "part"))
    customer, nation, supplier = (table(spark, sf_dir, x) for x in ("customer", "nation", "supplier"))
    nct = lambda c: F.concat(F.lit("NCT"), F.lpad(F.col(c).cast("string"), 8, "0")).alias("nct_id")
    e = F.expr
    at = F.concat_ws(":", *(F.lpad(F.col(c).cast("string"), 10, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.date_format("l_shipdate", "yyyyMMdd")).alias("id")
    drugs = line.join(part, line.l_partkey == part.p_partkey)
    owners = orders.join(customer, orders.o_custkey == customer.c_custkey)
    places = owners.join(nation, owners.c_nationkey == nation.n_nationkey)
    region = F.concat(F.lit("Region "), F.col("n_regionkey").cast("string"))
    return {
        "studies": orders.select(
            nct("o_orderkey"), e("CASE WHEN o_orderkey % 10 = 9 THEN 'Observational' ELSE 'Interventional' END").alias("study_type"), e("concat('Study ', o_orderpriority)").alias("brief_title"),
            e("concat('A study of ', CASE WHEN o_orderkey % 11 = 0 THEN 'PEPTIDE' ELSE 'drug' END, ' ', o_custkey)").alias("official_title"), F.col("o_orderpriority").alias("phase"), F.col("o_orderstatus").alias("overall_status"),
            F.col("o_orderdate").cast("date").alias("start_date"), F.date_add(F.col("o_orderdate").cast("date"), F.pmod("o_orderkey", F.lit(900)).cast("int")).alias("completion_date"),
        ),
        "interventions": drugs.select(at, nct("l_orderkey"), e("CASE WHEN l_linenumber % 4 = 3 THEN 'Device' ELSE 'Drug' END").alias("intervention_type"), e("concat(p_name, ' ', p_partkey)").alias("name")),
        "conditions": places.select(F.col("o_orderkey").alias("id"), nct("o_orderkey"), F.col("n_name").alias("name")).unionByName(
            places.where("o_orderkey % 5 = 0").select((-F.col("o_orderkey")).alias("id"), nct("o_orderkey"), region.alias("name"))
        ),
        "sponsors": owners.where("o_orderkey % 13 != 0").select(F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("id"), nct("o_orderkey"), F.col("c_name").alias("name"), F.lit("lead").alias("lead_or_collaborator")).unionByName(
            line.join(supplier, line.l_suppkey == supplier.s_suppkey).select(F.concat(F.lit("a"), at).alias("id"), nct("l_orderkey"), F.col("s_name").alias("name"), e("CASE WHEN l_linenumber = 6 THEN 'lead' ELSE 'collaborator' END").alias("lead_or_collaborator"))
        ),
        "browse_interventions": drugs.select(nct("l_orderkey"), e("CASE WHEN p_size % 3 <> 0 THEN p_brand END").alias("mesh_term")),
        "browse_conditions": places.select(nct("o_orderkey"), region.alias("mesh_term"), F.lower(region).alias("downcase_mesh_term")),
        "mesh_terms": table(spark, sf_dir, "region").select(e("concat('region ', r_regionkey)").alias("downcase_mesh_term"), F.explode(e("array(concat('C', r_regionkey, '4'), concat('F0', r_regionkey), concat('Z0', r_regionkey), CASE WHEN r_regionkey = 1 THEN 'C04' END)")).alias("tree_number")),
        "brief_summaries": line.select(nct("l_orderkey"), e("CASE WHEN l_quantity > 49 THEN concat('of Peptides ', l_returnflag) ELSE 'none' END").alias("description")),
    }


_NCT = "'NCT' || lpad({}::VARCHAR, 8, '0')"
_ID = "lpad(l_orderkey::VARCHAR, 10, '0') || ':' || lpad(l_linenumber::VARCHAR, 10, '0') || ':' || lpad(l_partkey::VARCHAR, 10, '0') || ':' || lpad(l_suppkey::VARCHAR, 10, '0') || ':' || strftime(l_shipdate, '%Y%m%d')"
#: The same tables in DuckDB's SQL.
REGISTRY = f"""studies AS (SELECT {_NCT.format('o_orderkey')} AS nct_id, CASE WHEN o_orderkey % 10 = 9 THEN 'Observational' ELSE 'Interventional' END AS study_type, 'Study ' || o_orderpriority AS brief_title,
        'A study of ' || CASE WHEN o_orderkey % 11 = 0 THEN 'PEPTIDE' ELSE 'drug' END || ' ' || o_custkey AS official_title, o_orderdate::DATE AS start_date, o_orderdate::DATE + (o_orderkey % 900)::INT AS completion_date FROM orders),
    interventions AS (SELECT {_ID} AS id, {_NCT.format('l_orderkey')} AS nct_id, CASE WHEN l_linenumber % 4 = 3 THEN 'Device' ELSE 'Drug' END AS intervention_type, p_name || ' ' || p_partkey AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
    places AS (SELECT o_orderkey, n_name, n_regionkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    conditions AS (SELECT o_orderkey AS id, {_NCT.format('o_orderkey')} AS nct_id, n_name AS name FROM places UNION ALL SELECT -o_orderkey, {_NCT.format('o_orderkey')}, 'Region ' || n_regionkey FROM places WHERE o_orderkey % 5 = 0),
    sponsors AS (SELECT 'b' || o_orderkey AS id, {_NCT.format('o_orderkey')} AS nct_id, c_name AS name, 'lead' AS lead_or_collaborator FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 13 <> 0
        UNION ALL SELECT 'a' || {_ID}, {_NCT.format('l_orderkey')}, s_name, CASE WHEN l_linenumber = 6 THEN 'lead' ELSE 'collaborator' END FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    browse_interventions AS (SELECT {_NCT.format('l_orderkey')} AS nct_id, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS mesh_term FROM lineitem JOIN part ON l_partkey = p_partkey),
    browse_conditions AS (SELECT {_NCT.format('o_orderkey')} AS nct_id, 'Region ' || n_regionkey AS mesh_term, 'region ' || n_regionkey AS downcase_mesh_term FROM places),
    mesh_terms AS (SELECT 'region ' || r_regionkey AS downcase_mesh_term, unnest(['C' || r_regionkey || '4', 'F0' || r_regionkey, 'Z0' || r_regionkey, CASE WHEN r_regionkey = 1 THEN 'C04' END]) AS tree_number FROM region),
    brief_summaries AS (SELECT {_NCT.format('l_orderkey')} AS nct_id, CASE WHEN l_quantity > 49 THEN 'of Peptides ' || l_returnflag ELSE 'none' END AS description FROM lineitem),
    drug_terms AS (SELECT nct_id, array_to_string(list_sort(list(DISTINCT mesh_term)), '|') AS terms FROM browse_interventions WHERE mesh_term IS NOT NULL GROUP BY 1),
    condition_terms AS (SELECT nct_id, array_to_string(list_sort(list(DISTINCT mesh_term)), '|') AS terms FROM browse_conditions GROUP BY 1),
    tree_numbers AS (SELECT nct_id, array_to_string(list_sort(list(DISTINCT tree_number)), '|') AS terms FROM browse_conditions JOIN mesh_terms USING (downcase_mesh_term) WHERE tree_number LIKE 'C%' OR tree_number LIKE 'F%' GROUP BY 1),
    leads AS (SELECT nct_id, arg_min(name, id) AS sponsor FROM sponsors WHERE lead_or_collaborator = 'lead' GROUP BY 1),
    scan AS (SELECT s.nct_id, i.id AS i_id, c.id AS c_id, s.brief_title, s.official_title, s.start_date, s.completion_date, i.name AS intervention, c.name AS indication, l.sponsor, coalesce(d.terms, '') AS drug_terms, coalesce(k.terms, '') AS condition_terms, coalesce(n.terms, '') AS trees
        FROM studies s JOIN interventions i ON i.nct_id = s.nct_id AND upper(i.intervention_type) = 'DRUG' JOIN conditions c ON c.nct_id = s.nct_id LEFT JOIN leads l ON l.nct_id = s.nct_id
        LEFT JOIN drug_terms d ON d.nct_id = s.nct_id LEFT JOIN condition_terms k ON k.nct_id = s.nct_id LEFT JOIN tree_numbers n ON n.nct_id = s.nct_id WHERE upper(s.study_type) = 'INTERVENTIONAL')"""
