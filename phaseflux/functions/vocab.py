"""The vocabularies, ranks and lookup tables that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PHASES = {
    "PHASE 1": "Phase 1", "PHASE1": "Phase 1", "EARLY PHASE 1": "Phase 1", "PHASE 1/PHASE 2": "Phase 2", "PHASE 1/2": "Phase 2", "PHASE 2": "Phase 2", "PHASE2": "Phase 2",
    "PHASE 2/PHASE 3": "Phase 3", "PHASE 2/3": "Phase 3", "PHASE 3": "Phase 3", "PHASE3": "Phase 3", "PHASE 4": "Phase 4", "PHASE4": "Phase 4", "N/A": "N/A", "NA": "N/A", "NOT APPLICABLE": "N/A",
}
STATUSES = {
    "RECRUITING": "Recruiting", "NOT YET RECRUITING": "Recruiting", "ENROLLING BY INVITATION": "Recruiting", "COMPLETED": "Completed", "TERMINATED": "Terminated", "WITHDRAWN": "Withdrawn",
    "ACTIVE, NOT RECRUITING": "Active, not recruiting", "ACTIVE_NOT_RECRUITING": "Active, not recruiting", "SUSPENDED": "Active, not recruiting",
}
PHASE_RANK = {"Unknown": 0, "N/A": 1, "Phase 1": 2, "Phase 2": 3, "Phase 3": 4, "Phase 4": 5}
FUNNEL_LEVEL = {"Phase 1": 0, "Phase 2": 1, "Phase 3": 2, "Approval": 3, "Market": 4}
STAGES = ("Phase 1", "Phase 2", "Phase 3", "Approval", "Market")
CONFIDENCE = {"HIGH": 1.0, "MEDIUM": 0.5, "LOW": 0.25}
OUTCOMES = {
    "FAILED_PHASE_1": "Failed Phase 1", "FAILED_PHASE_2": "Failed Phase 2", "FAILED_PHASE_3": "Failed Phase 3", "APPROVED": "Approved", "COMMERCIALIZED": "Commercialized", "ONGOING": "Ongoing", "UNKNOWN": "Unknown",
}
STEP_LABELS = {"Phase 1": "P1→P2", "Phase 2": "P2→P3", "Phase 3": "P3→Appr", "Approval": "Appr→Mkt"}
BUCKETS = {"Commercialized": "commercialized", "Approved": "approved"}
MODALITIES = ("peptide", "small_molecule", "monoclonal_antibody", "bispecific_antibody", "adc", "fusion_protein", "sirna", "antisense", "mrna", "cell_therapy", "gene_therapy", "vaccine", "unknown")
AREAS = {
    "oncology": "Oncology", "cardiovascular": "Cardiovascular", "metabolic": "Metabolic", "neurology": "Neurology", "autoimmune": "Autoimmune", "infectious_disease": "Infectious disease", "respiratory": "Respiratory",
    "hematology": "Hematology", "ophthalmology": "Ophthalmology", "psychiatry": "Psychiatry", "gastroenterology": "Gastroenterology", "endocrine": "Endocrine", "urology": "Urology", "other": "Others", "unknown": "Others",
}
AREA_ALIASES = {
    "immunology": "autoimmune", "allergy": "autoimmune", "endocrinology": "endocrine", "addiction": "psychiatry", "hepatology": "gastroenterology", "vascular": "cardiovascular",
    "dermatology": "other", "musculoskeletal": "other", "reproductive_health": "other", "nephrology": "other", "rare_disease": "other", "anesthesiology": "other", "pain_management": "other",
    "transplant": "other", "dentistry": "other", "pediatrics": "other", "radiology": "other", "otolaryngology": "other", "surgery": "other", "emergency_medicine": "other", "critical_care": "other",
    "neonatology": "other", "geriatrics": "other", "rheumatology": "other", "reproductive": "other", "gynecology": "other", "obstetrics": "other", "pain": "other", "anesthesia": "other",
    "transplantation": "other", "dental": "other", "drug_safety": "other", "research_tool": "other", "diagnostic": "other", "general_health": "other", "nutrition": "other", "toxicology": "other",
    "wound_care": "other", "plastic_surgery": "other",
}
TREES = {
    "C01": "infectious_disease", "C02": "infectious_disease", "C03": "infectious_disease", "C04": "oncology", "C06": "gastroenterology", "C08": "respiratory", "C10": "neurology", "C11": "ophthalmology",
    "C12": "urology", "C14": "cardiovascular", "C15": "hematology", "C18": "metabolic", "C19": "endocrine", "C20": "autoimmune", "F03": "psychiatry",
}
APPLICATION_URL = "https://www.accessdata.fda.gov/scripts/cder/daf/index.cfm?event=overview.process&ApplNo="
# Words for a ratio of at least so much, below those with a number; without a bound; the least.
FOLDS = ((1.3, "substantially higher than"), (1.05, "slightly higher than"), (0.95, "comparable to"), (0.7, "slightly lower than"))
INFINITE, FEWEST = "infinitely higher than", "substantially lower than"
SALTS = ("hcl", "hydrochloride", "sodium", "potassium", "acetate", "sulfate", "mesylate", "tartrate", "maleate", "fumarate", "phosphate")
DRUG_NOISE = (
    "placebo", "sham", "control", "controls", "comparator", "active", "standard", "best", "available", "therapy", "bat", "injectable", "injection", "iv", "sc", "sq", "po", "oral", "intravenous", "subcutaneous",
    "solution", "powder", "tablet", "capsule", "suspension", "infusion", "bolus", "extended", "release", "delayed", "immediate", "sustained", "modified", "dose", "dosing", "fixed", "protocol", "regimen", "arm",
    "group", "saline", "electrolyte", "glucose", "amino", "acid", "acids",
)
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5"}


def case(column: Column, table: dict) -> Column:
    """The table's value of a column as a CASE: cheaper than a map within a lambda, where maps are built again for each element."""
    out = F
    for key, value in table.items():
        out = out.when(column == key, value)
    return out


def lookup(column: Column, table: dict, default: object = None) -> Column:
    """The table's value of a column, as one literal map."""
    found = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[column]
    return found if default is None else F.coalesce(found, F.lit(default))
