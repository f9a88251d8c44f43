"""What an extraction domain looks for: patterns, dictionaries, columns and aliases, as data.

Patterns are for Spark's regular expressions; `words()` gives them the case and character
classes of the extraction rules."""

from __future__ import annotations

from dataclasses import dataclass, field

MISSING = "NOT_DETECTED"
NOT_AVAILABLE = "not available"
TABLE_LIKE = "table_like_text"


def words(pattern: str) -> str:
    """Ignore case, and let \\s, \\w, \\d and \\b know all of Unicode."""
    return f"(?iuU){pattern}"


@dataclass(frozen=True)
class Term:
    category: str
    name: str
    pattern: str


@dataclass(frozen=True)
class DomainSpec:
    """Everything about a domain that the operators need."""

    name: str
    columns: tuple[str, ...]
    interesting: str = ""
    promote: str = ""
    section_hint: str = ""
    terms: tuple[Term, ...] = ()
    weights: dict[str, float] = field(default_factory=dict)
    default_weight: float = 0.25
    gate: tuple[str, ...] = ()
    plan_terms: tuple[tuple[str, str, float], ...] = ()
    required: tuple[str, ...] = ()
    assay: str = ""
    compound: str = ""
    entity: str = ""


# Fixed values of the first domain (seven columns) -----------------------------------------
RECORD_COLUMNS = ("compound_id", "smiles", "target_type", "target_relation", "target_value", "target_units", "bacteria")
REQUIRED = ("compound_id", "target_type", "target_value", "target_units", "bacteria")

_UNITS = "µg/mL|μg/mL|ug/mL|mcg/mL|microg/mL|mg/L|mmol/L|mmol/l"

ASSAYS = DomainSpec(
    name="assays",
    columns=RECORD_COLUMNS,
    interesting=words(r"\b(?:p?MIC|S\.?\s*aureus|Staph(?:ylococcus)?\.?\s*aureus|E\.?\s*coli|Escherichia\s+coli)\b"),
    promote=words(r"\b(?:MRSA\s*)?MIC\b|\b(?:MSSA|MRSA|ASSM|ASRM)\b"),
    section_hint=words(r"biological\s+activity|antimicrobial|antibacterial|minimum\s+inhibitory|microbiological"),
    terms=(
        Term("assay", "MIC", words(r"\bMIC\b")),
        Term("assay", "pMIC", words(r"\bpMIC\b")),
        Term("assay", "minimum inhibitory concentration", words(r"minimum\s+inhibitory\s+concentration")),
        Term("bacteria", "Staphylococcus aureus", words(r"Staphylococcus\s+aureus|S\.?\s*aureus")),
        Term("bacteria", "Escherichia coli", words(r"Escherichia\s+coli|E\.?\s*coli")),
        Term("unit", "µg/mL", words(r"µg/mL|μg/mL|ug/mL|mcg/mL|microg/mL")),
        Term("unit", "mg/L", words(r"mg/L")),
        Term("unit", "mmol/L", words(r"mmol/L")),
        Term("compound", "compound id", words(r"\b(?:compound\s+)?\d+[a-z]{1,3}\b")),
        Term("section", "biological activity", words(r"biological\s+activity|antimicrobial|antibacterial")),
        Term("table", "table", words(r"\btable\s+\d+|caption")),
    ),
    weights={"assay": 3.0, "bacteria": 2.0, "unit": 1.5, "compound": 1.0, "section": 1.0, "table": 0.5},
    gate=("assay", "bacteria"),
    plan_terms=(
        ("pMIC", words(r"\bpMIC\b"), 5.0),
        ("MIC", words(r"\bMIC\b"), 4.0),
        ("Staphylococcus aureus", words(r"\b(?:S\.?\s*aureus|Staph(?:ylococcus)?\.?\s*aureus|MSSA|MRSA)\b"), 3.0),
        ("Escherichia coli", words(r"\b(?:E\.?\s*coli|Escherichia\s+coli|EC)\b"), 3.0),
        ("units", words(r"\b(?:ug/mL|µg/mL|μg/mL|mg/mL|µM|uM)\b"), 2.0),
    ),
    required=REQUIRED,
    assay=words(rf"\b(p?MIC)\b[^<>=\d]{{0,40}}(<=|>=|<|>|=)?\s*(\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?)\s*({_UNITS})?"),
    compound=words(r"\b(?:compound\s+)?(\d+[a-z]{0,3}|[A-Z]{1,4}-\d{1,3}|[A-Z]\d{1,3})\b"),
    entity=words(r"(S\.\s*aureus|Staph\.\s*aureus|Staphylococcus\s+aureus|E\.\s*coli|Escherichia\s+coli)"),
)

UNIT_TOKEN = r"[µμu]mol\s*/?\s*mL\s*(?:[-−]\s*1)?|[µμu]g\s*/?\s*mL\s*(?:[-−]\s*1)?|mg\s*/?\s*L\s*(?:[-−]\s*1)?|mM|[µμu]M"

UNIT_ALIASES = {
    "ug/mL": "µg/mL", "ugmL-1": "µg/mL", "µgmL-1": "µg/mL", "µg/mL": "µg/mL", "mcg/mL": "µg/mL", "microg/mL": "µg/mL", "mg/L": "µg/mL", "mgL-1": "µg/mL",
    "µM": "µM", "uM": "µM", "µmol/mL": "µmol/mL", "µmolmL-1": "µmol/mL", "umol/mL": "µmol/mL", "umolmL-1": "µmol/mL", "mmol/l": "mmol/L",
}
BACTERIA_ALIASES = {
    "S. aureus": "Staphylococcus aureus", "Staph. aureus": "Staphylococcus aureus", "Staphylococcus aureus": "Staphylococcus aureus",
    "E. coli": "Escherichia coli", "Escherichia coli": "Escherichia coli",
}
COLI_KEYS = ("ec", "ecoli", "escherichiacoli")
AUREUS_KEYS = ("sa", "saureus", "staphaureus", "staphylococcusaureus")
EVAL_BACTERIA = {"s. aureus": "staphylococcus aureus", "staphylococcus aureus": "staphylococcus aureus", "e. coli": "escherichia coli", "escherichia coli": "escherichia coli"}

HEADER_ORGANISMS = {"S.aureus": "S. aureus", "Staphylococcusaureus": "Staphylococcus aureus", "E.coli": "E. coli", "Escherichiacoli": "Escherichia coli"}
SHORT_ORGANISMS = {"Sa": "S. aureus", "Ec": "E. coli"}
EC_STRAIN = "Escherichia coli ATCC 25922"
MSSA_STRAIN = "MSSA, Methicillin-susceptible strains of Staphylococcus aureus ATCC 29213"
MRSA_STRAIN = "MRSA, Methicillin-resistant strains of Staphylococcus aureus ATCC 43300"

FORBIDDEN_INPUTS = frozenset({"ground_truth.csv", "predictions.csv", "predictions.json", "predictions_with_evidence.json", "metrics.json", "field_metrics.csv"})
