from lakeclerk.plans.copy import CopyLineage, copy_table
from lakeclerk.plans.enrichment import Enrichment, EnrichmentResult
from lakeclerk.plans.vaccination import EXTENDED_SCHEMA, vaccination_enrichment

__all__ = [
    "CopyLineage",
    "EXTENDED_SCHEMA",
    "Enrichment",
    "EnrichmentResult",
    "copy_table",
    "vaccination_enrichment",
]
