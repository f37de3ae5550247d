"""Document triage on Spark: gate, parse, classify, extract, validate and audit as DataFrame plans."""

from docsieve.operators.classify import (
    classify, classify_long, explain_scores, extract_fields, keyword_evidence)
from docsieve.operators.gate import gate
from docsieve.operators.ledger import read_ledger, resolve_with_ledger
from docsieve.operators.parse import Parsed, parse_documents
from docsieve.operators.redact import flag_privacy, load_privacy_rules, mask_privacy
from docsieve.operators.validate import record_violations, validate
from docsieve.plans.batch import BatchRun, read_stage_metrics, run_batch, stage_means
from docsieve.plans.integrity import IntegrityBook
from docsieve.plans.manifest import Manifest
from docsieve.plans.mining import mined_keywords
from docsieve.plans.process import audit_from_results, audit_records, payload, process
from docsieve.plans.reprocess import decided, read_versions, reprocessed, write_version
from docsieve.rules import Category, RuleSet, RuleStore, load_rules
from docsieve.sources.documents import from_text, from_uploads, read_files
from docsieve.streaming.ingest import DirectoryStream, arrivals, ingest

__all__ = [
    "BatchRun", "Category", "DirectoryStream", "IntegrityBook", "Manifest", "Parsed", "RuleSet", "RuleStore",
    "arrivals", "audit_from_results", "audit_records", "classify", "classify_long", "decided", "explain_scores",
    "extract_fields", "flag_privacy", "from_text", "from_uploads", "gate", "ingest",
    "keyword_evidence", "load_privacy_rules", "load_rules", "mask_privacy", "mined_keywords",
    "parse_documents", "payload", "process", "read_files", "read_ledger", "read_stage_metrics",
    "read_versions", "record_violations", "reprocessed", "resolve_with_ledger", "run_batch", "stage_means",
    "validate", "write_version",
]
