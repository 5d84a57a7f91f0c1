"""Structured invoice extraction over document tables, on Spark DataFrames."""

from invoicelake.plans.extraction import DocType, INVOICE, RECEIPT, extract_documents, extract_invoices
from invoicelake.plans.pipeline import run_pipeline

__all__ = [
    "DocType",
    "INVOICE",
    "RECEIPT",
    "extract_documents",
    "extract_invoices",
    "run_pipeline",
]
