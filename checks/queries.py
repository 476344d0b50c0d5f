"""All registered queries."""

from checks import pheno_queries, report_queries, storage_queries, table_queries, variant_queries  # noqa: F401
