from riskframe.sources import lineage, logs, registry, reports, tables

__all__ = ["lineage", "logs", "registry", "reports", "tables"]
