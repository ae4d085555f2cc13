"""caseweave: document, privacy, evidence and graph analytics as PySpark DataFrame jobs."""
