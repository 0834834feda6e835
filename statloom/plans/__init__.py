"""All queries of the library by name, with SQL for the same rows."""

from statloom.plans import audits, bases, calibration, decisions, documents, forms, operations, reading, statements

PARTS = (statements, documents, operations, audits, bases, decisions, reading, forms, calibration)
QUERIES = {k: f for part in PARTS for k, f in part.QUERIES.items()}
ORACLE = {k: sql for part in PARTS for k, sql in part.ORACLE.items()}
