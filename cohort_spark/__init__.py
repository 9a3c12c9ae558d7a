"""Study-cohort analytics on PySpark: ingest, manifests, audits, weak labels, folds, evaluation, delivery."""
