"""Readers, record parsing with a failure ledger, unit bookkeeping and sinks."""
