"""Payment reconciliation as Spark jobs: ledger records against settlements, with evidence for every outcome."""
