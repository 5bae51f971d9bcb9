"""Routing analytics on Spark: DataFrame operators for tiered model answers, verdicts, ledgers and logits."""
