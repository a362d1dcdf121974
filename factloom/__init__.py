"""factloom: a Spark-native claim ledger.

Facts, blocks, filings, relations and quarantined proposals are DataFrames; normalisation, claim
keys, candidate linking and reconciliation are declarative column expressions that Catalyst plans.
"""
