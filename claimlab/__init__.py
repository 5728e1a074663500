"""claimlab: claim-payment analytics as PySpark DataFrame functions."""
