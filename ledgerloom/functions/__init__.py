"""Functions of the spend and contract engine."""
