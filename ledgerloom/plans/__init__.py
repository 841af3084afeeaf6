"""Plans that put operators together: accepting a ledger, folding it, and the catalogue of queries."""
