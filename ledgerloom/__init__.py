"""ledgerloom: event-sourced trees, JSON snapshots and ledgers as Spark plans."""
