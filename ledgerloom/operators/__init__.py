"""DataFrame to DataFrame operators on ledgers; every one works on all statements at once."""
