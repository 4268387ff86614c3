"""Account-risk analytics as DataFrame operators over all statements, ledgers and cases at once."""
