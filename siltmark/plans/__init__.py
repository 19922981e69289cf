"""Session helpers, report plans and registered queries."""
