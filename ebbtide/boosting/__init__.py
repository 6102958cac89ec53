"""Second-order boosting of many fits at once."""
