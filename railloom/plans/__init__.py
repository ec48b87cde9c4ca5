"""Query plans that combine operators into whole answers, and their registry."""
