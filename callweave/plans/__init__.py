"""Plans that combine operators, and the helpers that cut or keep their lineage."""
