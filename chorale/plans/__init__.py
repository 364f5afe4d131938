"""Plans: the voice catalog's queries, and the registered queries over the test tables."""
