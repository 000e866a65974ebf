"""The indicator jobs: operators composed into results. Column names and rules are arguments with the usual defaults."""
