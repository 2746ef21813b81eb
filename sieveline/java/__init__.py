"""Java source to facts: a scanner over tokens, run by Spark on whole files, one file at a time."""
