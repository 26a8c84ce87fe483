"""The engine's queries over the standard tables, each with the SQL that checks it."""
