"""Named queries over the project's tables, each with its SQL where SQL can express it."""
