"""Functions of the note and chat engine."""
