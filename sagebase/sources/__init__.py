"""Sources: files of a folder, by their kind."""
