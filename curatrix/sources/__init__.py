"""Table scans and sinks, image directories, embedding caches, resumable batches."""
