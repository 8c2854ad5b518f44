"""Readers and writers: stored chunks, older binary and text files, workbooks."""
