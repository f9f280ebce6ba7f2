"""Word pairs that the quality gate takes for plausible."""

from __future__ import annotations

#: Pairs of neighbouring words.
BIGRAMS = [
    "the system", "the database", "the model", "the file", "the code", "the user", "the query", "the data", "the following", "the memory", "the vector", "the search", "the table",
    "the index", "the service", "the function", "the api", "the result", "the event", "the tag", "in the", "on the", "for the", "to the", "with the", "by the", "from the", "at the",
    "into the", "of the", "this is", "that is", "it is", "there is", "there are", "to be", "should be", "can be", "will be", "must be", "used to", "used for", "used in", "based on",
    "according to", "such as", "as well", "well as", "due to", "in order", "order to", "so that", "such that", "set to", "refers to", "consists of", "composed of", "designed to",
    "built with", "implemented in", "written in", "created by", "stored in", "saved to", "added to", "removed from", "retrieved from", "searched by", "filtered by", "sorted by",
    "grouped by", "sqlite database", "sqlite fts5", "sqlite vec", "vector search", "dense vector", "hybrid search", "rrf search", "onnx model", "onnx runtime", "fastembed model",
    "mcp server", "mcp tool", "database schema", "database viewer", "quality gate", "quality score", "quality status", "text quality", "shannon entropy", "type token", "token ratio",
    "sequence repetition", "markdown structure", "markdown syntax", "markdown density", "code block", "code fence", "exact hash", "sha 256", "content hash", "duplicate detection",
    "vector cluster", "consolidation request", "librarian service", "event log", "knowledge graph", "relation edge", "supersedes relation", "derived from", "consolidated from",
    "temporal history", "scd type", "rest api", "http request", "json payload", "async task", "python module", "unit test", "test suite", "function call", "parameter alias",
    "metadata filter", "context id", "owner id", "is core", "scope shared", "scope private", "active memories", "returns a", "returns the", "accepts a", "accepts the", "takes a",
    "takes the", "provides a", "provides the", "creates a", "creates the", "updates the", "deletes the", "fetches the", "executes the", "parses the", "evaluates the", "verifies the",
    "validates the", "calculates the", "extracts the", "data structure", "source code", "binary file", "plain text", "user request", "system prompt", "error message", "log file",
]
