"""Knowledge analytics over large text collections, as DataFrame, SQL and Structured Streaming plans."""
