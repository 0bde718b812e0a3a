"""Filing HTML: a tolerant tree, tables of contents, item spans, item texts, heading structure. Plain Python on one
document at a time; operators.filings runs it over Arrow batches."""
