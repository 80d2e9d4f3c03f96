"""DataFrame operators: dedupe, distribution, joins, markets, scores, extraction, history, quality."""
